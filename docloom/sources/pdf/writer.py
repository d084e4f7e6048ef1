"""Writing: new documents, whole rewrites, and updates appended to a file that stays as it is."""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from itertools import accumulate, starmap
from typing import Any

from docloom.sources.images import ImageError, jpeg_shape, png_decode, png_scan
from docloom.sources.pdf.crypto import build_r6, cbc_encrypt_prefixed
from docloom.sources.pdf.document import Document
from docloom.sources.pdf.objects import Name, Ref, Stream, Written, references, renumber, write


_ROW = struct.Struct(">BQI")


def deflated(raw: bytes, **d: Any) -> Stream:
    return Stream({Name(k): v for k, v in d.items()} | {"Filter": Name("FlateDecode")}, zlib.compress(raw))


def deflated_short(raw: bytes) -> bytes:
    """Deflated data of a few bytes, by a coder with a small window: making one of the usual size costs more than the data does."""
    d = zlib.compressobj(6, zlib.DEFLATED, 9, 1)
    return d.compress(raw) + d.flush()


def deflate_raw(raw: bytes) -> bytes:
    """Deflated data without a header or checksum, as archives have it."""
    d = zlib.compressobj(6, zlib.DEFLATED, -15)
    return d.compress(raw) + d.flush()


def _image(width: int, height: int, depth: int, space: Any) -> dict[str, Any]:
    return {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": width, "Height": height, "BitsPerComponent": depth, "ColorSpace": space}


def _streams_out(value: Any, add: Any) -> Any:
    """The same object with its inner streams as objects of their own."""
    if isinstance(value, dict):
        return {k: _streams_out(v, add) for k, v in value.items()}
    if isinstance(value, list):
        return [_streams_out(v, add) for v in value]
    return add(value) if isinstance(value, Stream) else value


def _sealed(value: Any, key: bytes, top: bool = True) -> Any:
    """Strings and streams encrypted with AES-256."""
    if isinstance(value, bytes):
        return cbc_encrypt_prefixed(key, os.urandom(16), value)
    if isinstance(value, dict):
        return {k: _sealed(v, key) for k, v in value.items()}
    if isinstance(value, list):
        return [_sealed(v, key) for v in value]
    if isinstance(value, Stream):
        return Stream(_sealed(value.dict, key), cbc_encrypt_prefixed(key, os.urandom(16), value.raw))
    return value


def rewrite(objects: dict[int, Any], trailer: dict[str, Any], packed: bool = False, passwords: tuple[str, str] | None = None, permissions: int = -4, entropy: bytes | None = None) -> bytes:
    """All objects under new numbers; packed writes object streams and a cross-reference stream; passwords are (user, owner)."""
    order = sorted(objects)
    to = {n: i for i, n in enumerate(order, 1)}
    if order and order[-1] != len(order) and any(type(v) is Written for v in objects.values()):
        raise ValueError("objects that are written already keep their numbers")
    items = {to[n]: v if type(v := objects[n]) is Written else renumber(v, to) for n in order}
    trailer = renumber({k: v for k, v in trailer.items() if k in ("Root", "Info", "ID")}, to)
    if passwords is not None:
        d, key = build_r6(*passwords, permissions, entropy or os.urandom(64))
        items = {n: _sealed(v, key) for n, v in items.items()}
        number = len(items) + 1
        items[number] = d | {"CF": {"StdCF": {"CFM": Name("AESV3"), "AuthEvent": Name("DocOpen"), "Length": 32}}, "StmF": Name("StdCF"), "StrF": Name("StdCF"), "Filter": Name("Standard")}
        trailer["Encrypt"] = Ref(number)
        packed = False
    bodies = [v if type(v) is Written else write(v) for v in items.values()]
    return assembled(bodies, {n for n, v in items.items() if isinstance(v, Stream)}, trailer, packed)


def assembled(bodies: list[bytes], streams: set[int], trailer: dict[str, Any], packed: bool = False) -> bytes:
    """A file of objects that are written already, numbered from 1 on in this order; `streams` has the numbers of those that are streams."""
    head = b"%PDF-2.0\n%\xe2\xe3\xcf\xd3\n"
    if not packed:
        out = [b"%d 0 obj\n%b\nendobj\n" % numbered for numbered in enumerate(bodies, 1)]
        ends = list(accumulate(map(len, out), initial=len(head)))
        lines = b"".join([b"%010d 00000 n \n" % at for at in ends[:-1]])
        last = len(bodies)
        end = b"xref\n0 %d\n0000000000 65535 f \n%btrailer\n%b\nstartxref\n%d\n%%%%EOF\n" % (last + 1, lines, write({"Size": last + 1} | trailer), ends[-1])
        return b"".join([head, *out, end])
    rows: list[tuple[int, int, int]] = [(0, 0, 65535)] * (len(bodies) + 1)
    out, at, rest = [head], len(head), []
    for numbered in enumerate(bodies, 1):
        if (n := numbered[0]) in streams:
            out.append(b"%d 0 obj\n%b\nendobj\n" % numbered)
            rows[n] = (1, at, 0)
            at += len(out[-1])
        else:
            rest.append(numbered)
    for begin in range(0, len(rest), 100):
        numbers, members = zip(*rest[begin : begin + 100], strict=True)
        number = len(rows)
        starts = accumulate([len(m) + 1 for m in members[:-1]], initial=0)
        heads = b"".join([b"%d %d " % pair for pair in zip(numbers, starts, strict=True)])
        for i, n in enumerate(numbers):
            rows[n] = (2, number, i)
        rows.append((1, at, 0))
        body = heads + b"\n".join(members) + b"\n"
        out.append(b"%d 0 obj\n" % number + write(deflated(body, Type=Name("ObjStm"), N=len(numbers), First=len(heads))) + b"\nendobj\n")
        at += len(out[-1])
    number = len(rows)
    rows.append((1, at, 0))
    stream = deflated(b"".join(starmap(_ROW.pack, rows)))
    stream.dict |= {"Type": Name("XRef"), "Size": number + 1, "W": [1, 8, 4]} | trailer
    out.append(b"%d 0 obj\n" % number + write(stream) + b"\nendobj\nstartxref\n%d\n%%%%EOF\n" % at)
    return b"".join(out)


def _references(where: dict[int, tuple[int, int, int]], trailer: dict[str, Any], at: int, packed: bool, last: int, previous: int | None = None) -> bytes:
    trailer = dict(trailer) | ({"Prev": previous} if previous is not None else {})
    if packed:
        number = last + 1
        where = where | {number: (1, at, 0)}
        rows = [(0, 0, 65535), *[where[n] for n in range(1, number + 1)]] if previous is None else [where[n] for n in sorted(where)]
        d = {"Type": Name("XRef"), "Size": number + 1, "W": [1, 8, 4]} | ({} if previous is None else {"Index": [x for n in sorted(where) for x in (n, 1)]}) | trailer
        body = b"".join([_ROW.pack(*row) for row in rows])
        stream = deflated(body)
        stream.dict |= d
        return b"%d 0 obj\n" % number + write(stream) + b"\nendobj\nstartxref\n%d\n%%%%EOF\n" % at
    out = bytearray(b"xref\n")
    where = where | ({0: (0, 0, 65535)} if previous is None else {})
    numbers = sorted(where)
    begins = [i for i, n in enumerate(numbers) if i == 0 or numbers[i - 1] != n - 1]
    for i, j in zip(begins, [*begins[1:], len(numbers)], strict=True):  # a section for the numbers that follow one another
        out += b"%d %d\n" % (numbers[i], j - i)
        out += b"".join([b"%010d %05d %s \n" % (offset, gen, b"n" if kind else b"f") for kind, offset, gen in map(where.__getitem__, numbers[i:j])])
    return bytes(out) + b"trailer\n" + write({"Size": last + 1} | trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % at


def update(doc: Document, changed: dict[int, Any]) -> bytes:
    """The file as it is, with changed objects appended; null deletes one."""
    out, where = bytearray(doc.data if doc.data.endswith(b"\n") else doc.data + b"\n"), {}
    for n, v in sorted(changed.items()):
        if v is None:
            where[n] = (0, 0, 65535)
            continue
        where[n] = (1, len(out), 0)
        out += b"%d 0 obj\n" % n + write(v) + b"\nendobj\n"
    last = max([*doc.xref, *changed], default=0)
    trailer = {k: v for k, v in doc.trailer.items() if k in ("Root", "Info", "ID", "Encrypt")}
    newest = doc.revisions[0] if doc.revisions else None
    return bytes(out) + _references(where, trailer, len(out), False, last, newest)


class Edit:
    """Changes to a document's objects, kept apart until they are written. Scopes nest, and each is all or nothing."""

    def __init__(self, doc: Document):
        self.doc = doc
        self.layers: list[dict[int, Any]] = [{}]
        self.next = max(doc.xref, default=0) + 1

    def get(self, num: int) -> Any:
        """An object as changed; null for one that is deleted."""
        for layer in reversed(self.layers):
            if num in layer:
                return layer[num]
        return self.doc.get(Ref(num))

    def put(self, num: int, value: Any) -> None:
        self.layers[-1][num] = value

    def add(self, value: Any) -> Ref:
        self.next += 1
        self.layers[-1][self.next - 1] = value
        return Ref(self.next - 1)

    def delete(self, num: int) -> None:
        self.layers[-1][num] = None

    @contextmanager
    def scope(self) -> Iterator[Edit]:
        """What happens inside counts if the scope ends without an error, and otherwise never was."""
        before = self.next
        self.layers.append({})
        try:
            yield self
        except BaseException:
            self.layers.pop()
            self.next = before
            raise
        done = self.layers.pop()
        self.layers[-1].update(done)

    def finish(self) -> bytes:
        if len(self.layers) > 1:
            raise ValueError("a scope is open")
        return update(self.doc, self.layers[0]) if self.layers[0] else self.doc.data


def reachable(doc: Document, start: list[Ref], avoid: set[int] = frozenset()) -> dict[int, Any]:
    """Objects that the start reaches."""
    out: dict[int, Any] = {}
    work = list(start)
    while work:
        r = work.pop()
        if r.num in out or r.num in avoid:
            continue
        value = doc.get(r)
        if isinstance(value, Stream) and doc.handler is not None:
            value = Stream(value.dict, doc.raw(value))
        out[r.num] = value
        work += references(value)
    return out


def copy(doc: Document, pages: list[int] | None = None, **options: Any) -> bytes:
    """What the document needs, written anew; with `pages`, only those, in that order."""
    trailer = dict(doc.trailer)
    leaves = doc.pages()
    if pages is None:
        return rewrite(reachable(doc, [r for k in ("Root", "Info") if isinstance(r := trailer.get(k), Ref)]), trailer, **options)
    kept = [leaves[i] for i in pages if 0 <= i < len(leaves)]
    root, tree = max(doc.xref, default=0) + 1, max(doc.xref, default=0) + 2
    new: dict[int, Any] = {}
    kids = []
    for i, (_, page) in enumerate(kept):
        kids.append(Ref(tree + 1 + i))
        new[kids[-1].num] = {k: v for k, v in page.items() if k != "Parent"} | {"Parent": Ref(tree), "Type": Name("Page")}
    new[root] = {"Type": Name("Catalog"), "Pages": Ref(tree)}
    new[tree] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)}
    own = {r.num for r, _ in leaves if r}
    # Pages that go aren't dragged along by what points to them.
    wanted = [r for v in new.values() for r in references(v) if r.num not in new and r.num not in own]
    return rewrite(reachable(doc, wanted, own) | new, {"Root": Ref(root), "Info": trailer.get("Info")}, **options)


def import_page(doc: Document, source: Document, page: int, index: int, **options: Any) -> bytes | None:
    """doc written anew with a page of another document at `index`; null where there is no such page or place.

    What the page reaches is copied under numbers of its own, with what it inherits; references to the page itself go to the copy,
    those to other pages of its document become null. Outlines, links and fields of doc still go to the pages they went to.
    """
    leaves, others = doc.pages(), source.pages()
    if not 0 <= page < len(others) or not 0 <= index <= len(leaves):
        return None
    last = max(doc.xref, default=0)
    tree, here, root = Ref(last + 1), Ref(last + 2), Ref(last + 3)
    at, leaf = others[page]
    own = {r.num for r, _ in others if r}
    leaf = {k: v for k, v in leaf.items() if k != "Parent"}
    taken = reachable(source, [r for r in references(leaf) if r.num not in own], own)
    to = {n: last + 4 + i for i, n in enumerate(sorted(taken))}
    copied = {to[n]: renumber(v, to | ({at.num: here.num} if at else {})) for n, v in taken.items()}
    copied[here.num] = renumber(leaf, to | ({at.num: here.num} if at else {})) | {"Parent": tree, "Type": Name("Page")}
    refs = [r or Ref(last + 4 + len(taken) + i) for i, (r, _) in enumerate(leaves)]
    pages = {r.num: {k: v for k, v in p.items() if k != "Parent"} | {"Parent": tree, "Type": Name("Page")} for r, (_, p) in zip(refs, leaves, strict=True)}
    kids = [*refs[:index], here, *refs[index:]]
    catalog = {k: v for k, v in doc.catalog().items() if k != "Pages"}
    trailer = dict(doc.trailer) | {"Root": root}
    avoid = set(pages) | {tree.num}
    kept = reachable(doc, [r for v in (catalog, trailer.get("Info"), *pages.values()) for r in references(v) if r.num not in avoid], avoid)
    new = {root.num: catalog | {"Pages": tree}, tree.num: {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)}}
    return rewrite(kept | pages | copied | new, trailer, **options)


@dataclass
class Builder:
    """A new document: pages of operators, fonts, links, an outline and metadata."""

    pages: list[dict[str, Any]] = field(default_factory=list)
    info: dict[str, bytes] = field(default_factory=dict)
    entries: list[tuple[int, str, int]] = field(default_factory=list)
    fonts: dict[str, str] = field(default_factory=lambda: {"F1": "Helvetica"})
    attachments: list[tuple[str, bytes]] = field(default_factory=list)
    labels: list[tuple[int, str, str, int]] = field(default_factory=list)
    programs: dict[str, dict[str, Any]] = field(default_factory=dict)  # font dictionaries with programs in them
    resources: dict[str, dict[str, Any]] = field(default_factory=dict)  # kind, name: an object that all pages may use

    def page(self, width: float = 612, height: float = 792, rotate: int = 0) -> None:
        self.pages.append({"box": [0, 0, width, height], "ops": bytearray(), "links": [], "rotate": rotate})

    def raw(self, operators: bytes, page: int = -1) -> None:
        self.pages[page]["ops"] += operators + b"\n"

    def text(self, x: float, y: float, text: str, size: float = 12, font: str = "F1", page: int = -1) -> None:
        self.raw(b"BT " + write(Name(font)) + b" %s Tf %s %s Td " % (write(size), write(x), write(y)) + write(text.encode("cp1252", "replace")) + b" Tj ET", page)

    # Resources. Each returns false for a name that is taken.

    def _add(self, kind: str, name: str, value: Any) -> bool:
        table = self.resources.setdefault(kind, {})
        return table.setdefault(name, value) is value

    def add_image(self, name: str, body: bytes) -> bool:
        """A JPEG as it is, or a PNG: opaque ones of up to 8 bits without interlacing as they are, others decoded."""
        if shape := jpeg_shape(body):
            width, height, components = shape
            space = {1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}.get(components)
            return space is not None and self._add("XObject", name, Stream(_image(width, height, 8, Name(space)) | {"Filter": Name("DCTDecode")}, body))
        try:
            h = png_scan(body)
            if not h.interlaced and h.colour in (0, 2, 3) and not h.transparency and h.depth <= 8:
                space: Any = Name("DeviceRGB" if h.colour == 2 else "DeviceGray")
                if h.colour == 3:
                    space = [Name("Indexed"), Name("DeviceRGB"), len(h.palette) // 3 - 1, h.palette]
                parms = {"Predictor": 15, "Colors": 3 if h.colour == 2 else 1, "BitsPerComponent": h.depth, "Columns": h.width}
                return self._add("XObject", name, Stream(_image(h.width, h.height, h.depth, space) | {"Filter": Name("FlateDecode"), "DecodeParms": parms}, h.data))
            pixels = png_decode(body)
        except ImageError:
            return False
        height, width, channels = pixels.shape
        colour = pixels[:, :, : 1 if channels < 3 else 3]
        stream = deflated(colour.tobytes())
        stream.dict |= _image(width, height, 8, Name("DeviceGray" if channels < 3 else "DeviceRGB"))
        if channels in (2, 4):
            mask = deflated(pixels[:, :, -1].tobytes())
            mask.dict |= _image(width, height, 8, Name("DeviceGray"))
            stream.dict["SMask"] = mask
        return self._add("XObject", name, stream)

    def add_gstate(self, name: str, fill: float | None = None, stroke: float | None = None, blend: str | None = None) -> bool:
        d = {k: v for k, v in (("ca", fill), ("CA", stroke), ("BM", Name(blend) if blend else None)) if v is not None}
        return self._add("ExtGState", name, {"Type": Name("ExtGState")} | d)

    def add_form(self, name: str, box: tuple[float, float, float, float], operators: bytes, group: bool = False) -> bool:
        """Operators that a page draws with Do; a group is composed on its own first."""
        stream = deflated(operators, Type=Name("XObject"), Subtype=Name("Form"))
        stream.dict |= {"BBox": list(box), "Resources": {"Font": None}} | ({"Group": {"S": Name("Transparency")}} if group else {})
        return self._add("XObject", name, stream)

    def add_shading(self, name: str, coords: list[float], stops: list[tuple[float, tuple[float, float, float]]]) -> bool:
        """An axial (4 numbers) or radial (6) gradient over stops from 0 to 1."""
        if len(coords) not in (4, 6) or len(stops) < 2 or [s for s, _ in stops] != sorted(s for s, _ in stops):
            return False
        parts = [{"FunctionType": 2, "Domain": [0, 1], "C0": list(a), "C1": list(b), "N": 1} for (_, a), (_, b) in zip(stops, stops[1:], strict=False)]
        f = parts[0] if len(parts) == 1 else {"FunctionType": 3, "Domain": [0, 1], "Functions": parts, "Bounds": [s for s, _ in stops[1:-1]], "Encode": [0, 1] * len(parts)}
        return self._add("Shading", name, {"ShadingType": 2 if len(coords) == 4 else 3, "ColorSpace": Name("DeviceRGB"), "Coords": list(coords), "Function": f, "Extend": [True, True]})

    def add_pattern(self, name: str, width: float, height: float, operators: bytes) -> bool:
        """A tile of its own colours."""
        if width <= 0 or height <= 0:
            return False
        stream = deflated(operators, Type=Name("Pattern"))
        stream.dict |= {"PatternType": 1, "PaintType": 1, "TilingType": 1, "BBox": [0, 0, width, height], "XStep": width, "YStep": height, "Resources": {}}
        return self._add("Pattern", name, stream)

    def image(self, name: str, x: float, y: float, width: float, height: float) -> None:
        self.raw(b"q %s 0 0 %s %s %s cm " % tuple(write(v) for v in (width, height, x, y)) + write(Name(name)) + b" Do Q")

    def link(self, box: tuple[float, float, float, float], target: str | int, page: int = -1) -> bool:
        """To a page by number or a URI of printable ASCII; false where neither can be written."""
        if isinstance(target, str) and not (target and all(" " <= c <= "~" for c in target)):
            return False
        self.pages[page]["links"].append((list(box), target))
        return True

    def outline(self, entries: list[tuple[int, str, int]]) -> bool:
        """(depth, title, page); refused whole where a depth skips a level or a page isn't there."""
        last = -1
        for depth, _, page in entries:
            if not 0 <= depth <= last + 1 or not 0 <= page < len(self.pages):
                return False
            last = depth
        self.entries = list(entries)
        return True

    def finish(self, **options: Any) -> bytes:
        objects: dict[int, Any] = {}

        def add(value: Any) -> Ref:
            objects[len(objects) + 1] = value
            return Ref(len(objects))

        string = lambda t: t.encode("ascii") if t.isascii() else b"\xfe\xff" + t.encode("utf-16-be")
        catalog: dict[str, Any] = {"Type": Name("Catalog")}
        root, tree = add(catalog), add(None)
        fonts = {k: add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name(v), "Encoding": Name("WinAnsiEncoding")}) for k, v in self.fonts.items()}
        fonts |= {k: add(_streams_out(v, add)) for k, v in self.programs.items()}
        shared: dict[str, dict[str, Ref]] = {}
        for kind, table in self.resources.items():
            for name, value in table.items():
                if isinstance(value, Stream) and isinstance(value.dict.get("SMask"), Stream):
                    value = Stream(value.dict | {"SMask": add(value.dict["SMask"])}, value.raw)
                elif isinstance(value, Stream) and "Font" in value.dict.get("Resources", {}):
                    value = Stream(value.dict | {"Resources": {"Font": fonts}}, value.raw)
                shared.setdefault(kind, {})[name] = add(value)
        # One object for all pages: written out in each, the resources of a file would grow as a square.
        resources = add({"Font": fonts} | shared)
        refs = [add(None) for _ in self.pages]
        for ref, p in zip(refs, self.pages, strict=True):
            annots = [add({"Type": Name("Annot"), "Subtype": Name("Link"), "Rect": box} | ({"Dest": [refs[t], Name("Fit")]} if isinstance(t, int) else {"A": {"S": Name("URI"), "URI": t.encode()}})) for box, t in p["links"]]
            objects[ref.num] = {"Type": Name("Page"), "Parent": tree, "MediaBox": p["box"], "Resources": resources, "Contents": add(deflated(bytes(p["ops"])))} | ({"Annots": annots} if annots else {}) | ({"Rotate": p["rotate"]} if p["rotate"] else {})
        objects[tree.num] = {"Type": Name("Pages"), "Kids": refs, "Count": len(refs)}
        catalog["Pages"] = tree
        if self.entries:
            catalog["Outlines"] = self._outline(add, objects, refs, string)
        if self.attachments:
            names = []
            for name, body in sorted(self.attachments):
                file = add(deflated(body, Type=Name("EmbeddedFile"), Params={"Size": len(body)}))
                names += [string(name), add({"Type": Name("Filespec"), "F": string(name), "UF": string(name), "EF": {"F": file}})]
            catalog["Names"] = {"EmbeddedFiles": {"Names": names}}
        if self.labels:
            catalog["PageLabels"] = {"Nums": [x for page, style, prefix, start in self.labels for x in (page, ({"S": Name(style)} if style else {}) | {"P": string(prefix), "St": start})]}
        trailer: dict[str, Any] = {"Root": root}
        if self.info:
            trailer["Info"] = add({k: string(v) for k, v in self.info.items()})
        digest = hashlib.md5(b"".join(write(v) for v in objects.values())).digest()
        return rewrite(objects, trailer | {"ID": [digest, digest]}, **options)

    def _outline(self, add: Any, objects: dict[int, Any], refs: list[Ref], string: Any) -> Ref:
        top = add({"Type": Name("Outlines")})
        above, children = [top], {top.num: []}
        for depth, title, page in self.entries:
            item = add({"Title": string(title), "Parent": above[depth], "Dest": [refs[page], Name("Fit")]})
            children[above[depth].num].append(item)
            children[item.num] = []
            above = [*above[: depth + 1], item]
        for num, items in children.items():
            if items:
                objects[num] |= {"First": items[0], "Last": items[-1], "Count": len(items)}
            for a, b in zip(items, items[1:], strict=False):
                objects[a.num]["Next"], objects[b.num]["Prev"] = b, a
        return top
