"""ZIP archives and what comes in them: comic books, e-books, fixed documents."""

from __future__ import annotations

import hashlib
import re
import struct
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More entries than that raise; none are left out.
MAX_ENTRIES = 1 << 22
MAX_ENTRY = 256 << 20
MAX_TOTAL = 1 << 30
# Compression methods.
METHODS = {0: "stored", 8: "deflate", 9: "deflate64", 12: "bzip2", 14: "lzma", 93: "zstd", 95: "xz", 98: "ppmd"}
OBFUSCATION = {"http://www.idpf.org/2008/embedding": "idpf", "http://ns.adobe.com/pdf/enc#RC": "adobe"}


@dataclass(frozen=True)
class Entry:
    index: int
    name: str
    method: str
    header_offset: int
    compressed: int
    uncompressed: int
    crc: int
    encrypted: bool


class Archive:
    """Entries by the central directory; by a scan of local headers where that is missing or empty."""

    def __init__(self, data: bytes):
        self.data, self.scanned, self.spent = data, False, 0
        self.entries = self._central() or self._scan()
        self.by_name = {e.name: e for e in reversed(self.entries)}  # the first of a name counts

    def _central(self) -> list[Entry]:
        end = self.data.rfind(b"PK\x05\x06", max(0, len(self.data) - 65_557))
        if end < 0 or end + 22 > len(self.data):
            return []
        count, _, at = struct.unpack_from("<HII", self.data, end + 10)
        out = []
        while self.data[at : at + 4] == b"PK\x01\x02" and at + 46 <= len(self.data):
            _room(out)
            flags, method, _, _, crc, packed, size, n, extra, comment = struct.unpack_from("<HHHHIIIHHH", self.data, at + 8)
            (offset,) = struct.unpack_from("<I", self.data, at + 42)
            name = self.data[at + 46 : at + 46 + n]
            out.append(Entry(len(out), _name(name, flags), METHODS.get(method, str(method)), offset, packed, size, crc, bool(flags & 1)))
            at += 46 + n + extra + comment
        return out if len(out) >= min(count, 1) else []

    def _scan(self) -> list[Entry]:
        self.scanned, out, at = True, [], 0
        while (at := self.data.find(b"PK\x03\x04", at)) >= 0 and at + 30 <= len(self.data):
            _room(out)
            flags, method, _, _, crc, packed, size, n, extra = struct.unpack_from("<HHHHIIIHH", self.data, at + 6)
            start = at + 30 + n + extra
            if flags & 8 and not packed:  # lengths follow the data
                mark = self.data.find(b"PK\x07\x08", start)
                if mark >= 0:
                    crc, packed, size = struct.unpack_from("<III", self.data.ljust(mark + 16, b"\0"), mark + 4)
            out.append(Entry(len(out), _name(self.data[at + 30 : at + 30 + n], flags), METHODS.get(method, str(method)), at, packed, size, crc, bool(flags & 1)))
            at = start + packed if packed else at + 4
        return out

    def local_extra(self, e: Entry) -> bytes | None:
        if self.data[e.header_offset : e.header_offset + 4] != b"PK\x03\x04":
            return None
        n, extra = struct.unpack_from("<HH", self.data, e.header_offset + 26)
        return self.data[e.header_offset + 30 + n : e.header_offset + 30 + n + extra]

    def read(self, e: Entry) -> tuple[bytes | None, str | None]:
        """(bytes, defect): encrypted, method, bounds, limit or checksum. Bytes whose checksum is wrong aren't given."""
        if e.encrypted:
            return None, "encrypted"
        if self.data[e.header_offset : e.header_offset + 4] != b"PK\x03\x04":
            return None, "bounds"
        n, extra = struct.unpack_from("<HH", self.data, e.header_offset + 26)
        start = e.header_offset + 30 + n + extra
        raw = self.data[start : start + e.compressed]
        if len(raw) < e.compressed:
            return None, "bounds"
        if e.method == "stored":
            out = raw
        elif e.method == "deflate":
            d = zlib.decompressobj(-15)
            try:
                out = d.decompress(raw, MAX_ENTRY + 1)
            except zlib.error:
                return None, "damaged"
        else:
            return None, "method"
        self.spent += len(out)
        if len(out) > MAX_ENTRY or self.spent > MAX_TOTAL:
            return None, "limit"
        return (out, None) if zlib.crc32(out) == e.crc else (None, "checksum")

    def get(self, name: str) -> bytes | None:
        e = self.by_name.get(name)
        return self.read(e)[0] if e else None


def _room(entries: list[Entry]) -> None:
    if len(entries) >= MAX_ENTRIES:
        raise ValueError(f"over {MAX_ENTRIES} entries")


def _name(raw: bytes, flags: int) -> str:
    try:
        return raw.decode("utf-8") if flags & 0x800 else raw.decode("ascii")
    except UnicodeDecodeError:
        return raw.decode("cp437")


# Natural order.


def natural_key(name: str) -> list[tuple]:
    """Runs of digits compare by their value's length and digits, other runs without ASCII case and then as they are."""
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), name)
    key: list[tuple] = []
    for m in re.finditer(r"([0-9]+)|([^0-9]+)", folded):
        digits = m[1].lstrip("0") if m[1] else ""
        # A run of digits meets one of text as text, by its first character.
        key.append((m[0][0] if m[2] else "0", 0, len(digits), digits) if m[1] else (m[0][0], 1, 0, m[0].encode()))
    return [*key]


def natural_order(names: list[str]) -> list[int]:
    """Indexes in reading order; equal names keep the order of the directory."""
    return sorted(range(len(names)), key=lambda i: ([(k[0].encode(), k[1], k[2], k[3] if isinstance(k[3], bytes) else k[3].encode()) for k in natural_key(names[i])], names[i].encode(), i))


# Images in comic books.


def image_format(b: bytes) -> str | None:
    from docloom.functions.bytes import IMAGES

    for name, at, magic in IMAGES:
        raw = bytes.fromhex(magic)
        if b[at : at + len(raw)] == raw and (name != "webp" or b[:4] == b"RIFF") and (name != "bmp" or len(b) >= 26):
            return name
    return None


def comic_pages(a: Archive) -> Iterator[dict[str, Any]]:
    """Images in natural order. What can't be read is a page if its name says so; what is no image isn't one."""
    from docloom.functions.bytes import IMAGE_EXTENSIONS

    for page, i in enumerate(_image_entries(a, IMAGE_EXTENSIONS)):
        yield {"page": page, **i}


def _image_entries(a: Archive, extensions: tuple[str, ...]) -> Iterator[dict[str, Any]]:
    for i in natural_order([e.name for e in a.entries]):
        e = a.entries[i]
        if e.name.endswith("/"):
            continue
        body, defect = a.read(e)
        kind = image_format(body) if body is not None else None
        stem, _, extension = e.name.rsplit("/", 1)[-1].rpartition(".")
        if kind or (body is None and stem and extension.lower() in extensions):
            yield {"entry": e.name, "format": kind, "defect": defect, "length": len(body) if body is not None else None}


# XML. A document type is refused by name before anything of it is read.


class XmlRefused(ValueError):
    pass


def parse_xml(body: bytes) -> ET.Element:
    if re.search(rb"<!DOCTYPE|<!ENTITY", body.replace(b"\0", b""), re.I):
        allowed = re.fullmatch(rb"(?is)\s*(?:<\?xml[^>]*\?>)?\s*(?:<!--.*?-->\s*)*<!DOCTYPE\s+[\w:]+(?:\s+(?:PUBLIC\s+\"[^\"]*\"|SYSTEM)\s+\"[^\"]*\")?\s*>(.*)", body)
        if not allowed or re.search(rb"<!ENTITY", body, re.I):
            raise XmlRefused("document type")
        body = re.sub(rb"(?is)<!DOCTYPE[^>]*>", b"", body, count=1)
        body = re.sub(rb"&(?!amp;|lt;|gt;|quot;|apos;|#)(\w+);", _entity, body)
    try:
        return ET.fromstring(body)
    except (ET.ParseError, ValueError, LookupError) as e:
        raise XmlRefused(str(e)) from None


def _entity(m: re.Match) -> bytes:
    from html.entities import html5

    return html5.get(m[1].decode() + ";", "").encode("ascii", "xmlcharrefreplace")


def local(tag: Any) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def attribute(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if local(k) == name), None)


def resolve(referring: str, reference: str) -> str | None:
    """A path in the container; null where it leaves it, is a URL, or isn't UTF-8."""
    path = reference.split("#", 1)[0].split("?", 1)[0]
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return None
    out = [] if path.startswith("/") else referring.split("/")[:-1]
    for segment in path.split("/"):
        try:
            segment = unquote_to_bytes(segment).decode("utf-8")
        except UnicodeDecodeError:
            return None
        if segment == "..":
            if not out:
                return None
            out.pop()
        elif segment not in ("", "."):
            out.append(segment)
    return "/".join(out) or referring


# E-books.


class Book:
    """An EPUB: its package, spine, navigation and obfuscated fonts."""

    def __init__(self, a: Archive):
        self.archive, self.defects = a, []
        self.path = next((r for r in self._rootfiles()), None)
        self.items: dict[str, dict[str, Any]] = {}
        self.spine: list[dict[str, Any]] = []
        self.metadata: dict[str, str] = {}
        self.unique_id = ""
        package = self._xml(self.path)
        if package is not None:
            self._package(package)
        self.obfuscated = self._encryption()

    def _xml(self, name: str | None) -> ET.Element | None:
        body = self.archive.get(name) if name else None
        try:
            return parse_xml(body) if body is not None else None
        except XmlRefused:
            self.defects.append(f"xml {name}")
            return None

    def _rootfiles(self) -> list[str]:
        root = self._xml("META-INF/container.xml")
        found = [attribute(e, "full-path") for e in root.iter() if local(e.tag) == "rootfile" and attribute(e, "media-type") in (None, "application/oebps-package+xml")] if root is not None else []
        return [f for f in found if f]

    def _encryption(self) -> dict[str, str]:
        root, out = self._xml("META-INF/encryption.xml"), {}
        for e in root.iter() if root is not None else ():
            if local(e.tag) == "EncryptedData":
                method = next((attribute(m, "Algorithm") for m in e.iter() if local(m.tag) == "EncryptionMethod"), "") or ""
                for r in e.iter():
                    if local(r.tag) == "CipherReference" and (path := resolve("", attribute(r, "URI") or "")):
                        out[path] = OBFUSCATION.get(method, "encrypted")
        return out

    def _package(self, root: ET.Element) -> None:
        identifiers = {}
        for e in root.iter():
            tag = local(e.tag)
            if "dc/elements" in str(e.tag):
                self.metadata.setdefault(tag, (e.text or "").strip())
                if tag == "identifier":
                    identifiers[e.get("id")] = (e.text or "").strip()
            elif tag == "meta" and e.get("property"):
                self.metadata.setdefault(e.get("property"), (e.text or "").strip())
            elif tag == "item" and e.get("id"):
                path = resolve(self.path, e.get("href") or "")
                self.items.setdefault(e.get("id"), {"id": e.get("id"), "path": path, "media_type": e.get("media-type") or "", "properties": (e.get("properties") or "").split(), "fallback": e.get("fallback")})
            elif tag == "itemref":
                self.spine.append({"idref": e.get("idref") or "", "linear": e.get("linear") != "no", "properties": (e.get("properties") or "").split()})
            elif tag == "spine":
                self.ncx = e.get("toc")
        self.unique_id = identifiers.get(root.get("unique-identifier"), "")

    def content(self, item: dict[str, Any]) -> dict[str, Any] | None:
        """The first item of a fallback chain that is a content document."""
        for _ in range(16):
            if item is None or item["media_type"] in ("application/xhtml+xml", "image/svg+xml", "text/html"):
                return item
            item = self.items.get(item["fallback"])
        return None

    def layout(self, ref: dict[str, Any]) -> str:
        """A spine item's own layout goes before the book's."""
        for p in ref["properties"]:
            if p in ("rendition:layout-pre-paginated", "rendition:layout-reflowable"):
                return p.removeprefix("rendition:layout-")
        return self.metadata.get("rendition:layout", "reflowable")

    def navigation(self) -> list[dict[str, Any]]:
        """(depth, title, path, fragment) from the navigation document, else from the NCX."""
        nav = next((i for i in self.items.values() if "nav" in i["properties"]), None)
        root = self._xml(nav["path"]) if nav else None
        out: list[dict[str, Any]] = []
        if root is not None:
            toc = next((e for e in root.iter() if local(e.tag) == "nav" and "toc" in (attribute(e, "type") or "").split()), None)
            if toc is not None:
                self._nav(toc, nav["path"], 0, out)
        if not out:
            ncx = self.items.get(getattr(self, "ncx", None) or "") or next((i for i in self.items.values() if i["media_type"] == "application/x-dtbncx+xml"), None)
            root = self._xml(ncx["path"]) if ncx else None
            for e in root if root is not None else ():
                if local(e.tag) == "navMap":
                    self._ncx(e, ncx["path"], 0, out)
        return out

    def _nav(self, e: ET.Element, base: str, depth: int, out: list) -> None:
        for ol in [c for c in e if local(c.tag) == "ol"]:
            for li in ol:
                label = next((c for c in li if local(c.tag) in ("a", "span")), None)
                if label is not None:
                    out.append(_target(depth, "".join(label.itertext()), base, label.get("href")))
                if depth < 64:
                    self._nav(li, base, depth + 1, out)

    def _ncx(self, e: ET.Element, base: str, depth: int, out: list) -> None:
        for point in [c for c in e if local(c.tag) == "navPoint"]:
            text = next(("".join(t.itertext()) for t in point if local(t.tag) == "navLabel"), "")
            src = next((t.get("src") for t in point if local(t.tag) == "content"), None)
            out.append(_target(depth, text, base, src))
            if depth < 64:
                self._ncx(point, base, depth + 1, out)

    def chapters(self) -> Iterator[dict[str, Any]]:
        """The spine's content documents with their text, block elements a line each."""
        for seq, ref in enumerate(self.spine):
            item = self.content(self.items.get(ref["idref"]))
            root = self._xml(item["path"]) if item else None
            yield {"seq": seq, "idref": ref["idref"], "path": item["path"] if item else None, "linear": ref["linear"], "layout": self.layout(ref), "text": xhtml_text(root) if root is not None else None, "viewport": _viewport(root) if root is not None else None}

    def font(self, path: str) -> bytes | None:
        """A font with its obfuscation taken off."""
        body, how = self.archive.get(path), self.obfuscated.get(path)
        return deobfuscate(how, self.unique_id, body) if body is not None and how in ("idpf", "adobe") else body if how is None else None


def _target(depth: int, title: str, base: str, href: str | None) -> dict[str, Any]:
    path, _, fragment = (href or "").partition("#")
    return {"depth": depth, "title": " ".join(title.split()), "path": (resolve(base, path) if path else base) if href else None, "fragment": fragment or None}


def deobfuscate(how: str, identifier: str, body: bytes) -> bytes | None:
    """XOR of the first 1040 bytes by SHA-1 of the identifier, or of the first 1024 by its UUID."""
    if how == "idpf":
        key, n = hashlib.sha1(re.sub(r"[\x20\x09\x0D\x0A]", "", identifier).encode()).digest(), 1040
    else:
        digits = re.sub("[^0-9A-Fa-f]", "", identifier.removeprefix("urn:uuid:"))
        if len(digits) != 32:
            return None
        key, n = bytes.fromhex(digits), 1024
    head = bytes(c ^ key[i % len(key)] for i, c in enumerate(body[:n]))
    return head + body[n:]


# Elements that a line doesn't run through.
BLOCKS = frozenset("address article aside blockquote body br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())


def xhtml_text(root: ET.Element) -> str:
    """Text with white space collapsed; what head, script and style have doesn't count."""
    parts: list[str] = []
    work: list[Any] = [root]
    while work:
        e = work.pop()
        if isinstance(e, str):
            parts.append(re.sub(r"\s+", " ", e) if e != "\n" else "\n")
            continue
        if local(e.tag) in ("head", "script", "style", "") :
            continue
        block = local(e.tag) in BLOCKS
        order: list[Any] = (["\n"] if block else []) + ([e.text] if e.text else [])
        for c in e:
            order += [c] + ([c.tail] if c.tail else [])
        work += reversed(order + (["\n"] if block else []))
    lines = (re.sub(" +", " ", x).strip() for x in "".join(parts).split("\n"))
    return "\n".join(x for x in lines if x)


def _viewport(root: ET.Element) -> dict[str, float] | None:
    for e in root.iter():
        if local(e.tag) == "meta" and (e.get("name") or "").lower() == "viewport":
            found = dict(re.findall(r"(width|height)\s*=\s*([0-9.]+)", e.get("content") or ""))
            if len(found) == 2:
                return {k: float(v) for k, v in found.items()}
    return None


# Fixed documents.


class Package:
    """An XPS: content types, relationships, and fixed pages in order."""

    def __init__(self, a: Archive):
        self.archive, self.defaults, self.overrides = a, {}, {}
        root = self._xml("[Content_Types].xml")
        for e in root if root is not None else ():
            if local(e.tag) == "Default":
                self.defaults[(e.get("Extension") or "").lower()] = e.get("ContentType")
            elif local(e.tag) == "Override":
                self.overrides[(e.get("PartName") or "").lower()] = e.get("ContentType")

    def _xml(self, name: str) -> ET.Element | None:
        body = self.archive.get(name.lstrip("/"))
        try:
            return parse_xml(body) if body is not None else None
        except XmlRefused:
            return None

    def media_type(self, part: str) -> str | None:
        return self.overrides.get(part.lower()) or self.defaults.get(part.rsplit(".", 1)[-1].lower())

    def relationships(self, part: str = "") -> list[dict[str, str]]:
        folder, _, file = part.rpartition("/")
        root = self._xml(f"{folder}/_rels/{file}.rels")
        return [{"id": e.get("Id") or "", "type": e.get("Type") or "", "target": e.get("Target") or "", "external": e.get("TargetMode") == "External"} for e in (root if root is not None else ()) if local(e.tag) == "Relationship"]

    def sequence(self) -> str | None:
        return next(("/" + (resolve("", r["target"]) or "") for r in self.relationships() if r["type"].endswith("/fixedrepresentation")), None)

    def pages(self) -> Iterator[dict[str, Any]]:
        """Pages in points with their runs of text."""
        number = 0
        for document in self._children(self.sequence(), "DocumentReference"):
            for path in self._children(document, "PageContent"):
                root = self._xml(path)
                runs, shapes = [], []
                for g in root.iter() if root is not None else ():
                    if local(g.tag) == "Path" and g.get("Data"):
                        shapes.append({"data": g.get("Data"), "fill": g.get("Fill"), "stroke": g.get("Stroke"), "thickness": _points(g.get("StrokeThickness")) or 0.75})
                    if local(g.tag) == "Glyphs" and (text := g.get("UnicodeString")):
                        runs.append({"x": _points(g.get("OriginX")), "y": _points(g.get("OriginY")), "size": _points(g.get("FontRenderingEmSize")), "text": text[2:] if text.startswith("{}") else text})
                yield {"page": number, "part": path, "width": _points(root.get("Width")) if root is not None else None, "height": _points(root.get("Height")) if root is not None else None, "runs": runs, "shapes": shapes}
                number += 1

    def _children(self, part: str | None, tag: str) -> list[str]:
        root = self._xml(part) if part else None
        return ["/" + (resolve(part.lstrip("/"), e.get("Source") or "") or "") for e in root.iter() if local(e.tag) == tag] if root is not None else []


def _points(value: str | None) -> float | None:
    """Units of a 96th of an inch."""
    try:
        return float(value) * 0.75
    except (TypeError, ValueError):
        return None


def indices(text: str) -> list[dict[str, Any]]:
    """Glyph indices of a run: (clusters:glyphs)glyph,advance,u,v; separated by semicolons."""
    out = []
    for part in text.split(";"):
        m = re.fullmatch(r"(?:\((\d+)(?::(\d+))?\))?(\d*)(?:,([^,]*))?(?:,([^,]*))?(?:,([^,]*))?", part.strip())
        number = lambda s: float(s) if s else None
        try:
            out.append({"codes": int(m[1] or 1), "glyphs": int(m[2] or 1), "glyph": int(m[3]) if m[3] else None, "advance": number(m[4]), "u": number(m[5]), "v": number(m[6])})
        except (TypeError, ValueError):
            return []
    return out


def odttf(name: str, body: bytes) -> bytes | None:
    """A font obfuscated by the GUID of its name: the first 32 bytes XOR the GUID backwards."""
    digits = re.sub("[^0-9A-Fa-f]", "", name.rsplit("/", 1)[-1].rsplit(".", 1)[0])
    if len(digits) != 32:
        return None
    key = bytes.fromhex(digits)[::-1]
    return bytes(c ^ key[i % 16] for i, c in enumerate(body[:32])) + body[32:]


# Tables.


def _entries(a: Archive) -> Iterator[dict[str, Any]]:
    for e in a.entries:
        yield {"idx": e.index, "name": e.name, "method": e.method, "header_offset": e.header_offset, "compressed": e.compressed, "uncompressed": e.uncompressed, "crc": e.crc, "encrypted": e.encrypted, "defect": a.read(e)[1], "scanned": a.scanned}


def _kind(a: Archive) -> str:
    names = set(a.by_name)
    if any(r["type"].endswith("/fixedrepresentation") for r in Package(a).relationships()):
        return "xps"
    return "epub" if "META-INF/container.xml" in names else "comic" if next(comic_pages(a), None) else "zip"


def _inventory(a: Archive) -> Iterator[dict[str, Any]]:
    kind, book = _kind(a), None
    if kind == "epub":
        book = Book(a)
    yield {"kind": kind, "entries": len(a.entries), "scanned": a.scanned, "metadata": book.metadata if book else {}, "unique_id": book.unique_id if book else None, "spine_items": len(book.spine) if book else None, "defects": book.defects if book else []}


TABLES: dict[str, tuple[str, Callable[[Archive], Any]]] = {
    "archives": ("kind string, entries int, scanned boolean, metadata map<string,string>, unique_id string, spine_items int, defects array<string>", _inventory),
    "entries": ("idx int, name string, method string, header_offset long, compressed long, uncompressed long, crc long, encrypted boolean, defect string, scanned boolean", _entries),
    "comic_pages": ("page int, entry string, format string, defect string, length long", comic_pages),
    "chapters": ("seq int, idref string, path string, linear boolean, layout string, text string, viewport struct<width:double,height:double>", lambda a: Book(a).chapters()),
    "navigation": ("depth int, title string, path string, fragment string", lambda a: Book(a).navigation()),
    "fixed_pages": ("page int, part string, width double, height double, runs array<struct<x:double,y:double,size:double,text:string>>, shapes array<struct<data:string,fill:string,stroke:string,thickness:double>>", lambda a: Package(a).pages()),
}


def read(files: DataFrame, table: str, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """(id_col, ..., error) of a table of TABLES. What isn't an archive gives no rows; damage gives rows with their defects.

    error is null, but in a last row of a file whose rows ended early: that row has the kind of error and nothing else.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    columns, make = TABLES[table]
    columns += ", error string"
    id_type = dict(files.dtypes)[id_col]
    schema = to_arrow_schema(files.sparkSession.createDataFrame([], f"id {id_type}, {columns}").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict[str, Any]] = []
        for batch in batches:
            for doc_id, content in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    a = Archive(content.as_py() or b"")
                    if a.entries:
                        for row in make(a):
                            rows.append({"id": doc_id.as_py(), **row})
                            if len(rows) >= 5000:
                                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                                rows = []
                except (ValueError, TypeError, KeyError, IndexError, AttributeError, struct.error, RecursionError) as e:
                    rows.append({"id": doc_id.as_py(), "error": f"{type(e).__name__}: {e}"[:200]})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    rows = files.select(F.col(id_col).alias("id"), F.col(content_col).alias("content"))
    return rows.mapInArrow(run, f"id {id_type}, {columns}").withColumnRenamed("id", id_col)
