"""A file's objects: cross-references of every revision, object streams, repair, and decoded streams."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from typing import Any, NamedTuple

from docloom.sources.pdf import filters
from docloom.sources.pdf.crypto import Handler
from docloom.sources.pdf.objects import Keyword, Name, Parser, Ref, Stream, Warnings

MAX_REVISIONS = 512
MAX_HOPS = 32
_OBJ = re.compile(rb"(?<![0-9])(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+obj(?![a-z])")
#: A line of a table of cross-references, and the beginning of an object, as nearly all are.
_LINE = re.compile(rb"[\x00\t\n\x0c\r ]*(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+([a-z]+)(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_LINES = re.compile(rb"(?:\d{10} \d{5} [fn][ \r\n]{2})*")
_HEAD = re.compile(rb"[\x00\t\n\x0c\r ]*(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,10})[\x00\t\n\x0c\r ]+obj(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])[\x00\t\n\x0c\r ]*+")


#: Numbers of a table of cross-references by their width.
_CODES = {1: "B", 2: "H", 4: "I", 8: "Q"}


class Entry(NamedTuple):
    """Where an object is: at a file offset, or number `index` in an object stream; free ones have kind free."""

    kind: str
    offset: int
    gen: int
    index: int
    revision: int


class Section(NamedTuple):
    """Entries of objects one after the other as they stand in a file, each read when it is asked for."""

    numbers: range
    at: int  # of the first one in the data, or in the rows of a stream
    rows: tuple[bytes, struct.Struct] | None
    revision: int

    def entry(self, num: int, data: bytes) -> Entry:
        i = num - self.numbers.start
        if self.rows is None:
            at = self.at + 20 * i
            return Entry("offset" if data[at + 17] == 0x6E else "free", int(data[at : at + 10]), int(data[at + 11 : at + 16]), 0, self.revision)
        a, b, c = self.rows[1].unpack_from(self.rows[0], self.at + self.rows[1].size * i)
        return Entry("offset", b, c, 0, self.revision) if a == 1 else Entry("packed", b, 0, c, self.revision) if a == 2 else Entry("free", b, c, 0, self.revision)


class Document:
    """Opens what it can: by its cross-references, and by a scan for objects where those fail."""

    def __init__(self, data: bytes):
        self.data, self.warnings = data, Warnings()
        self.sections: list[Section | tuple[int, Entry]] = []  # in the order that they were read in, the newest first
        self._xref: dict[int, Entry] = {}
        self._merged = 0  # sections that _xref has
        self.trailer: dict[str, Any] = {}
        self.revisions: list[int] = []
        self.cache: dict[int, Any] = {}
        self.containers: dict[int, tuple[bytes, dict[int, int]]] = {}
        self.fonts: dict[int, tuple[Any, Any]] = {}  # what interpreters made of font dictionaries, with those
        self.loading: set[int] = set()
        self.handler: Handler | None = None
        head = data[:1024].find(b"%PDF-")
        self.opened = head >= 0
        self.shift = max(0, head)
        self.repaired = False
        if not self._read_xref() or not isinstance(self.get(self.trailer.get("Root")), dict):
            self._repair()
        self._start_security()

    # Cross-references.

    @property
    def all_entries(self) -> list[tuple[int, Entry]]:
        """Those of all revisions."""
        return self._entries(self.sections)

    @property
    def xref(self) -> dict[int, Entry]:
        """The newest entry of each object, or what repair made of them."""
        if self._merged < len(self.sections):
            for num, entry in self._entries(self.sections[self._merged :]):
                self._xref.setdefault(num, entry)
            self._merged = len(self.sections)
        return self._xref

    def _entries(self, sections: list[Section | tuple[int, Entry]]) -> list[tuple[int, Entry]]:
        return [pair for s in sections for pair in ([(num, s.entry(num, self.data)) for num in s.numbers] if isinstance(s, Section) else [s])]

    def _entry(self, num: int) -> Entry | None:
        """One of xref; the others aren't read for it."""
        if self._merged == len(self.sections) or len(self.sections) > 8:
            return self.xref.get(num)
        for s in self.sections:
            if not isinstance(s, Section):
                if s[0] == num:
                    return s[1]
            elif num in s.numbers:
                return s.entry(num, self.data)
        return None

    def _read_xref(self) -> bool:
        at = self.data.rfind(b"startxref", max(0, len(self.data) - 65536))
        if at < 0:
            self.warnings.add("startxref missing")
            return False
        start = Parser(self.data, at + 9).parse(refs=False)
        queue, seen = [start], set()
        while queue and len(seen) < MAX_REVISIONS:
            offset = queue.pop(0)
            if not isinstance(offset, int) or offset in seen:
                continue
            seen.add(offset)
            trailer = self._section(offset, len(self.revisions)) or (self._section(offset + self.shift, len(self.revisions)) if self.shift else None)
            if trailer is None:
                self.warnings.add("cross-references unreadable")
                return False
            self.revisions.append(offset)
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)  # the newest counts
            queue += [x for x in (trailer.get("XRefStm"), trailer.get("Prev")) if x is not None]
        return any(not isinstance(s, Section) or len(s.numbers) > 0 for s in self.sections)

    def _section(self, offset: int, revision: int) -> dict[str, Any] | None:
        if not 0 <= offset < len(self.data):
            return None
        p = Parser(self.data, offset, self.warnings)
        first = p.parse(refs=False)
        if first == "xref" and isinstance(first, Keyword):
            return self._table(p, revision)
        if isinstance(first, int):
            found = self._object_at(offset)
            if found and isinstance(found[2], Stream) and found[2].dict.get("Type") == "XRef":
                return self._xref_stream(found[2], revision)
        return None

    def _table(self, p: Parser, revision: int) -> dict[str, Any] | None:
        while True:
            start = p.parse(refs=False)
            if isinstance(start, Keyword):
                if start != "trailer":
                    return None
                trailer = p.parse()
                return trailer if isinstance(trailer, dict) else None
            count = p.parse(refs=False)
            if not isinstance(start, int) or not isinstance(count, int):
                return None
            p.skip()
            end = p.pos + 20 * max(0, min(count, 1 << 22))
            if _LINES.fullmatch(p.data, p.pos, min(end, len(p.data))) and end <= len(p.data):  # lines of the one length that they ought to have
                self._add_section(Section(range(start, start + (end - p.pos) // 20), p.pos, None, revision))
                p.pos = end
                continue
            for num in range(start, start + min(count, 1 << 22)):
                if m := _LINE.match(p.data, p.pos):
                    p.pos = m.end()
                    self._add(num, Entry("offset" if m[3] == b"n" else "free", int(m[1]), int(m[2]), 0, revision))
                    continue
                offset, gen = p.parse(refs=False), p.parse(refs=False)
                if not isinstance(offset, int) or not isinstance(gen, int):
                    return None
                kind = p.parse(refs=False)
                self._add(num, Entry("offset" if kind == "n" else "free", offset, gen, 0, revision))

    def _xref_stream(self, stream: Stream, revision: int) -> dict[str, Any]:
        d, data = stream.dict, self._unfiltered(stream)
        widths = [w if isinstance(w, int) and 0 <= w <= 8 else 0 for w in (d.get("W") or [])][:3]
        size = sum(widths)
        index = d.get("Index") or [0, d.get("Size", 0)]
        if len(widths) == 3 and all(w in _CODES for w in widths):
            rows, at, total = struct.Struct(">" + "".join([_CODES[w] for w in widths])), 0, len(data) // size
            for start, count in zip(index[::2], index[1::2], strict=False):
                numbers = range(start, start + max(0, min(count, total - at)))
                self._add_section(Section(numbers, at * size, (data, rows), revision))
                at += len(numbers)
            return d
        at = 0
        ends = [sum(widths[:k]) for k in range(4)]
        for start, count in zip(index[::2], index[1::2], strict=False):
            for num in range(start, start + count):
                row = data[at : at + size]
                if not size or len(row) < size:
                    break
                at += size
                a, b, c = (int.from_bytes(row[i:j], "big") for i, j in zip(ends, ends[1:], strict=False))
                kind = a if widths[0] else 1
                self._add(num, Entry("offset", b, c, 0, revision) if kind == 1 else Entry("packed", b, 0, c, revision) if kind == 2 else Entry("free", b, c, 0, revision))
        return d

    def _add(self, num: int, entry: Entry) -> None:
        self.sections.append((num, entry))

    def _add_section(self, section: Section) -> None:
        self.sections.append(section)

    def _repair(self) -> None:
        """All objects that a scan finds, the last of a number counting, and the trailers on the way."""
        self.warnings.add("repaired")
        self.repaired = True
        self.cache.clear()
        self._xref, self._merged = {}, len(self.sections)
        end = 0
        for m in _OBJ.finditer(self.data):
            if m.start() < end:
                continue
            self.xref[int(m[1])] = Entry("offset", m.start(), int(m[2]), 0, 0)
            at = self.data.find(b"stream", m.end(), m.end() + 65536)
            stop = self.data.find(b"endobj", m.end())
            if 0 <= at < stop:  # what stands in a stream is no object
                done = self.data.find(b"endstream", at)
                end = done if done >= 0 else m.end()
        for m in re.finditer(rb"trailer", self.data):
            d = Parser(self.data, m.end(), self.warnings).parse()
            if isinstance(d, dict):
                self.trailer |= {k: v for k, v in d.items() if v is not None}
        packed: list[tuple[int, Any]] = []
        for num in list(self.xref):
            value = self.get(Ref(num))
            if isinstance(value, Stream) and value.dict.get("Type") == "ObjStm":
                packed += [(num, i, n) for i, n in enumerate(self._members(num)[1])]
            elif isinstance(value, Stream) and value.dict.get("Type") == "XRef":
                for k in ("Root", "Info", "Encrypt", "ID"):
                    if k in value.dict:
                        self.trailer[k] = value.dict[k]
        for container, i, n in packed:
            self.xref.setdefault(n, Entry("packed", container, 0, i, 0))
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            for num in self.xref:
                value = self.get(Ref(num))
                if isinstance(value, dict) and value.get("Type") == "Catalog":
                    self.trailer["Root"] = Ref(num)

    # Objects.

    def get(self, value: Any) -> Any:
        """What a reference leads to; null where nothing is, and where references run in a circle."""
        if type(value) is not Ref:
            return value
        for _ in range(MAX_HOPS):
            if type(value) is not Ref:
                return value
            value = self._load(value.num)
        self.warnings.add("references in a circle")
        return None

    def _load(self, num: int) -> Any:
        if num in self.cache:
            return self.cache[num]
        entry = self._entry(num)
        if entry is None or entry.kind == "free" or num in self.loading:
            return None
        self.loading.add(num)
        try:
            value = None
            if entry.kind == "offset":
                found = self._object_at(entry.offset) or (self._object_at(entry.offset + self.shift) if self.shift else None)
                if found and found[0] == num:
                    value = self._decrypted(found[2], num, found[1])
                elif not self.repaired and entry.offset:
                    self.warnings.add("object not at its offset")
                    value = self._find(num)
            else:
                data, places = self._members(entry.offset)
                if num in places:
                    value = Parser(data, places[num], self.warnings).parse()
                    value = None if isinstance(value, Keyword) else value
            self.cache[num] = value
            return value
        finally:
            self.loading.discard(num)

    def _find(self, num: int) -> Any:
        last = None
        for m in re.finditer(rb"(?<![0-9])%d[\x00\t\n\x0c\r ]+\d{1,5}[\x00\t\n\x0c\r ]+obj" % num, self.data):
            last = m.start()
        found = self._object_at(last) if last is not None else None
        return self._decrypted(found[2], num, found[1]) if found else None

    def _object_at(self, offset: int) -> tuple[int, int, Any] | None:
        p = Parser(self.data, offset, self.warnings)
        if m := _HEAD.match(self.data, max(0, offset)):
            p.pos = m.end()
            num, gen, word = int(m[1]), int(m[2]), Keyword("obj")
        else:
            num, gen, word = p.parse(refs=False), p.parse(refs=False), p.parse(refs=False)
        if not (isinstance(num, int) and isinstance(gen, int) and word == "obj" and isinstance(word, Keyword)):
            return None
        value = p.parse()
        if isinstance(value, Keyword):
            return num, gen, None
        if isinstance(value, dict) and not self.data.startswith(b"\nendobj", p.pos):
            p.skip()
            if self.data[p.pos : p.pos + 6] == b"stream":
                return num, gen, self._stream(value, p.pos + 6, num, gen)
        return num, gen, value

    def _stream(self, d: dict[str, Any], at: int, num: int, gen: int) -> Stream:
        at += 2 if self.data[at : at + 2] == b"\r\n" else self.data[at : at + 1] in (b"\n", b"\r")
        length = d.get("Length")
        length = self.get(length) if isinstance(length, Ref) and length.num not in self.loading else length
        if isinstance(length, int) and 0 <= length and self.data[at + length : at + length + 20].lstrip().startswith(b"endstream"):
            return Stream(d, self.data[at : at + length], (num, gen))
        self.warnings.add("stream length")
        end = self.data.find(b"endstream", at)
        end = len(self.data) if end < 0 else end
        raw = self.data[at:end]
        return Stream(d, raw[:-2] if raw.endswith(b"\r\n") else raw[:-1] if raw.endswith((b"\n", b"\r")) else raw, (num, gen))

    def _members(self, num: int) -> tuple[bytes, dict[int, int]]:
        """An object stream's bytes, and where each object is in them; none is read before it is asked for."""
        if num not in self.containers:
            self.containers[num] = b"", {}
            stream = self.get(Ref(num))
            if isinstance(stream, Stream):
                data, first, count = self.decoded(stream)[0], stream.dict.get("First"), stream.dict.get("N")
                numbers = self._numbers(data, first, 2 * count) if isinstance(count, int) and count < 1 << 20 else []
                places: dict[int, int] = {}
                for n, at in zip(numbers[::2], numbers[1::2], strict=True):
                    if isinstance(n, int) and isinstance(at, int) and isinstance(first, int):
                        places.setdefault(n, first + at)
                self.containers[num] = data, places
        return self.containers[num]

    def _numbers(self, data: bytes, end: Any, count: int) -> list[Any]:
        """The first numbers of a buffer; where nothing but short ones stand before `end`, they are read together."""
        if isinstance(end, int) and 0 < end <= len(data) and data[end - 1] in b"\n " and not data[:end].translate(None, b"0123456789\n "):
            parts = data[:end].split()
            if len(parts) >= count >= 0 and max(map(len, parts), default=0) <= 9:
                return list(map(int, parts[:count]))
        head = Parser(data, 0, self.warnings)
        return [head.parse(refs=False) for _ in range(count)]

    def _unfiltered(self, stream: Stream) -> bytes:
        return filters.apply(stream.raw, filters.chain(stream.dict.get("Filter"), stream.dict.get("DecodeParms")))[0]

    # Streams and strings.

    def raw(self, stream: Stream) -> bytes:
        """Decrypted, with its filters on."""
        if self.handler is None or stream.at is None or stream.dict.get("Type") in ("XRef",):
            return stream.raw
        return self.handler.decrypt(stream.raw, *stream.at, True)

    def decoded(self, stream: Stream) -> tuple[bytes, str | None]:
        """(bytes, the image codec or unknown filter that they are still in)."""
        names = self.get(stream.dict.get("Filter"))
        names = [self.get(n) for n in names] if isinstance(names, list) else names
        parms = self.get(stream.dict.get("DecodeParms", stream.dict.get("DP")))
        parms = [self._deep(p) for p in parms] if isinstance(parms, list) else self._deep(parms)
        out, codec, warnings = filters.apply(self.raw(stream), filters.chain(names, parms))
        for w in warnings:
            self.warnings.add(w)
        return out, codec

    def _deep(self, value: Any) -> Any:
        value = self.get(value)
        return {k: self.get(v) for k, v in value.items()} if isinstance(value, dict) else value

    def _decrypted(self, value: Any, num: int, gen: int) -> Any:
        if self.handler is None or self.handler.key is None:
            return value
        if isinstance(value, bytes):
            return self.handler.decrypt(value, num, gen, False)
        if isinstance(value, dict):
            return {k: self._decrypted(v, num, gen) for k, v in value.items()}
        if isinstance(value, list):
            return [self._decrypted(v, num, gen) for v in value]
        if isinstance(value, Stream):
            return Stream(self._decrypted(value.dict, num, gen), value.raw, (num, gen))
        return value

    # Security.

    def _start_security(self) -> None:
        d = self._deep(self.trailer.get("Encrypt"))
        if isinstance(d, dict):
            ids = self.get(self.trailer.get("ID"))
            file_id = self.get(ids[0]) if isinstance(ids, list) and ids else b""
            d["CF"] = {k: self._deep(v) for k, v in (d.get("CF") or {}).items()}
            self.handler = Handler.of(d, file_id if isinstance(file_id, bytes) else b"")
            if self.handler:
                self.authenticate("")

    @property
    def encrypted(self) -> bool:
        return self.trailer.get("Encrypt") is not None

    def authenticate(self, password: str) -> str:
        """none, user or owner."""
        if self.handler is None:
            return "none"
        level = self.handler.authenticate(password)
        self.cache.clear()
        self.containers.clear()
        return level

    @property
    def readable(self) -> bool:
        return self.opened and (not self.encrypted or self.handler is not None and self.handler.key is not None)

    # Structure.

    def catalog(self) -> dict[str, Any]:
        root = self.get(self.trailer.get("Root"))
        return root if isinstance(root, dict) else {}

    def version(self) -> str:
        """The later of the header's and the catalog's, compared as numbers."""
        found = re.search(rb"%PDF-(\d+)\.(\d+)", self.data[:1024])
        own = re.fullmatch(r"(\d+)\.(\d+)", str(self.get(self.catalog().get("Version")) or ""))
        pairs = [(int(m[1]), int(m[2])) for m in (found, own) if m]
        return "%d.%d" % max(pairs) if pairs else ""

    def pages(self) -> list[tuple[Ref | None, dict[str, Any]]]:
        """Leaves in order, with what they inherit; nodes that were seen are passed over."""
        inherited = ("MediaBox", "CropBox", "Rotate", "Resources")
        out: list[tuple[Ref | None, dict[str, Any]]] = []
        work: list[tuple[Any, dict[str, Any]]] = [(self.catalog().get("Pages"), {})]
        seen: set[Ref] = set()
        while work:
            at, above = work.pop()
            if isinstance(at, Ref):
                if at in seen:
                    self.warnings.add("page tree in a circle")
                    continue
                seen.add(at)
            node = self.get(at)
            if not isinstance(node, dict):
                continue
            own = above | {k: node[k] for k in inherited if node.get(k) is not None}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list) and node.get("Type") != "Page":
                work += [(k, own) for k in reversed(kids)]
            else:
                out.append((at if isinstance(at, Ref) else None, own | node))
        if not out:
            for num in sorted(self.xref):
                node = self.get(Ref(num))
                if isinstance(node, dict) and node.get("Type") == "Page":
                    out.append((Ref(num), node))
        return out

    def box(self, page: dict[str, Any], key: str) -> tuple[float, float, float, float] | None:
        values = self.get(page.get(key))
        values = [self.get(v) for v in values] if isinstance(values, list) else []
        if len(values) < 4 or not all(isinstance(v, (int, float)) for v in values[:4]):
            return None
        x0, y0, x1, y1 = map(float, values[:4])
        return min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)

    def boxes(self, page: dict[str, Any]) -> tuple[tuple[float, float, float, float], tuple[float, float, float, float]]:
        """(media box, or US Letter without one; crop box within it)."""
        media = self.box(page, "MediaBox") or (0.0, 0.0, 612.0, 792.0)
        crop = self.box(page, "CropBox") or media
        cut = max(media[0], crop[0]), max(media[1], crop[1]), min(media[2], crop[2]), min(media[3], crop[3])
        return media, cut if cut[0] < cut[2] and cut[1] < cut[3] else media

    def rotation(self, page: dict[str, Any]) -> int:
        r = self.get(page.get("Rotate"))
        return int((r % 360 + 45) // 90 % 4 * 90) if isinstance(r, (int, float)) else 0

    def contents(self, page: dict[str, Any]) -> bytes:
        parts = self.get(page.get("Contents"))
        parts = parts if isinstance(parts, list) else [parts]
        return b"\n".join(self.decoded(s)[0] for s in map(self.get, parts) if isinstance(s, Stream))

    def objects(self) -> Iterator[tuple[int, Entry, Any]]:
        for num in sorted(self.xref):
            if self.xref[num].kind != "free":
                yield num, self.xref[num], self.get(Ref(num))

    def name_tree(self, root: Any, numbers: bool = False) -> list[tuple[Any, Any]]:
        """Keys and values of a name or number tree in order."""
        key = "Nums" if numbers else "Names"
        out: list[tuple[Any, Any]] = []
        work, seen = [root], set()
        while work and len(out) < 1 << 20:
            at = work.pop()
            if isinstance(at, Ref):
                if at in seen:
                    continue
                seen.add(at)
            node = self.get(at)
            if not isinstance(node, dict):
                continue
            leaf = self.get(node.get(key))
            if isinstance(leaf, list):
                out += [(self.get(k), v) for k, v in zip(leaf[::2], leaf[1::2], strict=False) if isinstance(self.get(k), int if numbers else bytes)]
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                work += reversed(kids)
        return out

    def lookup(self, root: Any, key: bytes | int) -> tuple[Any, int]:
        """(value, nodes read) of a key of a name tree, or of a number tree; subtrees whose limits leave it out aren't read."""
        names = "Names" if isinstance(key, bytes) else "Nums"
        work, seen, read = [root], set(), 0
        while work:
            at = work.pop()
            if isinstance(at, Ref):
                if at in seen:
                    continue
                seen.add(at)
            node = self.get(at)
            if not isinstance(node, dict):
                continue
            read += 1
            limits = self.get(node.get("Limits"))
            if isinstance(limits, list) and len(limits) == 2:
                low, high = (self.get(v) for v in limits)
                if isinstance(low, type(key)) and isinstance(high, type(key)) and not low <= key <= high:
                    continue
            leaf = self.get(node.get(names))
            if isinstance(leaf, list):
                found = next((v for k, v in zip(leaf[::2], leaf[1::2], strict=False) if self.get(k) == key), None)
                if found is not None:
                    return found, read
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                work += reversed(kids)
        return None, read

    def text(self, value: Any) -> str | None:
        """A text string; null for anything else."""
        value = self.get(value)
        return text_string(value) if isinstance(value, bytes) else str(value) if isinstance(value, Name) else None


# PDFDocEncoding where it differs from Latin-1.
_DOC = {0x18 + i: ord(c) for i, c in enumerate("˘ˇˆ˙˝˛˚˜")} | {0x80 + i: ord(c) for i, c in enumerate("•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž�")}


def text_string(raw: bytes) -> str:
    if raw.startswith(b"\xfe\xff"):
        return raw[2:].decode("utf-16-be", "replace")
    if raw.startswith(b"\xef\xbb\xbf"):
        return raw[3:].decode("utf-8", "replace")
    return raw.decode("latin-1").translate(_DOC)
