"""Objects and their syntax. A reader never raises on content: what can't be read is null and leaves a warning."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any, NamedTuple

# White space and delimiters.
WHITE = b"\x00\t\n\x0c\r "
DELIMITERS = b"()<>[]{}/%"
MAX_DEPTH = 128
MAX_ITEMS = 1 << 20
_REGULAR = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]*")
_SPACE = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
_REF = re.compile(rb"[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_NUMBER = re.compile(rb"[+-]*\d*\.?\d*")
_W, _END = rb"[\x00\t\n\x0c\r ]", rb"(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])"
#: The commonest tokens whole, after white space; whatever none of them is goes the long way. Groups: name, number and
#: generation of a reference, integer, real, string.
_TOKENS = [
    re.compile(rb"(?:" + _W + rb"+|%[^\r\n]*)*+(?:/([^\x00\t\n\x0c\r ()<>\[\]{}/%]*)" + ref + rb"|(-?\d{1,9})" + _END + rb"|(-?\d{1,15}\.\d{1,15})" + _END + rb"|\(([^()\\\r]*)\))")
    for ref in (rb"|(\d{1,9})" + _W + rb"+(\d{1,5})" + _W + rb"+R" + _END, rb"|(\b\B)(\b\B)")
]
_NAME, _REFERENCE, _INTEGER, _REAL = 1, 3, 4, 5
#: A bare word, which operators are.
_BARE = re.compile(rb"(?:" + _W + rb"+|%[^\r\n]*)*+([A-Za-z'\"*][^\x00\t\n\x0c\r ()<>\[\]{}/%]*)")
#: The same for what stands in arrays and dictionaries, with where those begin and end, and words; anything else is the last group.
_PIECES = [
    re.compile(rb"(?s:" + _W + rb"*+(?:/([^\x00\t\n\x0c\r ()<>\[\]{}/%]*)" + ref + rb"|(-?\d{1,9})" + _END + rb"|(-?\d{1,15}\.\d{1,15})" + _END + rb"|\(([^()\\\r]*)\)|(<<|\[)|(>>)|(\])|(true|false|null)" + _END + rb"|(\((?:[^()\\\r]|\\[^\r])*+\))|(.)))")
    for ref in (rb"|(\d{1,9})" + _W + rb"+(\d{1,5})" + _W + rb"+R" + _END, rb"|(\b\B)(\b\B)")
]
_TEXT, _OPEN, _CLOSE, _LAST, _WORD, _ESCAPED = 6, 7, 8, 9, 10, 11
_WORDS = {b"true": True, b"false": False, b"null": None}
#: Names that were read or written before, in either form; short ones, and no more than MAX_NAMES.
MAX_NAMES = 4096
_names: dict[bytes, Name] = {}
_written: dict[str, bytes] = {}
_ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}


class Ref(NamedTuple):
    num: int
    gen: int = 0


class Name(str):
    __slots__ = ()


class Keyword(str):
    """An operator or any other bare word."""

    __slots__ = ()


class Written(bytes):
    """An object that is written already. Its references are numbers of the file it goes to."""

    __slots__ = ()


@dataclass
class Stream:
    dict: dict[str, Any]
    raw: bytes
    at: tuple[int, int] | None = None  # the object's number and generation, which key its encryption


@dataclass
class Warnings:
    """Kinds of damage with their counts; a file's first `most` kinds are kept apart."""

    most: int = 64
    found: dict[str, int] = field(default_factory=dict)

    def add(self, kind: str) -> None:
        if kind in self.found or len(self.found) < self.most:
            self.found[kind] = self.found.get(kind, 0) + 1


def _named(raw: bytes) -> Name:
    """The name that is written so."""
    found = _names.get(raw)
    if found is None:
        plain = re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), raw) if b"#" in raw else raw
        found = Name(plain.decode("utf-8", "surrogateescape"))
        if len(raw) <= 32 and len(_names) < MAX_NAMES:
            _names[raw] = found
    return found


@lru_cache(MAX_NAMES)
def _word(raw: bytes) -> Keyword:
    return Keyword(raw.decode("latin-1"))


def _value(m: re.Match[bytes]) -> Any:
    """What a match of _TOKENS stands for."""
    kind = m.lastindex
    if kind == _NAME:
        return _named(m[1])
    if kind == _REFERENCE:
        return Ref(int(m[2]), int(m[3]))
    if kind == _INTEGER:
        return int(m[4])
    return float(m[5]) if kind == _REAL else m[6]


#: Shapes of arrays and dictionaries that came up again and again, by how those begin; no more than MAX_SHAPES.
#: A shape is all of the syntax but numbers and strings: one match reads an object of it.
MAX_SHAPES = 256
_shapes: dict[bytes, list[Any]] = {}
#: Arrays that are one hole of a shape, however long: references and strings, and names of a tree with the places they lead to.
_FLAT = rb"\[((?:(?:\d{1,9} 0 R|\([^()\\\r]*\))(?: (?!\])|(?=\])))*+)\]"
_PLACES = rb"\[((?:\([^()\\\r]*\) \[\d{1,9} 0 R /[A-Za-z]{1,16}\](?: (?!\])|(?=\])))++)\]"
_ARRAYS = [(_FLAT, re.compile(_FLAT), "flat(a%d)"), (_PLACES, re.compile(_PLACES), "places(a%d)")]
_FLAT_ITEM = re.compile(rb"(\d{1,9}) 0 R|\(([^()\\\r]*)\)")
_PLACE = re.compile(rb"\(([^()\\\r]*)\) \[(\d{1,9}) 0 R /([A-Za-z]{1,16})\]")


def _shapes_of(data: bytes, pos: int) -> list[Any] | None:
    """[how many were read the long way, shapes] of what begins like this."""
    key = data[pos : pos + 24].partition(b"(")[0].translate(None, b"0123456789")
    found = _shapes.get(key)
    if found is None and len(_shapes) < MAX_NAMES:
        found = _shapes[key] = [0, []]
    return found


@lru_cache(1 << 14)
def _ref(raw: bytes) -> Ref:
    return Ref(int(raw))


def _flat(raw: bytes) -> list[Ref | bytes]:
    if b"(" not in raw:
        return [_ref(n) for n in raw.split()[::3]]
    return [_ref(n) if n else text for n, text in _FLAT_ITEM.findall(raw)]


def _places(raw: bytes) -> list[Any]:
    return [x for text, n, name in _PLACE.findall(raw) for x in (text, [_ref(n), _named(name)])]


@lru_cache(MAX_NAMES)
def _short_escaped(raw: bytes) -> bytes:
    return Parser(raw)._string()


def _escaped(raw: bytes) -> bytes:
    return _short_escaped(raw) if len(raw) <= 64 else Parser(raw)._string()


def _shape(data: bytes, pos: int, end: int) -> tuple[Callable[..., Any], Callable[..., Any]] | None:
    """(match, what makes the value of its groups) of objects like the one that stands here; null if it isn't worth that."""
    if end - pos > 1 << 14 or sum(len(found) for _, found in _shapes.values()) >= MAX_SHAPES:
        return None
    pattern, source, constants, holes = b"", "", [], 0
    dicts: list[int] = []  # of the containers that are open: how many objects stand in a dictionary, -1 for an array
    while pos < end:
        if len(pattern) > 2048:  # not counting what is in arrays that are one hole
            return None
        m = _PIECES[0].match(data, pos)
        at = m.end() - len(m[0].lstrip(WHITE))
        pattern += re.escape(data[pos:at])
        raw, pos, kind, text = data[at : m.end()], m.end(), m.lastindex, None
        if dicts and kind not in (_CLOSE, _LAST):
            source += "" if source[-1] in "[{" else ":" if dicts[-1] >= 0 and dicts[-1] % 2 else ", "
            dicts[-1] += dicts[-1] >= 0
        if kind == _OPEN and (many := next(((x, end_of.end(), to) for x, array, to in _ARRAYS if (end_of := array.match(data, at))), None)):
            hole, pos, text = many
        elif kind in (_OPEN, _CLOSE, _LAST):
            pattern += re.escape(raw)
            source += {b"<<": "{", b">>": "}"}.get(raw) or raw.decode()
            if kind == _OPEN:
                dicts.append(0 if raw == b"<<" else -1)
            else:
                dicts.pop()
            continue
        elif kind in (_NAME, _WORD):
            pattern += re.escape(raw)
            source += f"k[{len(constants)}]"
            constants.append(_named(m[1]) if kind == _NAME else _WORDS[raw])
            continue
        elif kind == _REFERENCE and raw.endswith(b" 0 R"):
            hole, text = rb"(\d{1,9}) 0 R", "ref(a%d)"
        elif kind == _INTEGER:
            hole, text = rb"(-?\d{1,9})", "int(a%d)"
        elif kind == _REAL:
            hole, text = rb"(-?\d{1,15}\.\d{1,15})", "float(a%d)"
        elif kind == _TEXT:
            hole, text = rb"\(([^()\\\r]*)\)", "a%d"
        elif kind == _ESCAPED:
            hole, text = rb"(\((?:[^()\\\r]|\\[^\r])*+\))", "escaped(a%d)"
        else:
            return None
        pattern += hole
        source += text % holes
        holes += 1
    arguments = ", ".join(f"a{i}" for i in range(holes))
    # No byte of the file stands in the source, only how its arrays and dictionaries nest.
    return re.compile(pattern).match, eval(f"lambda {arguments}: {source}", {"k": constants, "ref": _ref, "flat": _flat, "places": _places, "escaped": _escaped})  # noqa: S307


class Parser:
    """Reads tokens and objects of a buffer from `pos` on."""

    def __init__(self, data: bytes, pos: int = 0, warnings: Warnings | None = None):
        self.data, self.pos = data, pos
        self.warnings = warnings or Warnings()

    def skip(self) -> None:
        self.pos = _SPACE.match(self.data, self.pos).end()

    def parse(self, depth: int = 0, refs: bool = True) -> Any:
        """The next object, a Keyword, or None at the end (and for null); `done` tells the end."""
        if refs and depth == 0 and self.data.startswith(b"<<", self.pos) and (found := self._plain(True)) is not None:
            return found
        if m := _TOKENS[not refs].match(self.data, self.pos):
            self.pos = m.end()
            return _value(m)
        if m := _BARE.match(self.data, self.pos):
            self.pos = m.end()
            raw = m[1]
            return _WORDS[raw] if raw in _WORDS else _word(raw) if len(raw) <= 32 else Keyword(raw.decode("latin-1"))
        self.skip()
        data, pos = self.data, self.pos
        if pos >= len(data):
            return Keyword("")
        c = data[pos]
        if c == 0x2F:
            return self._name()
        if c == 0x28:
            return self._string()
        if c == 0x3C and data[pos + 1 : pos + 2] != b"<":
            return self._hex()
        if c == 0x3C or c == 0x5B:
            found = self._plain(refs) if depth == 0 else None
            return found if found is not None else self._dict(depth, refs) if c == 0x3C else self._array(depth, refs)
        if c in b"+-.0123456789":
            return self._number(refs)
        if c in DELIMITERS:
            if data[pos : pos + 2] == b">>":
                self.pos += 2
                return Keyword(">>")
            self.pos += 1
            return Keyword(chr(c))
        m = _REGULAR.match(data, pos)
        self.pos = m.end()
        word = m.group().decode("latin-1")
        return {"true": True, "false": False, "null": None}.get(word, Keyword(word))

    def _name(self) -> Name:
        m = _REGULAR.match(self.data, self.pos + 1)
        self.pos = m.end()
        return _named(m.group())

    def _number(self, refs: bool) -> Any:
        m = _NUMBER.match(self.data, self.pos)
        text = m.group()
        if m.end() == self.pos:
            self.pos += 1
            return 0
        self.pos = m.end()
        rest = _REGULAR.match(self.data, self.pos)
        if rest.end() > self.pos:  # junk such as an exponent goes with the number
            self.warnings.add("number")
            self.pos = rest.end()
        sign = -1 if text.lstrip(b"+")[:1] == b"-" else 1
        digits = text.lstrip(b"+-")
        if b"." in digits:
            try:
                return sign * float(digits)
            except ValueError:
                self.warnings.add("number")
                return 0
        if not digits:
            self.warnings.add("number")
            return 0
        value = max(-(1 << 63), min((1 << 63) - 1, sign * int(digits[:40])))
        if refs and sign > 0 and (ref := _REF.match(self.data, self.pos)) and value < 1 << 32:
            self.pos = ref.end()
            return Ref(value, int(ref[1]))
        return value

    def _string(self) -> bytes:
        data, pos, depth, out = self.data, self.pos + 1, 1, bytearray()
        while pos < len(data):
            c = data[pos]
            pos += 1
            if c == 0x28:
                depth += 1
            elif c == 0x29:
                depth -= 1
                if not depth:
                    break
            elif c == 0x5C:
                e = data[pos] if pos < len(data) else 0
                pos += 1
                if e in _ESCAPES:
                    out.append(_ESCAPES[e])
                elif 0x30 <= e <= 0x37:
                    n = re.compile(rb"[0-7]{1,3}").match(data, pos - 1)
                    pos = n.end()
                    out.append(int(n.group(), 8) & 255)
                elif e == 13:
                    pos += data[pos : pos + 1] == b"\n"
                elif e != 10:
                    out.append(e)
                continue
            elif c == 13:
                pos += data[pos : pos + 1] == b"\n"
                c = 10
            out.append(c)
        else:
            self.warnings.add("string without end")
        self.pos = pos
        return bytes(out)

    def _hex(self) -> bytes:
        end = self.data.find(b">", self.pos)
        if end < 0:
            self.warnings.add("string without end")
            end = len(self.data)
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", self.data[self.pos + 1 : end])
        self.pos = end + 1
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def _plain(self, refs: bool) -> list | dict | None:
        """An array or dictionary in which all is as it should be and common; null, and nothing read, for any other."""
        start = self.pos
        known = _shapes_of(self.data, start) if refs else None
        for i, shape in enumerate(known[1] if known else ()):
            if m := shape[0](self.data, start):
                if i > 2:  # those that come up are tried first
                    known[1].insert(0, known[1].pop(i))
                self.pos = m.end()
                return shape[1](*m.groups())
        work: list[list] = []
        items: list = []
        for m in _PIECES[not refs].finditer(self.data, self.pos):
            kind = m.lastindex
            if kind == _NAME:
                raw = m[1]
                found = _names.get(raw)
                items.append(_named(raw) if found is None else found)
            elif kind == _REFERENCE:
                items.append(Ref(int(m[2]), int(m[3])))
            elif kind == _INTEGER:
                items.append(int(m[4]))
            elif kind == _TEXT:
                items.append(m[6])
            elif kind == _OPEN:
                work.append(items)
                items = [m[7]]
                if len(work) >= MAX_DEPTH:
                    return None
            elif kind == _CLOSE or kind == _LAST:
                if (items[0] == b"<<") != (kind == _CLOSE) or len(items) > 4096:
                    return None
                if kind == _CLOSE:
                    keys = items[1::2]
                    value: list | dict = dict(zip(keys, items[2::2], strict=False))
                    # The first of repeated keys counts; that and keys that are none go the long way.
                    if len(items) % 2 == 0 or len(value) < len(keys) or any(type(k) is not Name for k in keys):
                        return None
                else:
                    del items[0]
                    value = items
                items = work.pop()
                if not work:
                    self.pos = m.end()
                    if known:
                        known[0] += 1
                        if known[0] % 4 == 0 and len(known[1]) < 16 and (shape := _shape(self.data, start, self.pos)):
                            known[1].append(shape)
                    return value
                items.append(value)
            elif kind == _REAL:
                items.append(float(m[5]))
            elif kind == _WORD:
                items.append(_WORDS[m[10]])
            elif kind == _ESCAPED:
                items.append(_escaped(m[11]))
            else:
                return None
        return None

    def _array(self, depth: int, refs: bool) -> list:
        self.pos += 1
        out: list = []
        token, data = _TOKENS[not refs].match, self.data
        while depth < MAX_DEPTH and len(out) < MAX_ITEMS:
            if m := token(data, self.pos):
                self.pos = m.end()
                out.append(_value(m))
                continue
            item = self.parse(depth + 1, refs)
            if isinstance(item, Keyword):
                if item == "]":
                    return out
                if item in ("", ">>", "endobj", "stream"):
                    break
                self.warnings.add("stray word")
                continue
            out.append(item)
        self.warnings.add("array without end")
        return out

    def _dict(self, depth: int, refs: bool) -> dict:
        self.pos += 2
        out: dict[str, Any] = {}
        token, data = _TOKENS[not refs].match, self.data
        while depth < MAX_DEPTH and len(out) < 4096:
            if (m := token(data, self.pos)) and m.lastindex == _NAME:
                self.pos = m.end()
                key = _named(m[1])
                if m := token(data, self.pos):
                    self.pos = m.end()
                    if key not in out:
                        out[key] = _value(m)
                    continue
            else:
                key = self.parse(depth + 1, refs)
            if isinstance(key, Keyword):
                if key == ">>":
                    return out
                if key in ("", "endobj", "stream", "]"):
                    break
                continue
            if not isinstance(key, Name):
                self.warnings.add("key that is no name")
                continue
            value = self.parse(depth + 1, refs)
            if isinstance(value, Keyword):
                out.setdefault(key, None)
                if value == ">>":
                    return out
                continue
            out.setdefault(key, value)  # the first of repeated keys counts
        self.warnings.add("dictionary without end")
        return out


def _name(value: str) -> bytes:
    found = _written.get(value)
    if found is None:
        raw = value.encode("utf-8", "surrogateescape")
        found = b"/" + b"".join(bytes([c]) if 0x21 <= c <= 0x7E and c not in DELIMITERS + b"#" else b"#%02X" % c for c in raw)
        if len(value) <= 32 and len(_written) < MAX_NAMES:
            _written[value] = found
    return found


def _real(value: float) -> bytes:
    text = f"{value:.6f}".rstrip("0").rstrip(".")
    return (text if text not in ("-0", "") else "0").encode()


def _string(value: bytes) -> bytes:
    return b"(" + (_UNSAFE.sub(lambda m: {b"\r": b"\\r", b"\n": b"\\n"}.get(m[0], b"\\" + m[0]), value) if _UNSAFE.search(value) else value) + b")"


def _list(value: list | tuple) -> bytes:
    return b"[" + b" ".join([write(x) for x in value]) + b"]"


def _mapping(value: dict[str, Any]) -> bytes:
    return b"<<" + b" ".join([_name(k) + b" " + write(v) for k, v in value.items()]) + b">>"


_UNSAFE = re.compile(rb"[\\()\r\n]")
_WRITERS = {
    Written: lambda v: v, type(None): lambda _: b"null", bool: lambda v: b"true" if v else b"false", Ref: lambda v: b"%d %d R" % v, Name: _name, Keyword: lambda v: v.encode("latin-1"), int: lambda v: b"%d" % v,
    float: _real, bytes: _string, list: _list, tuple: _list, Stream: lambda v: _mapping(v.dict | {"Length": len(v.raw)}) + b"\nstream\n" + v.raw + b"\nendstream", dict: _mapping,
}


def write(value: Any) -> bytes:
    """An object's syntax."""
    to = _WRITERS.get(type(value)) or next((f for kind, f in _WRITERS.items() if isinstance(value, kind)), _mapping)
    return to(value)


#: Holes of a blank: a number, an object that is written already, a reference by its number. In strings: \\0 and what % takes.
NUMBER, WRITTEN, REFERENCE = Keyword("\0d"), Keyword("\0b"), Keyword("\0d 0 R")


def blank(value: Any) -> bytes:
    """The syntax of an object with holes, for % to fill in: what many objects have in common is written once."""
    return write(value).replace(b"%", b"%%").replace(b"\0", b"%")


def blank_stream(d: dict[str, Any]) -> bytes:
    """The same of a stream: its length and its bytes are the last two that % takes."""
    return blank(d | {"Length": NUMBER}) + b"\nstream\n%b\nendstream"


def references(value: Any) -> set[Ref]:
    """All references inside an object."""
    out, work = set(), [value]
    while work:
        v = work.pop()
        if isinstance(v, Ref):
            out.add(v)
        elif isinstance(v, dict):
            work += v.values()
        elif isinstance(v, list):
            work += v
        elif isinstance(v, Stream):
            work.append(v.dict)
    return out


_PLAIN = {type(None), bool, int, float, bytes, str, Name, Keyword, Written}


def renumber(value: Any, to: dict[int, int]) -> Any:
    """The object with its references mapped; those without a number become null."""
    if type(value) is Written:
        return value
    if isinstance(value, Ref):
        return Ref(to[value.num]) if value.num in to else None
    if isinstance(value, dict):
        return {k: v if type(v) in _PLAIN else renumber(v, to) for k, v in value.items()}
    if isinstance(value, list):
        return [v if type(v) in _PLAIN else renumber(v, to) for v in value]
    if isinstance(value, Stream):
        return Stream(renumber(value.dict, to), value.raw)
    return value
