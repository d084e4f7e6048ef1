"""Fonts as far as text needs them: bytes to codes, codes to characters and widths."""

from __future__ import annotations

import functools
import re
import unicodedata
from typing import Any

from docloom.sources.pdf.document import Document
from docloom.sources.pdf.objects import Keyword, Name, Parser, Stream

# StandardEncoding above ASCII, and the two ASCII places where it differs.
STANDARD = {0x27: "’", 0x60: "‘"} | dict(zip(range(0xA1, 0xB0), "¡¢£⁄¥ƒ§¤'“«‹›ﬁﬂ", strict=True)) | dict(zip((0xB1, 0xB2, 0xB3, 0xB4, 0xB6, 0xB7, 0xB8, 0xB9, 0xBA, 0xBB, 0xBC, 0xBD, 0xBF), "–†‡·¶•‚„”»…‰¿", strict=True)) | dict(zip((0xC1, 0xC2, 0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF, 0xD0), "`´ˆ˜¯˘˙¨˚¸˝˛ˇ—", strict=True)) | dict(zip((0xE1, 0xE3, 0xE8, 0xE9, 0xEA, 0xEB, 0xF1, 0xF5, 0xF8, 0xF9, 0xFA, 0xFB), "ÆªŁØŒºæıłøœß", strict=True))
# Glyph names that no rule gives.
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")",
    "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[",
    "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~",
    "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "quotesinglbase": "‚", "quotedblbase": "„", "guillemotleft": "«", "guillemotright": "»",
    "guilsinglleft": "‹", "guilsinglright": "›", "endash": "–", "emdash": "—", "bullet": "•", "ellipsis": "…", "dagger": "†", "daggerdbl": "‡", "perthousand": "‰", "trademark": "™",
    "Euro": "€", "fi": "ﬁ", "fl": "ﬂ", "ff": "ﬀ", "ffi": "ﬃ", "ffl": "ﬄ", "germandbls": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "oslash": "ø", "Oslash": "Ø", "lslash": "ł",
    "Lslash": "Ł", "dotlessi": "ı", "section": "§", "paragraph": "¶", "copyright": "©", "registered": "®", "degree": "°", "mu": "µ", "sterling": "£", "yen": "¥", "cent": "¢",
    "currency": "¤", "florin": "ƒ", "fraction": "⁄", "periodcentered": "·", "minus": "−", "multiply": "×", "divide": "÷", "plusminus": "±", "exclamdown": "¡", "questiondown": "¿", "nbspace": " ",
}
_MARKS = {"acute": "́", "grave": "̀", "circumflex": "̂", "dieresis": "̈", "tilde": "̃", "ring": "̊", "cedilla": "̧", "caron": "̌", "ogonek": "̨", "macron": "̄", "breve": "̆", "dotaccent": "̇", "hungarumlaut": "̋"}


def glyph_char(name: str) -> str | None:
    """A glyph name's characters: the table, letter with accent, uniXXXX and uXXXXX, and parts joined by underscores."""
    name = name.split(".", 1)[0]
    if name in GLYPHS:
        return GLYPHS[name]
    if len(name) == 1:
        return name
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)", name):
        return bytes.fromhex(m[1]).decode("utf-16-be", "replace")
    if (m := re.fullmatch(r"u([0-9A-F]{4,6})", name)) and int(m[1], 16) < 0x110000:
        return chr(int(m[1], 16))
    if (m := re.fullmatch(r"([A-Za-z])(\w+)", name)) and m[2] in _MARKS:
        made = unicodedata.normalize("NFC", m[1] + _MARKS[m[2]])
        return made if len(made) == 1 else None
    if "_" in name:
        parts = [glyph_char(p) for p in name.split("_")]
        return "".join(parts) if all(parts) else None
    return None


def base_char(encoding: str, code: int) -> str | None:
    if encoding == "WinAnsiEncoding":
        return bytes([code]).decode("cp1252", "replace").replace("�", "•") if code >= 32 else None
    if encoding == "MacRomanEncoding":
        return bytes([code]).decode("mac_roman") if code >= 32 else None
    return STANDARD.get(code) or (chr(code) if 32 <= code < 127 else None)


# Bits of a font descriptor's flags, counted from 0.
FIXED, SERIF, SYMBOLIC, SCRIPT, ITALIC, BOLD = 0, 1, 2, 3, 6, 18


def face_request(name: str, flags: int = 0, weight: float | None = None) -> dict[str, Any]:
    """What a font asks of whoever looks for a face: family, bold, italic, serif and fixed pitch, by its name and flags."""
    base = name.split("+", 1)[-1] if re.match(r"[A-Z]{6}\+", name) else name
    family = re.split(r"[-,]", base, maxsplit=1)[0]
    style = base[len(family) :].lower()
    family = re.sub(r"(?:PSMT|MT|PS)$", "", family)
    return {
        "family": family,
        "bold": "bold" in style or "black" in style or "heavy" in style or bool(flags >> BOLD & 1) or (weight or 0) >= 600,
        "italic": "italic" in style or "oblique" in style or bool(flags >> ITALIC & 1),
        "serif": bool(flags >> SERIF & 1) or family.startswith(("Times", "Georgia")),
        "fixed": bool(flags >> FIXED & 1) or family.startswith("Courier"),
    }


# Widths in thousandths of the characters from space to tilde; those of Courier are 600.
_WIDTHS = {
    "Helvetica": (
        "278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 1015 667 667 722 722 667 611 778 722 278 500 667 "
        "556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556 333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584"
    ),
    "Helvetica-Bold": (
        "278 333 474 556 556 889 722 238 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 333 333 584 584 584 611 975 722 722 722 722 667 611 778 722 278 556 722 "
        "611 833 722 778 667 778 722 667 611 722 667 944 667 667 611 333 278 333 584 556 333 556 611 556 611 556 333 611 611 278 278 556 278 889 611 611 611 611 389 556 333 611 556 778 556 556 500 389 280 389 584"
    ),
    "Times-Roman": (
        "250 333 408 500 500 833 778 180 333 333 500 564 250 333 250 278 500 500 500 500 500 500 500 500 500 500 278 278 564 564 564 444 921 722 667 667 722 611 556 722 722 333 389 722 "
        "611 889 722 722 556 722 667 556 611 722 722 944 722 722 611 333 278 333 469 500 333 444 500 444 500 444 333 500 500 278 278 500 278 778 500 500 500 500 333 389 278 500 500 722 500 500 444 480 200 480 541"
    ),
    "Times-Bold": (
        "250 333 555 500 500 1000 833 278 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500 930 722 667 722 722 667 611 778 778 389 500 778 "
        "667 944 722 778 611 778 722 556 667 722 722 1000 722 722 667 333 278 333 581 500 333 500 556 444 556 444 333 500 556 278 333 556 278 833 556 500 556 556 444 389 333 556 500 722 500 500 444 394 220 394 520"
    ),
    "Times-Italic": (
        "250 333 420 500 500 833 778 214 333 333 500 675 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 675 675 675 500 920 611 611 667 722 611 611 722 722 333 444 667 "
        "556 833 667 722 611 722 611 500 556 722 611 833 611 556 556 389 278 389 422 500 333 500 500 444 500 444 278 500 500 278 278 444 278 722 500 500 500 500 389 389 278 500 444 667 444 444 389 400 275 400 541"
    ),
}


def standard_face(name: str) -> str | None:
    """The standard face that a font's name stands for; null for other fonts."""
    asked = face_request(name)
    family = asked["family"].replace(" ", "")
    if family in ("Courier", "CourierNew"):
        return "Courier"
    if family in ("Helvetica", "Arial"):  # slanted ones are as wide
        return "Helvetica-Bold" if asked["bold"] else "Helvetica"
    if family in ("Times", "TimesNewRoman"):
        return "Times-Bold" if asked["bold"] else "Times-Italic" if asked["italic"] else "Times-Roman"
    return None


@functools.cache
def standard_widths(face: str) -> dict[str, float]:
    """Widths by character; letters with accents are as wide as without."""
    if face == "Courier":
        return {}
    return {chr(32 + i): float(w) for i, w in enumerate(_WIDTHS[face].split())}


@functools.lru_cache(4096)
def standard_width(face: str, char: str, default: float) -> float:
    if face == "Courier":
        return 600.0
    table = standard_widths(face)
    base = unicodedata.normalize("NFD", char)[:1]
    return table.get(char, table.get(base, default))


class CMap:
    """Codespace ranges, codes to CIDs, codes to characters."""

    def __init__(self) -> None:
        self.spaces: list[tuple[int, int, int]] = []
        self.cids: list[tuple[int, int, int]] = []
        self.chars: dict[int, str] = {}
        self.vertical = False

    @classmethod
    def parse(cls, data: bytes, parent: CMap | None = None) -> CMap:
        out, stack, p = cls(), [], Parser(data)
        if parent:
            out.spaces, out.cids, out.chars, out.vertical = list(parent.spaces), list(parent.cids), dict(parent.chars), parent.vertical
        while True:
            item = p.parse(refs=False)
            if not isinstance(item, Keyword):
                stack = [*stack[-40_000:], item]
                continue
            if item == "":
                return out
            number = lambda b: int.from_bytes(b, "big")
            chars = lambda b: b.decode("utf-16-be", "replace")
            if item == "endcodespacerange":
                out.spaces += [(len(a), number(a), number(b)) for a, b in zip(stack[::2], stack[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)]
            elif item in ("endcidrange", "endcidchar"):
                step = 3 if item == "endcidrange" else 2
                for i in range(0, len(stack) - step + 1, step):
                    lo, hi, cid = (stack[i], stack[i + 1], stack[i + 2]) if step == 3 else (stack[i], stack[i], stack[i + 1])
                    if isinstance(lo, bytes) and isinstance(hi, bytes) and isinstance(cid, int):
                        out.cids.append((number(lo), number(hi), cid))
            elif item == "endbfchar":
                out.chars |= {number(a): chars(b) for a, b in zip(stack[::2], stack[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)}
            elif item == "endbfrange":
                for lo, hi, to in zip(stack[::3], stack[1::3], stack[2::3], strict=False):
                    if not (isinstance(lo, bytes) and isinstance(hi, bytes)):
                        continue
                    codes = range(number(lo), min(number(hi), number(lo) + 65535) + 1)
                    if isinstance(to, bytes) and to:
                        out.chars |= {c: chars(to[:-2] + ((number(to[-2:]) + k) & 0xFFFF).to_bytes(2, "big")) if len(to) > 1 else chr(to[0] + k) for k, c in enumerate(codes)}
                    elif isinstance(to, list):
                        out.chars |= {c: chars(b) for c, b in zip(codes, to, strict=False) if isinstance(b, bytes)}
            elif item == "def" and len(stack) >= 2 and stack[-2] == "WMode":
                out.vertical = stack[-1] == 1
            stack = []

    def split(self, data: bytes) -> list[tuple[int, int]]:
        """(code, bytes) by the codespace ranges; bytes in none of them go by the shortest range's length."""
        out, i = [], 0
        lengths = sorted({n for n, _, _ in self.spaces}) or [2]
        while i < len(data):
            for n in lengths:
                code = int.from_bytes(data[i : i + n], "big")
                if i + n <= len(data) and any(m == n and lo <= code <= hi for m, lo, hi in self.spaces):
                    break
            else:
                n = min(lengths[0], len(data) - i)
                code = int.from_bytes(data[i : i + n], "big")
            out.append((code, n))
            i += n
        return out

    def cid(self, code: int) -> int | None:
        return next((cid + code - lo for lo, hi, cid in reversed(self.cids) if lo <= code <= hi), None)


class Font:
    def __init__(self, doc: Document, d: dict[str, Any]):
        self.doc = doc
        get = lambda k, of=d: doc.get(of.get(k))
        #: What decode() gives for single bytes.
        self.known: dict[int, tuple[int, int, str, float]] = {}
        self.kind = get("Subtype")
        self.name = str(get("BaseFont") or "")
        self.unicode = self._cmap(get("ToUnicode"))
        self.vertical = False
        if self.kind == "Type0":
            kids = get("DescendantFonts")
            below = doc.get(kids[0]) if isinstance(kids, list) and kids else {}
            below = below if isinstance(below, dict) else {}
            encoding = get("Encoding")
            self.cmap = self._cmap(encoding) or CMap()
            if isinstance(encoding, Name):
                self.cmap.spaces, self.cmap.cids = [(2, 0, 0xFFFF)], [(0, 0xFFFF, 0)]
                self.vertical = encoding.endswith("V")
            self.vertical |= self.cmap.vertical
            default = doc.get(below.get("DW"))
            self.default = default if isinstance(default, (int, float)) else 1000
            self.widths = self._cid_widths(doc.get(below.get("W")))
        else:
            self.cmap = None
            first, widths = get("FirstChar"), get("Widths")
            first = first if isinstance(first, int) else 0
            self.widths = {first + i: w for i, w in enumerate(map(doc.get, widths)) if isinstance(w, (int, float))} if isinstance(widths, list) else {}
            descriptor = get("FontDescriptor")
            missing = doc.get(descriptor.get("MissingWidth")) if isinstance(descriptor, dict) else None
            self.default = missing if isinstance(missing, (int, float)) else 0 if self.widths else 600 if "Courier" in self.name else 500
            self.encoding, self.differences = self._encoding(get("Encoding"))
            self.face = standard_face(self.name) if not self.widths and self.kind != "Type3" else None
        matrix = get("FontMatrix")
        self.scale = matrix[0] if self.kind == "Type3" and isinstance(matrix, list) and matrix and isinstance(matrix[0], (int, float)) else 0.001

    def _cmap(self, value: Any, depth: int = 0) -> CMap | None:
        if not isinstance(value, Stream) or depth > 8:
            return None
        return CMap.parse(self.doc.decoded(value)[0], self._cmap(self.doc.get(value.dict.get("UseCMap")), depth + 1))

    def _cid_widths(self, value: Any) -> dict[int, float]:
        out: dict[int, float] = {}
        items = [self.doc.get(v) for v in value] if isinstance(value, list) else []
        i = 0
        while i + 1 < len(items):
            if isinstance(items[i + 1], list):
                out |= {items[i] + k: w for k, w in enumerate(map(self.doc.get, items[i + 1])) if isinstance(items[i], int) and isinstance(w, (int, float))}
                i += 2
            else:
                if i + 2 < len(items) and all(isinstance(x, (int, float)) for x in items[i : i + 3]):
                    out |= dict.fromkeys(range(int(items[i]), min(int(items[i + 1]), 65535) + 1), items[i + 2])
                i += 3
        return out

    def _encoding(self, value: Any) -> tuple[str, dict[int, str]]:
        if isinstance(value, Name):
            return str(value), {}
        symbolic = "Symbol" in self.name or "Dingbats" in self.name
        base, out, code = "none" if symbolic else "StandardEncoding", {}, 0
        if isinstance(value, dict):
            base = str(self.doc.get(value.get("BaseEncoding")) or base)
            for x in map(self.doc.get, self.doc.get(value.get("Differences")) or []):
                if isinstance(x, int):
                    code = x
                elif isinstance(x, Name):
                    out[code] = x
                    code += 1
        return base, out

    def decode(self, data: bytes) -> list[tuple[int, int, str, float]]:
        """(code, bytes, text, width in text space) of each code; the text is empty where nothing tells it."""
        if self.cmap:
            return [self._glyph(code, n) for code, n in self.cmap.split(data)]
        known = self.known
        return [known.get(c) or known.setdefault(c, self._glyph(c, 1)) for c in data]

    def _glyph(self, code: int, n: int) -> tuple[int, int, str, float]:
        cid = self.cmap.cid(code) if self.cmap else code
        text = self.unicode.chars.get(code, "") if self.unicode else ""
        if not text and not self.cmap:
            name = self.differences.get(code)
            text = (glyph_char(name) if name else base_char(self.encoding, code) if self.encoding != "none" else None) or ""
        width = self.widths.get(code if cid is None else cid, self.default)
        if not self.cmap and self.face and text:
            width = standard_width(self.face, text[0], self.default)
        return code, n, text, width * self.scale
