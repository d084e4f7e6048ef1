"""Line breaking after the Unicode line breaking algorithm, with classes worked out from what Python knows of characters.

Python has general categories and widths but no line-break classes, so this is an approximation: its classes come from rules over
those, and complex scripts (Thai, Khmer and the like) break at spaces only. It isn't the published algorithm in full.
"""

from __future__ import annotations

import functools
import re
import unicodedata

# Characters whose class their category doesn't tell.
_OWN = {
    "\n": "LF", "\r": "CR", "\x0b": "BK", "\x0c": "BK", " ": "BK", " ": "BK", "\x85": "NL", " ": "SP", "​": "ZW", "⁠": "WJ", "﻿": "WJ", "\xa0": "GL", " ": "GL", " ": "GL", "‑": "GL",
    "‍": "ZWJ", "-": "HY", "\xad": "BA", "\t": "BA", "‐": "BA", "‒": "BA", "–": "BA", "|": "BA", "—": "B2", "/": "SY", "!": "EX", "?": "EX", ",": "IS", ".": "IS", ":": "IS", ";": "IS", "$": "PR", "+": "PR", "\\": "PR",
    "£": "PR", "¥": "PR", "€": "PR", "№": "PR", "±": "PR", "%": "PO", "¢": "PO", "°": "PO", "‰": "PO", "′": "PO", '"': "QU", "'": "QU", ")": "CP", "]": "CP", "…": "IN", "￼": "CB",
}
_SMALL_KANA = frozenset("ぁぃぅぇぉっゃゅょゎァィゥェォッャュョヮー々")
_RUNS = re.compile(r"(?s:[A-Za-z]+|.)")


@functools.lru_cache(maxsize=65536)
def line_break_class(c: str) -> str:
    if c in _OWN:
        return _OWN[c]
    code, kind = ord(c), unicodedata.category(c)
    if 0x1F1E6 <= code <= 0x1F1FF:
        return "RI"
    if 0xAC00 <= code <= 0xD7A3:
        return "ID"
    if kind in ("Mn", "Mc", "Me") or 0x1F3FB <= code <= 0x1F3FF:
        return "CM"
    if kind in ("Cc", "Cf", "Cs"):
        return "CM" if kind != "Cs" else "AL"
    if kind == "Ps":
        return "OP"
    if kind == "Pe":
        return "CL"
    if kind in ("Pi", "Pf"):
        return "QU" if unicodedata.east_asian_width(c) not in "WF" else "OP" if kind == "Pi" else "CL"
    if c in _SMALL_KANA:
        return "NS"
    if kind == "Nd":
        return "NU" if unicodedata.east_asian_width(c) not in "WF" else "ID"
    if kind == "Sc":
        return "PR"
    if kind == "Zs":
        return "BA"
    if unicodedata.east_asian_width(c) in "WF" or 0x3040 <= code <= 0x9FFF or 0x20000 <= code <= 0x3FFFD:
        return "CL" if c in "、。，．" else "ID"
    if 0x5D0 <= code <= 0x5EA:
        return "HL"
    return "AL"


def opportunities(text: str) -> list[tuple[int, bool]]:
    """(place, mandatory): where a line may end before character `place`; the end of the text is mandatory."""
    if not text:
        return []
    out: list[tuple[int, bool]] = []
    flags = 0
    a = base = own = ""  # the class of the character before, the last one that isn't a space, and the former before it took another's
    for m in _RUNS.finditer(text):
        i, c = m.start(), m[0]
        b = raw = "AL" if len(c) > 1 else line_break_class(c)  # nothing breaks inside a run of letters
        if raw in ("CM", "ZWJ"):  # a mark takes the class of what it stands on
            b = "AL" if a in ("", "BK", "CR", "LF", "NL", "SP", "ZW") else a
        if i:
            flags = flags + 1 if a == "RI" else 0
            if a in ("BK", "LF", "NL") or (a == "CR" and b != "LF"):
                out.append((i, True))
            elif _may(a, b, base, flags % 2, own, raw):
                out.append((i, False))
        a, own = b, raw
        base = base if b == "SP" else b
    out.append((len(text), True))
    return out


@functools.lru_cache(maxsize=65536)
def _may(a: str, b: str, base: str, flags: int, left: str, right: str) -> bool:
    """Whether a line may end between classes; left and right are those of the characters themselves."""
    if b in ("BK", "CR", "LF", "NL", "SP", "ZW"):
        return False
    if base == "ZW":
        return True
    if right in ("CM", "ZWJ") and a != "SP":
        return False
    if left == "ZWJ" or "WJ" in (a, b) or a == "GL":
        return False
    if b == "GL" and a not in ("SP", "BA", "HY"):
        return False
    if b in ("CL", "CP", "EX", "SY") or (b == "IS"):
        return False
    if base == "OP" or (base == "QU" and b == "OP") or (base in ("CL", "CP") and b == "NS") or (base == "B2" and b == "B2"):
        return False
    if a == "SP":
        return True
    if "QU" in (a, b):
        return False
    if "CB" in (a, b):
        return True
    if b in ("BA", "HY", "NS") or (a == "SY" and b == "HL") or b == "IN":
        return False
    words, digits = ("AL", "HL"), ("NU",)
    pairs = ((words, digits), (digits, words), (("PR",), ("ID",)), (("ID",), ("PO",)), (("PR", "PO"), words), (words, ("PR", "PO")), (("CL", "CP", "NU"), ("PO", "PR")), (("PO", "PR"), ("OP", "NU")), (("HY", "IS", "NU", "SY"), digits), (words, words), (("IS",), words), ((*words, "NU"), ("OP",)), (("CP",), (*words, "NU")))
    if any(a in x and b in y for x, y in pairs):
        return False
    return not (a == b == "RI" and flags % 2)
