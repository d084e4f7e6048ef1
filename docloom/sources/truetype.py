"""TrueType programs in files: widths, the glyphs that a text needs, subsets, and font dictionaries to embed them."""

from __future__ import annotations

import struct
from collections.abc import Iterable
from typing import Any

from docloom.sources.pdf.objects import Name, write
from docloom.sources.pdf.writer import Builder, deflated
from docloom.sources.raster import TrueType


class Font(TrueType):
    """A program with metrics."""

    def __init__(self, data: bytes):
        super().__init__(data)
        self.program = data
        hhea = self.tables.get("hhea", b"")
        self.ascent, self.descent = struct.unpack_from(">hh", hhea, 4) if len(hhea) >= 36 else (self.units, 0)
        metrics = struct.unpack_from(">H", hhea, 34)[0] if len(hhea) >= 36 else 0
        hmtx = self.tables.get("hmtx", b"")
        self.advances = [struct.unpack_from(">H", hmtx, 4 * i)[0] for i in range(min(metrics, len(hmtx) // 4))]

    def width(self, glyph: int) -> float:
        """In thousandths; the last width holds for all glyphs after it."""
        return self.advances[min(glyph, len(self.advances) - 1)] * 1000 / self.units if self.advances else 0.0

    def components(self, glyph: int) -> set[int]:
        """The glyph and all that it is made of."""
        out: set[int] = set()
        work = [glyph]
        while work:
            g = work.pop()
            if g in out or not 0 <= g < len(self.loca) - 1:
                continue
            out.add(g)
            body = self.tables["glyf"][self.loca[g] : self.loca[g + 1]]
            if len(body) < 10 or struct.unpack_from(">h", body)[0] >= 0:
                continue
            at, more = 10, True
            while more and at + 4 <= len(body):
                flags, part = struct.unpack_from(">HH", body, at)
                work.append(part)
                at += 4 + (4 if flags & 1 else 2) + (8 if flags & 0x80 else 4 if flags & 0x40 else 2 if flags & 8 else 0)
                more = bool(flags & 0x20)
        return out

    def subset(self, glyphs: Iterable[int]) -> bytes:
        """The program with the outlines of other glyphs gone; numbers stay, so texts need no change."""
        kept = {0}.union(*(self.components(g) for g in glyphs))
        glyf, loca = bytearray(), [0]
        for g in range(len(self.loca) - 1):
            if g in kept:
                glyf += self.tables["glyf"][self.loca[g] : self.loca[g + 1]]
                glyf += b"\0" * (-len(glyf) % 4)
            loca.append(len(glyf))
        head = bytearray(self.tables["head"])
        head[50:52] = b"\0\1"
        tables = {k: v for k, v in self.tables.items() if k in ("cvt ", "fpgm", "hhea", "hmtx", "maxp", "prep", "OS/2", "cmap")} | {"glyf": bytes(glyf), "loca": struct.pack(f">{len(loca)}I", *loca), "head": bytes(head)}
        return assemble(tables)


def assemble(tables: dict[str, bytes]) -> bytes:
    """A program of tables, sorted by tag, with their checksums."""
    power = max(0, len(tables).bit_length() - 1)
    out = bytearray(struct.pack(">IHHHH", 0x10000, len(tables), 16 << power, power, 16 * len(tables) - (16 << power)))
    at, body = 12 + 16 * len(tables), bytearray()
    for tag, t in sorted(tables.items()):
        padded = t + b"\0" * (-len(t) % 4)
        total = sum(struct.unpack(f">{len(padded) // 4}I", padded)) & 0xFFFFFFFF
        out += struct.pack(">4sIII", tag.encode("latin-1"), total, at + len(body), len(t))
        body += padded
    return bytes(out + body)


def _descriptor(font: Font, base: str, program: bytes, symbolic: bool) -> dict[str, Any]:
    scale = 1000 / font.units
    file = deflated(program)
    file.dict["Length1"] = len(program)
    return {"Type": Name("FontDescriptor"), "FontName": Name(base), "Flags": 4 if symbolic else 32, "FontBBox": [0, round(font.descent * scale), 1000, round(font.ascent * scale)], "ItalicAngle": 0, "Ascent": round(font.ascent * scale), "Descent": round(font.descent * scale), "CapHeight": round(font.ascent * scale), "StemV": 80, "FontFile2": file}


def embed(builder: Builder, name: str, base: str, program: bytes) -> bool:
    """A simple font for text in WinAnsi; false for a program that can't be read or a name that is taken."""
    try:
        font = Font(program)
    except (KeyError, struct.error, IndexError):
        return False
    if name in builder.fonts or name in builder.programs:
        return False
    chars = [bytes([c]).decode("cp1252", "replace") for c in range(32, 256)]
    widths = [round(font.width(font.cmap.get(ord(c), 0)), 3) for c in chars]
    builder.programs[name] = {"Type": Name("Font"), "Subtype": Name("TrueType"), "BaseFont": Name(base), "Encoding": Name("WinAnsiEncoding"), "FirstChar": 32, "LastChar": 255, "Widths": widths, "FontDescriptor": _descriptor(font, base, program, False)}
    return True


def embed_cid(builder: Builder, name: str, base: str, program: bytes, text: str) -> bool:
    """A composite font of the glyphs that `text` needs, shown by glyph number, with a way back to its characters."""
    try:
        font = Font(program)
    except (KeyError, struct.error, IndexError):
        return False
    if name in builder.fonts or name in builder.programs:
        return False
    used = {font.cmap[ord(c)]: c for c in sorted(set(text)) if ord(c) in font.cmap}
    tag = "".join(chr(65 + (len(used) * 7 + k * 5 + sum(used)) % 26) for k in range(6))
    to_unicode = b"1 begincodespacerange <0000> <FFFF> endcodespacerange\n" + b"".join(b"1 beginbfchar <%04X> <%s> endbfchar\n" % (g, c.encode("utf-16-be").hex().upper().encode()) for g, c in used.items())
    widths = [x for g in sorted(used) for x in (g, [round(font.width(g), 3)])]
    below = {"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "BaseFont": Name(f"{tag}+{base}"), "CIDSystemInfo": {"Registry": b"Adobe", "Ordering": b"Identity", "Supplement": 0}, "FontDescriptor": _descriptor(font, f"{tag}+{base}", font.subset(used), True), "DW": 1000, "W": widths, "CIDToGIDMap": Name("Identity")}
    builder.programs[name] = {"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name(f"{tag}+{base}"), "Encoding": Name("Identity-H"), "DescendantFonts": [below], "ToUnicode": deflated(to_unicode)}
    return True


def show(builder: Builder, name: str, font: Font, x: float, y: float, text: str, size: float = 12) -> int:
    """Draws text by glyph numbers; how many characters have no glyph and were left out."""
    glyphs = [font.cmap[ord(c)] for c in text if ord(c) in font.cmap]
    codes = b"".join(g.to_bytes(2, "big") for g in glyphs)
    builder.raw(b"BT " + write(Name(name)) + b" %s Tf %s %s Td <%s> Tj ET" % (write(size), write(x), write(y), codes.hex().encode()))
    return len(text) - len(glyphs)
