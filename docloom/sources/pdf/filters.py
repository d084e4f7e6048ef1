"""Stream filters: bytes to bytes. Damage ends a filter early; what came before it is kept."""

from __future__ import annotations

import re
import struct
import zlib
from typing import Any

import numpy as np

LIMIT = 128 << 20
# Short names that inline images use.
ABBREVIATIONS = {"AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "LZW": "LZWDecode", "Fl": "FlateDecode", "RL": "RunLengthDecode", "CCF": "CCITTFaxDecode", "DCT": "DCTDecode"}
#: Image codecs end a chain: what comes out of the filters before them is the image file.
IMAGE = frozenset(("DCTDecode", "JPXDecode", "JBIG2Decode", "CCITTFaxDecode"))


def flate(data: bytes, raw: bool = False) -> tuple[bytes, bool, int]:
    """(output, whole, bytes used); without a valid header or after damage as much as can be had."""
    d = zlib.decompressobj(-15 if raw else 15)
    out = bytearray()
    try:
        for at in range(0, len(data), 1 << 16):
            out += d.decompress(data[at : at + (1 << 16)], LIMIT - len(out))
            if d.eof or len(out) >= LIMIT:
                break
        out += d.flush()[: LIMIT - len(out)]
        return bytes(out), d.eof, len(data) - len(d.unused_data)
    except zlib.error:
        if out or raw:
            # Byte by byte, so that nothing before the damage is lost.
            return _flate_prefix(data, raw, len(out)), False, len(data)
        out2, whole, used = flate(data[2:], True)
        return (out2, whole, used + 2) if out2 else (_flate_prefix(data, raw, 0), False, len(data))


def _flate_prefix(data: bytes, raw: bool, least: int) -> bytes:
    d, out = zlib.decompressobj(-15 if raw else 15), bytearray()
    try:
        for i in range(len(data)):
            out += d.decompress(data[i : i + 1])
    except zlib.error:
        pass
    return bytes(out)


def lzw(data: bytes, early: bool = True) -> bytes:
    table: list[bytes] = []
    out, bits, have, width, last = bytearray(), 0, 0, 9, b""

    def reset() -> None:
        nonlocal table, width, last
        table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""

    reset()
    for byte in data:
        bits, have = (bits << 8 | byte) & 0xFFFFFF, have + 8
        while have >= width:
            code = bits >> (have - width) & ((1 << width) - 1)
            have -= width
            if code == 256:
                reset()
                continue
            if code == 257 or len(out) > LIMIT:
                return bytes(out)
            if code < len(table):
                entry = table[code]
            elif code == len(table) and last:
                entry = last + last[:1]
            else:
                return bytes(out)
            out += entry
            if last and len(table) < 4096:
                table.append(last + entry[:1])
            last = entry
            size = len(table) + early
            width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    return bytes(out)


def ascii_hex(data: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">", 1)[0])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def ascii85(data: bytes) -> bytes:
    out, group = bytearray(), []
    for c in data.split(b"~", 1)[0]:
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
        elif 0x21 <= c <= 0x75:
            group.append(c - 0x21)
            if len(group) == 5:
                out += _group85(group)
                group = []
    if len(group) > 1:
        out += _group85(group + [84] * (5 - len(group)))[: len(group) - 1]
    return bytes(out)


def _group85(group: list[int]) -> bytes:
    n = 0
    for g in group:
        n = n * 85 + g
    return struct.pack(">I", n & 0xFFFFFFFF)


def run_length(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and data[i] != 128 and len(out) < LIMIT:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def predictor(data: bytes, parms: dict[str, Any]) -> bytes:
    kind = _int(parms.get("Predictor"), 1)
    if kind < 2:
        return data
    colors, bits, columns = max(1, _int(parms.get("Colors"), 1)), max(1, _int(parms.get("BitsPerComponent"), 8)), max(1, _int(parms.get("Columns"), 1))
    step, row = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    if kind == 2:
        return tiff_rows(data, row, columns, colors, bits) if bits in (1, 2, 4, 8, 16) else data
    return png_rows(data, row, step)


def tiff_rows(data: bytes, row: int, columns: int, colors: int, bits: int) -> bytes:
    """Rows of samples that each hold the difference to the sample before of the same colour; a short last row stays."""
    whole = np.frombuffer(data[: len(data) // row * row], np.uint8).reshape(-1, row)
    if bits >= 8:
        samples = whole.view(">u2" if bits == 16 else np.uint8)[:, : columns * colors].reshape(len(whole), columns, colors)
        out = np.cumsum(samples, axis=1, dtype=samples.dtype.newbyteorder("="))
        return out.astype(samples.dtype).tobytes() + data[len(whole) * row :]
    each = 8 // bits
    shifts = np.arange(8 - bits, -1, -bits, dtype=np.uint8)
    samples = (whole[:, :, None] >> shifts & ((1 << bits) - 1)).reshape(len(whole), row * each)
    used = samples[:, : columns * colors].reshape(len(whole), columns, colors)
    samples[:, : columns * colors] = (np.cumsum(used, axis=1, dtype=np.uint8) & ((1 << bits) - 1)).reshape(len(whole), columns * colors)
    return (samples.reshape(len(whole), row, each) << shifts).sum(2, dtype=np.uint8).tobytes() + data[len(whole) * row :]


def png_rows(data: bytes, row: int, step: int) -> bytes:
    """Rows that each begin with a filter type; a short last row is filled with zeros."""
    out, above = bytearray(), np.zeros(row, np.uint8)
    for at in range(0, len(data), row + 1):
        kind, line = data[at], np.frombuffer(data[at + 1 : at + 1 + row].ljust(row, b"\0"), np.uint8).copy()
        if kind == 1:
            for k in range(step):
                line[k::step] = np.cumsum(line[k::step], dtype=np.uint8)
        elif kind == 2:
            line += above
        elif kind in (3, 4):
            cur, up = line.tolist(), above.tolist()
            for i in range(row):
                a, b, c = cur[i - step] if i >= step else 0, up[i], up[i - step] if i >= step else 0
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                cur[i] = (cur[i] + guess) & 255
            line = np.array(cur, np.uint8)
        out += line.tobytes()
        above = line
    return bytes(out)


def _int(value: Any, default: int) -> int:
    return int(value) if isinstance(value, (int, float)) else default


def chain(filters: Any, parms: Any) -> list[tuple[str, dict[str, Any]]]:
    """/Filter and /DecodeParms, each one or an array, as pairs."""
    names = filters if isinstance(filters, list) else [] if filters is None else [filters]
    rest = parms if isinstance(parms, list) else [parms]
    rest = [p if isinstance(p, dict) else {} for p in rest] + [{}] * len(names)
    return [(ABBREVIATIONS.get(n, n), p) for n, p in zip(names, rest, strict=False) if isinstance(n, str)]


def apply(data: bytes, steps: list[tuple[str, dict[str, Any]]]) -> tuple[bytes, str | None, list[str]]:
    """(output, the image codec or unknown filter that ended the chain, warnings)."""
    warnings: list[str] = []
    for name, parms in steps:
        if name in IMAGE:
            return data, name, warnings
        if name == "FlateDecode":
            data, whole, _ = flate(data)
            warnings += [] if whole else ["flate data cut short"]
            data = predictor(data, parms)
        elif name == "LZWDecode":
            data = predictor(lzw(data, _int(parms.get("EarlyChange"), 1) != 0), parms)
        elif name == "ASCIIHexDecode":
            data = ascii_hex(data)
        elif name == "ASCII85Decode":
            data = ascii85(data)
        elif name == "RunLengthDecode":
            data = run_length(data)
        elif name != "Crypt":
            return data, name, [*warnings, f"filter {name}"]
    return data, None, warnings
