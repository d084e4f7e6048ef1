"""PNG and PNM images as arrays, and how far two images differ."""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass
from typing import Any

import numpy as np

from docloom.sources.pdf.filters import png_rows

MAX_PIXELS = 1 << 26
# Bit depths that each colour type may have, and its channels.
LEGAL = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
SIGNATURE = b"\x89PNG\r\n\x1a\n"


class ImageError(ValueError):
    pass


@dataclass
class PngHeader:
    width: int
    height: int
    depth: int
    colour: int
    interlaced: bool
    palette: bytes
    transparency: bytes
    data: bytes


def png_scan(raw: bytes) -> PngHeader:
    if not raw.startswith(SIGNATURE):
        raise ImageError("signature")
    at, head, palette, transparency, data = 8, None, b"", b"", []
    while at + 8 <= len(raw):
        n, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + n]
        if len(body) == n and len(raw) >= at + 12 + n and zlib.crc32(kind + body) != struct.unpack_from(">I", raw, at + 8 + n)[0] and kind in (b"IHDR", b"PLTE"):
            raise ImageError("checksum")
        if kind == b"IHDR" and n == 13:
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = body
        elif kind == b"tRNS":
            transparency = body
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
        at += 12 + n
    if head is None:
        raise ImageError("header")
    width, height, depth, colour, _, _, interlace = head
    if depth not in LEGAL.get(colour, ()):
        raise ImageError("depth")
    if not width or not height or width * height > MAX_PIXELS:
        raise ImageError("size")
    if colour == 3 and not palette:
        raise ImageError("palette")
    return PngHeader(width, height, depth, colour, interlace == 1, palette, transparency, b"".join(data))


def _samples(raw: bytes, width: int, height: int, depth: int, channels: int) -> tuple[np.ndarray, int]:
    """(height, width, channels) of unscaled samples, and the bytes used."""
    row = (width * channels * depth + 7) // 8
    used = (row + 1) * height
    lines = np.frombuffer(png_rows(raw[:used].ljust(used, b"\0"), row, max(1, channels * depth // 8)), np.uint8).reshape(height, row)
    if depth == 16:
        out = lines.reshape(height, -1, 2)
        out = out[:, :, 0].astype(np.uint16) << 8 | out[:, :, 1]
    elif depth == 8:
        out = lines
    else:
        bits = np.unpackbits(lines, axis=1).reshape(height, -1, depth)
        out = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(2).astype(np.uint8)
    return out[:, : width * channels].reshape(height, width, channels), used


# The seven passes (x start, y start, x step, y step).
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def png_decode(raw: bytes) -> np.ndarray:
    """(height, width, channels) of bytes: 1 gray, 2 with alpha, 3 RGB, 4 RGBA. Data cut short leaves zeros."""
    h = png_scan(raw)
    d = zlib.decompressobj()
    try:
        data = d.decompress(h.data, (h.width * CHANNELS[h.colour] * 2 + 8) * (h.height + 8) * 2)
    except zlib.error:
        raise ImageError("data") from None
    channels = CHANNELS[h.colour]
    if not h.interlaced:
        out, _ = _samples(data, h.width, h.height, h.depth, channels)
    else:
        out, at = np.zeros((h.height, h.width, channels), np.uint16 if h.depth == 16 else np.uint8), 0
        for x, y, dx, dy in ADAM7:
            w, n = (h.width - x + dx - 1) // dx, (h.height - y + dy - 1) // dy
            if w > 0 and n > 0:
                part, used = _samples(data[at:], w, n, h.depth, channels)
                out[y::dy, x::dx] = part
                at += used
    if h.colour == 3:
        size = len(h.palette) // 3
        table = np.frombuffer(h.palette[: size * 3], np.uint8).reshape(-1, 3)
        index = np.minimum(out[:, :, 0], size - 1)
        rgb = table[index]
        if h.transparency:
            alpha = np.frombuffer(h.transparency[:size].ljust(size, b"\xff"), np.uint8)
            return np.concatenate([rgb, alpha[index][:, :, None]], axis=2)
        return rgb
    if h.depth == 16:
        return (out >> 8).astype(np.uint8)
    return out if h.depth == 8 else (out.astype(np.uint16) * 255 // ((1 << h.depth) - 1)).astype(np.uint8)


def png_encode(pixels: np.ndarray) -> bytes:
    height, width, channels = pixels.shape
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1).tobytes()
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def read_pnm(raw: bytes) -> np.ndarray:
    """Binary gray (P5) and RGB (P6) maps of one byte a sample."""
    m = re.match(rb"(P[56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s", raw)
    if not m or int(m[4]) != 255 or not 0 < int(m[2]) * int(m[3]) <= MAX_PIXELS:
        raise ImageError("header")
    channels = 1 if m[1] == b"P5" else 3
    size = int(m[2]) * int(m[3]) * channels
    if len(raw) < m.end() + size:
        raise ImageError("data")
    return np.frombuffer(raw, np.uint8, size, m.end()).reshape(int(m[3]), int(m[2]), channels)


def write_pnm(pixels: np.ndarray) -> bytes:
    height, width, channels = pixels.shape
    return (b"P5" if channels == 1 else b"P6") + b"\n%d %d\n255\n" % (width, height) + pixels[:, :, : 1 if channels < 3 else 3].tobytes()


def jpeg_shape(raw: bytes) -> tuple[int, int, int] | None:
    """(width, height, components) from the frame header."""
    at = 2 if raw[:2] == b"\xff\xd8" else len(raw)
    while at + 9 < len(raw):
        if raw[at] != 0xFF:
            at += 1
            continue
        mark = raw[at + 1]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", raw, at + 5)
            return width, height, raw[at + 9]
        if mark in (0xFF, 0x01) or 0xD0 <= mark <= 0xD9:
            at += 1 if mark == 0xFF else 2
            continue
        at += 2 + struct.unpack_from(">H", raw, at + 2)[0]
    return None


def compare(a: np.ndarray, b: np.ndarray, threshold: int = 8) -> dict[str, Any]:
    """Shares of pixels that differ and that differ by more than the threshold, the mean, the worst and where it is."""
    if a.shape != b.shape:
        raise ImageError("shape")
    d = np.abs(a.astype(np.int16) - b).max(2)
    at = int(d.argmax())
    return {"over": float((d > threshold).mean()), "differing": float((d > 0).mean()), "mean": float(np.abs(a.astype(np.int16) - b).mean()), "worst": int(d.max()), "x": at % d.shape[1], "y": at // d.shape[1]}
