"""A decoder for sequential Huffman JPEG images of 8 bits, one or three components.

Entropy decoding walks the bits; dequantisation, the inverse transform, upsampling and
the colour change are array passes over the whole image. Progressive and arithmetic
images, and damaged ones, give None.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

# The order in which a block's coefficients are stored, by diagonals.
_PLACES = np.array(sorted(range(64), key=lambda i: (s := i // 8 + i % 8, i // 8 if s % 2 else i % 8)))
_BASIS = np.cos((2 * np.arange(8)[None, :] + 1) * np.arange(8)[:, None] * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(1 / 8), 0.5)[:, None]
_SEQUENTIAL, _RESTART = (0xC0, 0xC1), re.compile(rb"\xff[\xd0-\xd7]")


@dataclass
class _Component:
    name: int
    across: int
    down: int
    table: int
    dc: list = field(default_factory=list)
    ac: list = field(default_factory=list)


class _Damaged(Exception):
    pass


def _codes(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """For every 16 bits the length and symbol of the code they start with."""
    out, code, at = [(0, 0)] * 65536, 0, 0
    for bits in range(1, 17):
        for _ in range(counts[bits - 1]):
            a = code << (16 - bits)
            out[a : a + (1 << (16 - bits))] = [(bits, symbols[at])] * (1 << (16 - bits))
            code, at = code + 1, at + 1
        code <<= 1
    return out


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + bytes(8), 0, len(data) * 8


def _segments(data: bytes):
    """``(marker, payload, place after it)`` up to and with the start of the scan."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise _Damaged
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        if n < 2 or at + 2 + n > len(data):
            raise _Damaged
        yield marker, data[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xDA:
            return
        at += 2 + n
    raise _Damaged


def _block(bits: _Bits, c: _Component, last: int, base: int, places: list[int], values: list[int]) -> int:
    """Reads one block's coefficients as places from ``base`` on and values; gives its first one."""
    data, end, at, ac = bits.data, bits.end, bits.at, c.ac
    peek = lambda p: int.from_bytes(data[p >> 3 : (p >> 3) + 4], "big") >> (16 - (p & 7)) & 0xFFFF
    n, size = c.dc[peek(at)]
    if not n:
        raise _Damaged
    at += n
    if size:
        v = peek(at) >> (16 - size)
        at += size
        last += v if v >> (size - 1) else v - (1 << size) + 1
    places.append(base)
    values.append(last)
    k = 1
    while k < 64:
        n, both = ac[peek(at)]
        if not n or at > end:
            raise _Damaged
        at += n
        size = both & 15
        if size == 0:
            if both < 0xF0:
                break
            k += 16
            continue
        k += both >> 4
        if k > 63:
            raise _Damaged
        v = peek(at) >> (16 - size)
        at += size
        places.append(base + k)
        values.append(v if v >> (size - 1) else v - (1 << size) + 1)
        k += 1
    if at > end:
        raise _Damaged
    bits.at = at
    return last


def read_jpeg(data: bytes) -> np.ndarray | None:
    """Pixels ``(height, width, 3)`` of a JPEG image, or None if it can't be read."""
    try:
        return _read(data)
    except (_Damaged, IndexError, KeyError, ValueError):
        return None


def _read(data: bytes) -> np.ndarray | None:
    if data[:2] != b"\xff\xd8":
        return None
    quant, huffman, parts, size, every, mixed, start = {}, {}, [], None, 0, None, 0
    for marker, x, after in _segments(data):
        if marker == 0xDB:
            while x:
                wide, n = x[0] >> 4, 128 if x[0] >> 4 else 64
                quant[x[0] & 15] = np.frombuffer(x[1 : 1 + n], ">u2" if wide else np.uint8).astype(float)
                x = x[1 + n :]
        elif marker == 0xC4:
            while x:
                n = sum(x[1:17])
                huffman[x[0]] = _codes(x[1:17], x[17 : 17 + n])
                x = x[17 + n :]
        elif marker in _SEQUENTIAL:
            if x[0] != 8:
                return None
            size = int.from_bytes(x[1:3], "big"), int.from_bytes(x[3:5], "big")
            parts = [_Component(x[6 + 3 * i], x[7 + 3 * i] >> 4, x[7 + 3 * i] & 15, x[8 + 3 * i]) for i in range(x[5])]
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8:
            return None
        elif marker == 0xDD:
            every = int.from_bytes(x[:2], "big")
        elif marker == 0xEE and x[:5] == b"Adobe":
            mixed = x[11] != 0
        elif marker == 0xDA:
            for i in range(x[0]):
                c = next(c for c in parts if c.name == x[1 + 2 * i])
                c.dc, c.ac = huffman[x[2 + 2 * i] >> 4], huffman[16 + (x[2 + 2 * i] & 15)]
            start = after
            if x[0] != len(parts):
                return None
    if size is None or len(parts) not in (1, 3) or 0 in size:
        return None
    if len(parts) == 1:
        parts[0].across = parts[0].down = 1
    (height, width), wide, tall = size, max(c.across for c in parts), max(c.down for c in parts)
    columns, rows = -(-width // (8 * wide)), -(-height // (8 * tall))
    planes = [np.zeros((rows * c.down, columns * c.across, 64)) for c in parts]
    end = data.find(b"\xff\xd9", start)
    if end < 0:
        return None  # cut short
    runs = [_Bits(s.replace(b"\xff\x00", b"\xff")) for s in _RESTART.split(data[start:end])]
    unit, last, found = 0, [0] * len(parts), [([], []) for _ in parts]
    for row in range(rows):
        for column in range(columns):
            bits = runs[unit // every] if every else runs[0]
            if every and unit % every == 0:
                last = [0] * len(parts)
            for i, c in enumerate(parts):
                for y in range(c.down):
                    for x in range(c.across):
                        base = ((row * c.down + y) * columns * c.across + column * c.across + x) * 64
                        last[i] = _block(bits, c, last[i], base, *found[i])
            unit += 1
    out = []
    for c, plane, (places, values) in zip(parts, planes, found):
        plane.reshape(-1)[places] = values
        flat = np.zeros_like(plane)
        flat[..., _PLACES] = plane * quant[c.table]
        px = np.einsum("ki,abkl,lj->aibj", _BASIS, flat.reshape(*plane.shape[:2], 8, 8), _BASIS) + 128
        px = px.reshape(plane.shape[0] * 8, plane.shape[1] * 8)
        out.append(px.repeat(tall // c.down, 0).repeat(wide // c.across, 1)[:height, :width])
    if len(out) == 1:
        out *= 3
    elif mixed is not False:  # luminance and two colour differences
        y, b, r = out[0], out[1] - 128, out[2] - 128
        out = [y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b]
    return np.clip(np.rint(np.dstack(out)), 0, 255).astype(np.uint8)
