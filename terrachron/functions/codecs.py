"""Binary codecs of tile packets and image payloads, vectorised where bytes are many."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Fixed values of the formats.
PACKET_MAGIC, PACKED_MAGIC, HEADER_BYTES, RECORD_BYTES = 32301, 0x7468DEAD, 32, 32
CACHE_BIT, VECTOR_BIT, IMAGE_BIT, TERRAIN_BIT = 4, 5, 6, 7
SIGNATURES = {b"\xff\xd8\xff": ("jpeg", "image/jpeg"), b"\x89PNG\r\n\x1a\n": ("png", "image/png"), b"RIFF": ("webp", "image/webp")}


def key_places(n: int, key_bytes: int) -> np.ndarray:
    """Which byte of the key meets each of ``n`` payload bytes.

    Reading starts at 16, takes eight and passes over sixteen, and beyond the key's
    end goes on from ``(place + 8) % 24``; so the places do not depend on the data
    and repeat once the starting place does.
    """
    if key_bytes <= 0:
        raise ValueError("the key is empty")
    places, seen, at = [], {}, 16
    while at not in seen:
        seen[at] = len(places)
        places.append(at)
        at += 17 if at % 8 == 7 else 1
        at = at if at < key_bytes else (at + 8) % 24
    order = np.array(places)
    if n <= len(order):
        return order[:n]
    loop = order[seen[at] :]
    return np.concatenate([order, np.tile(loop, -(-(n - len(order)) // len(loop)))])[:n]


def unmask(data: bytes, key: bytes) -> bytes:
    """Exclusive-or with the key's byte at each place; applying it twice gives the data back."""
    k = np.frombuffer(key, np.uint8)
    return (np.frombuffer(data, np.uint8) ^ k[key_places(len(data), len(key))]).tobytes()


def inflate(data: bytes) -> bytes:
    """The payload behind a header of magic and size in either byte order."""
    if len(data) < 8:
        raise ValueError("no room for a compression header")
    order = {PACKED_MAGIC: "<", int.from_bytes(PACKED_MAGIC.to_bytes(4, "little"), "big"): ">"}.get(struct.unpack_from("<I", data)[0])
    if order is None:
        raise ValueError("unknown compression header")
    (size,) = struct.unpack_from(order + "I", data, 4)
    out = zlib.decompress(data[8:])
    if len(out) != size:
        raise ValueError(f"{len(out)} bytes where {size} were declared")
    return out


def deflate(data: bytes) -> bytes:
    return struct.pack("<II", PACKED_MAGIC, len(data)) + zlib.compress(data)


RECORD = np.dtype(
    [("children", "<u2"), ("cache", "<i2"), ("image", "<i2"), ("terrain", "<i2"), ("channels", "<i2"), ("pad", "<u2"), ("types", "<i4"), ("versions", "<i4"), ("near", "<i8"), ("image_provider", "u1"), ("terrain_provider", "u1"), ("pad2", "<u2")]
)


def number(digits: list[int], root: bool) -> int:
    """A node's number in its packet from its digits below the packet's top."""
    n = 0
    for d in digits if root else digits[1:]:
        n = 4 * n + d + 1
    return n if root or not digits else digits[0] * 85 + 1 + n


def parse_packet(data: bytes, root: bool) -> tuple[int, list[tuple]]:
    """``(epoch, nodes)`` of a packet; a node is ``(number, children, epoch, layers)``.

    Records stand in depth-first order, and the low four bits say which children
    follow. A layer is ``(type, epoch, provider)``: 0 imagery, 1 terrain, 2 vector.
    """
    if len(data) < HEADER_BYTES:
        raise ValueError("no room for a packet header")
    magic, _, epoch, n, size, at, _, _ = struct.unpack_from("<IIiiiiii", data)
    if magic != PACKET_MAGIC:
        raise ValueError(f"bad packet magic {magic}")
    if n and (at != HEADER_BYTES + n * size or size != RECORD_BYTES or len(data) < at):
        raise ValueError("the packet's records do not fill the space before its data")
    records = np.frombuffer(data, RECORD, n, HEADER_BYTES)
    nodes, stack = [], [[]] if n else []
    for r in records:
        if not stack:
            break
        digits = stack.pop()
        bits = int(r["children"])
        layers = []
        if bits >> IMAGE_BIT & 1:
            layers.append((0, int(r["image"]), int(r["image_provider"])))
        if bits >> TERRAIN_BIT & 1:
            layers.append((1, int(r["terrain"]), int(r["terrain_provider"])))
        if bits >> VECTOR_BIT & 1:
            layers.append((2, 0, 0))
        nodes.append((number(digits, root), bits, int(r["cache"]), layers))
        stack += [[*digits, k] for k in (3, 2, 1, 0) if bits >> k & 1]
    return epoch, nodes


def build_packet(nodes: list[tuple[int, int, int]], epoch: int = 1) -> bytes:
    """A packet of ``(children bits, cache epoch, image epoch)`` records in depth-first order."""
    records = np.zeros(len(nodes), RECORD)
    for r, (bits, cache, image) in zip(records, nodes):
        r["children"], r["cache"], r["image"] = bits, cache, image
    at = HEADER_BYTES + len(nodes) * RECORD_BYTES
    return struct.pack("<IIiiiiii", PACKET_MAGIC, 1, epoch, len(nodes), RECORD_BYTES, at, 0, 0) + records.tobytes()


def image_header(data: bytes | None) -> tuple[str, str, int, int] | None:
    """``(format, media type, width, height)`` of a PNG, JPEG or WebP payload; None for anything else."""
    if not data:
        return None
    kind = next((v for k, v in SIGNATURES.items() if data.startswith(k)), None)
    try:
        if kind is None:
            return None
        if kind[0] == "png":
            w, h = struct.unpack_from(">II", data, 16)
        elif kind[0] == "webp":
            if data[8:12] != b"WEBP":
                return None
            if data[12:16] == b"VP8X":
                w, h = (int.from_bytes(data[i : i + 3], "little") + 1 for i in (24, 27))
            elif data[12:16] == b"VP8L":
                bits = int.from_bytes(data[21:25], "little")
                w, h = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
            else:
                w, h = (x & 0x3FFF for x in struct.unpack_from("<HH", data, 26))
        else:
            at, w, h = 2, 0, 0
            while at + 9 < len(data):
                if data[at] != 0xFF:
                    return None
                mark = data[at + 1]
                if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack_from(">HH", data, at + 5)
                    break
                at += 2 + struct.unpack_from(">H", data, at + 2)[0]
        return (*kind, w, h) if w and h else None
    except struct.error:
        return None


def write_png(pixels: np.ndarray) -> bytes:
    """A PNG of ``(h, w)`` grey or ``(h, w, 3 or 4)`` colour bytes."""
    a = pixels[..., None] if pixels.ndim == 2 else pixels
    h, w, bands = a.shape
    lines = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, w * bands)], axis=1)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[bands], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray | None:
    """The ``(h, w, 3)`` pixels of an 8-bit PNG without interlace; None if it can't be read.

    Grey is tripled, and bands after the third are cut.
    """
    try:
        info = image_header(data)
        if info is None or info[0] != "png":
            return None
        _, _, w, h = info
        depth, colour, _, _, lace = data[24:29]
        bands = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
        if depth != 8 or lace or bands is None:
            return None
        at, body = 8, []
        while at < len(data):
            n, kind = struct.unpack_from(">I4s", data, at)
            if kind == b"IDAT":
                body.append(data[at + 8 : at + 8 + n])
            at += 12 + n
        raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * bands)
        out = np.zeros((h + 1, w + 1, bands), np.int64)
        for y in range(h):
            f, line, up = raw[y, 0], raw[y, 1:].reshape(w, bands).astype(np.int64), out[y]
            if f == 0:
                out[y + 1, 1:] = line
            elif f == 1:
                out[y + 1, 1:] = np.cumsum(line, axis=0) & 255
            elif f == 2:
                out[y + 1, 1:] = (line + up[1:]) & 255
            else:
                for x in range(w):
                    a, b, c = out[y + 1, x], up[x + 1], up[x]
                    if f == 3:
                        guess = (a + b) // 2
                    else:
                        p = a + b - c
                        pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                        guess = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
                    out[y + 1, x + 1] = (line[x] + guess) & 255
        px = out[1:, 1:].astype(np.uint8)
        px = px[..., :1] if bands == 2 else px
        return np.repeat(px, 3, axis=2) if px.shape[2] == 1 else px[..., :3]
    except (struct.error, zlib.error, ValueError):
        return None
