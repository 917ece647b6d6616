"""A small decoder of PNG images without interlacing (8 and 16 bit), for depth images."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width[, channels]) of a PNG file's bytes; ValueError for what isn't one."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, packed, header = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if header is None:
        raise ValueError("a PNG image without a header")
    width, height, depth, colour, _, _, interlaced = header
    if depth not in (8, 16) or colour not in _CHANNELS or interlaced:
        raise ValueError(f"PNG kind not supported: depth {depth}, colour {colour}, interlaced {interlaced}")
    step = _CHANNELS[colour] * depth // 8
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), dtype=np.uint8)
    above = np.zeros(width * step, dtype=np.uint8)
    for y in range(height):
        above = out[y] = _unfiltered(int(raw[y, 0]), raw[y, 1:], above, step)
    pixels = out.view(">u2").astype(np.uint16) if depth == 16 else out
    pixels = pixels.reshape(height, width, _CHANNELS[colour])
    return pixels[:, :, 0] if _CHANNELS[colour] == 1 else pixels


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.add.accumulate(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    got, up = line.tolist(), above.tolist()
    for i, x in enumerate(got):
        left, corner = (got[i - step], up[i - step]) if i >= step else (0, 0)
        if kind == 3:
            guess = (left + up[i]) // 2
        else:
            p = left + up[i] - corner
            guess = min((abs(p - left), 0, left), (abs(p - up[i]), 1, up[i]), (abs(p - corner), 2, corner))[2]
        got[i] = (x + guess) & 255
    return np.array(got, dtype=np.uint8)


def encode16(pixels: np.ndarray) -> bytes:
    """A grey 16-bit PNG file of an array (height, width)."""
    height, width = pixels.shape
    lines = np.zeros((height, 1 + 2 * width), dtype=np.uint8)
    lines[:, 1:] = np.ascontiguousarray(pixels, dtype=">u2").view(np.uint8)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 16, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")
