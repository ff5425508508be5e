"""Integer arrays as compressed bytes, for shuffles of many small numbers."""

from __future__ import annotations

import struct

import numpy as np
import zstandard


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned integers in as few byte planes as their largest needs, or doubles; one zstd frame."""
    head, body = [struct.pack("<I", len(arrays))], []
    for a in arrays:
        real = a.dtype.kind == "f"
        raw = np.ascontiguousarray(a, "<f8" if real else "<u8")
        width = 8 if real else max(1, (int(raw.max()).bit_length() + 7) // 8 if len(raw) else 1)
        head.append(struct.pack("<QBB", len(raw), width, real))
        planes = raw.view(np.uint8).reshape(-1, 8)[:, :width]
        body.append(np.ascontiguousarray(planes.T).tobytes())
    return zstandard.ZstdCompressor(level=9).compress(b"".join(head + body))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = struct.unpack_from("<I", raw)[0]
    heads = [struct.unpack_from("<QBB", raw, 4 + 10 * k) for k in range(n)]
    at, out = 4 + 10 * n, []
    for length, width, real in heads:
        planes = np.frombuffer(raw, np.uint8, length * width, at).reshape(width, length)
        full = np.zeros((length, 8), np.uint8)
        full[:, :width] = planes.T
        out.append(full.view("<f8" if real else "<u8").ravel())
        at += length * width
    return out
