"""Vectorised hashes of byte strings: all windows of a buffer at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

PRIME = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(PRIME, -1, 1 << 64)


@lru_cache(maxsize=4)
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """S with S[i] the weighted sum of the first i values; the hash of values[i:j] is (S[j] - S[i]) / PRIME^i."""
    n = 1 << max(int(len(values)).bit_length(), 10)
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values.astype(np.uint64) * powers(PRIME, n)[: len(values)], out=out[1:])
    return out


def ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges; equal contents have equal hashes wherever they are."""
    n = 1 << max(int(len(sums)).bit_length(), 10)
    return mixed((sums[end] - sums[start]) * powers(INVERSE, n)[start])


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The position of the leftmost minimum (of the upper 40 bits) in each window of ``width``; for up to 2^24 values."""
    at = (values & ~np.uint64(0xFFFFFF)) | np.arange(len(values), dtype=np.uint64)
    pad = -len(at) % width
    blocks = np.concatenate([at, np.full(pad, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)


def pieces(texts: pa.Array, overlap: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Binary texts as buffers of about ``most`` bytes: (buffer, start of each part in it, its text's position, its offset in the text).

    Longer texts are cut into parts that overlap by ``overlap`` bytes."""
    held: list[np.ndarray] = []
    of: list[int] = []
    off: list[int] = []
    size = 0

    def done() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        start = np.concatenate([[0], np.cumsum([len(x) for x in held])])
        return np.concatenate(held), start, np.array(of), np.array(off)

    for i in range(len(texts)):
        value = texts[i].as_buffer()
        if value is None:
            continue
        data = np.frombuffer(value, dtype=np.uint8)
        for at in range(0, max(len(data) - overlap, 1), most - overlap):
            part = data[at : at + most]
            held.append(part)
            of.append(i)
            off.append(at)
            size += len(part)
            if size >= most:
                yield done()
                held, of, off, size = [], [], [], 0
    if held:
        yield done()
