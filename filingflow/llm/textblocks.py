"""Text columns as flat numpy byte arrays, for vectorised work inside tasks.

A block is a run of whole texts: ``buf`` holds their UTF-8 bytes one after the
other and ``offs[i]:offs[i + 1]`` is text ``i``.  Null texts become empty.
Blocks are cut at about ``BLOCK_BYTES`` so that the 8-byte-per-character
temporaries of a task stay small; a longer text is a block of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

# White space is x20 and x09-x0D; A-Z lower-cased, other bytes as they are.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buf, offs) of a string or binary array, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[offs[0]:offs[-1]], offs - offs[0]


def blocks(column: pa.Array, size: int = BLOCK_BYTES):
    """Yield (first row, row after the last, buf, offs) in row order."""
    if len(column) == 0:
        return
    buf, offs = flat(column)
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, "right")) - 1)
        yield a, b, buf[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
        a = b


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ np.uint64(seed * 0xD6E8FEB86659FD93 % (1 << 64))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        def series(base):
            out = np.empty(n, np.uint64)
            out[0] = 1
            out[1:] = base
            return np.multiply.accumulate(out)
        _POWERS = series(_BASE)
        _INVERSES = series(np.uint64(pow(int(_BASE), -1, 1 << 64)))
    return _POWERS, _INVERSES


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash modulo 2^64."""
    power, _ = _powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, equal for equal bytes wherever they stand."""
    _, inverse = _powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def word_spans(buf: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE):
    """(start, end, text number) of every run of non-space bytes; runs end at text ends."""
    inside = ~space[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    before = np.zeros(len(buf), bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(buf), bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1
