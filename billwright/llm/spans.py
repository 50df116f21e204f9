"""Words of Arrow text columns as arrays: where they start and end, and their hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words of letters and digits (everything outside ASCII included), and of words between white space.
WORD = np.array([c >= 0x80 or chr(c).isalnum() and not 65 <= c <= 90 for c in range(256)])
NOT_SPACE = np.array([c != 0x20 and not 0x09 <= c <= 0x0D for c in range(256)])

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20).integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to n - 1, modulo 2 ** 64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
        have += more
    return out


class _Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = powers(_BASE, 2 * n), powers(_INVERSE, 2 * n)
        return cls.up, cls.down


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, null as empty, and the n + 1 places where texts start."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of each text (n + 1 places)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind[data]
    at_start = inside[1:-1] & ~inside[:-2]
    at_end = inside[1:-1] & ~inside[2:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    at_start[edges] = inside[edges + 1]
    at_end[edges - 1] = inside[edges]
    starts = np.flatnonzero(at_start)
    return starts, np.flatnonzero(at_end) + 1, np.searchsorted(starts, offsets)


def prefix_sums(data: np.ndarray, which: int) -> np.ndarray:
    """Sums from which the hash of any stretch of bytes follows: see ``stretch_hash``."""
    _, down = _Powers.of(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[which][data] * down[: len(data)], out=sums[1:])
    return sums


def stretch_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches; they depend on the bytes only, not on their place."""
    up, _ = _Powers.of(len(sums))
    return mixed((sums[ends] - sums[starts]) * up[starts] + (ends - starts).astype(np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The stretches of bytes as an Arrow column."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    places = np.arange(offsets[-1], dtype=np.int64) + np.repeat(starts - offsets[:-1], lengths)
    return pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[places].tobytes())])
