"""Words of many texts at once as 64-bit hashes, with numpy on the UTF-8 bytes.

A word is a run of bytes other than space, \\t, \\n, \\v, \\f and \\r; in UTF-8 these six never occur inside another character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)

_powers: list[np.ndarray] = []


def powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers from 0 to SEGMENT, and their inverses modulo 2 ** 64."""
    if not _powers:
        for base in (int(BASE), pow(int(BASE), -1, 1 << 64)):
            row = np.full(SEGMENT + 1, base, np.uint64)
            row[0] = 1
            _powers.append(np.cumprod(row, dtype=np.uint64))
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each text starts (null as empty)."""
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and how many words precede each text."""
    inside = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets[offsets < len(data)]] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else as it is."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes. Long inputs are taken in segments, so memory stays bounded."""
    power, inverse = powers()
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        at = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, at + SEGMENT, "right")))
        if ends[last - 1] - at > SEGMENT:  # one word longer than a segment
            value = np.uint64(0)
            for i in range(at, ends[first], SEGMENT):
                part = data[i:min(i + SEGMENT, ends[first])].astype(np.uint64) + np.uint64(1)
                value = mix(value + np.sum(part * power[:len(part)], dtype=np.uint64)[None])[0]
            out[first] = value
        else:
            part = data[at:ends[last - 1]].astype(np.uint64) + np.uint64(1)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part * power[:len(part)], dtype=np.uint64)))
            s, e = starts[first:last] - at, ends[first:last] - at
            out[first:last] = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)
        first = last
    return mix(out)
