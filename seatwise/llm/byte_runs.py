"""Runs of bytes of one class in many texts at once, and their numbering, with numpy and Arrow on the UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def byte_class(of: bytes | bytearray) -> np.ndarray:
    """For each byte value whether ``of`` holds it."""
    held = np.zeros(256, bool)
    held[np.frombuffer(bytes(of), np.uint8)] = True
    return held


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each longest run of bytes marked in ``inside`` that stays in one text, and how many runs precede each text."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside))
    after = np.concatenate((inside, [False]))
    starts = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
    ends = np.flatnonzero(inside & (~after[1:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def numbered(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of each run's string, and the strings by number; exact, no hashes."""
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside])))
    coded = words.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary
