"""Sums by key inside a task, so that what is shuffled is one row per key and task and not one per occurrence.

Keys are 64-bit hashes that name a label (words, a group) within one task; across tasks rows meet by
their labels, never by the hash.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

HELD = 400_000


class Held(NamedTuple):
    """Rows of a tally, one per key: sums, Arrow columns and numbers that go with the key."""

    keys: np.ndarray
    sums: list[np.ndarray]
    labels: list[pa.Array]
    parts: list[np.ndarray]


class Tally:
    """Adds up columns of sums; holds at most twice `limit` keys before it asks to be drained.

    Rows of one key whose `parts` differ stay apart, so that where parts are given a hash need not be right.
    """

    def __init__(self, limit: int = HELD):
        self.limit, self.rows, self.pending = limit, [], 0

    def add(self, keys: np.ndarray, sums: list[np.ndarray], labels: list[pa.Array] = (), parts: list[np.ndarray] = ()) -> bool:
        """True when the rows held are too many to go on without `drain`."""
        if len(keys):
            self.rows.append(_merged([Held(keys, sums, labels, parts)]))
            self.pending += len(self.rows[-1].keys)
        if self.pending > 2 * self.limit:
            self._compact()
        return self.pending > self.limit

    def _compact(self) -> None:
        self.rows = [_merged(self.rows)]
        self.pending = len(self.rows[0].keys)

    def drain(self) -> Held | None:
        """All rows held in the order of the keys; None when there are none."""
        if not self.rows:
            return None
        self._compact()
        (out,), self.rows, self.pending = self.rows, [], 0
        return out


def _merged(rows: list[Held]) -> Held:
    keys = np.concatenate([r.keys for r in rows])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    parts = [np.concatenate(c)[order] for c in zip(*(r.parts for r in rows), strict=True)]
    for part in parts:
        new[1:] |= part[1:] != part[:-1]
    starts = np.flatnonzero(new)
    sums = [np.add.reduceat(np.concatenate(c)[order], starts) for c in zip(*(r.sums for r in rows), strict=True)]
    first = pa.array(order[starts])
    labels = [(c[0] if len(c) == 1 else pa.concat_arrays(c)).take(first) for c in zip(*(r.labels for r in rows), strict=True)]
    return Held(keys[starts], sums, labels, [part[starts] for part in parts])


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z, nothing else changed."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table[data]


def word_strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans of UTF-8 bytes as an Arrow column; spans rise and don't overlap."""
    step = np.zeros(len(data) + 1, np.int8)
    step[starts] += 1
    step[ends] -= 1
    inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside].tobytes()))
