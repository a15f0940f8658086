"""Words of Arrow text columns as numpy arrays: spans over the UTF-8 bytes and 64-bit hashes.

A batch is worked on in slices of about a quarter of a megabyte (or one text, if that is longer), so memory
follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
_STATE: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of texts; null is the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def spans(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of one non-zero kind within a text: starts, ends, and the first run of each text."""
    n = len(data)
    kind = kinds[data]
    new = np.empty(n + 1, bool)
    new[0] = new[n] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:n])
    new[offsets] = True
    cuts = np.flatnonzero(new)
    starts, ends = cuts[:-1], cuts[1:]
    inside = kind[starts] != 0 if n else np.zeros(0, bool)
    starts, ends = starts[inside], ends[inside]
    return starts, ends, np.searchsorted(starts, offsets)


def blank_kinds() -> np.ndarray:
    kinds = np.ones(256, np.uint8)
    kinds[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
    return kinds


def powers(n: int) -> np.ndarray:
    """Powers of a fixed odd number and of its inverse, n at least; kept in the worker up to a slice, made anew for longer texts."""
    if n > SLICE_BYTES + 1 or "powers" not in _STATE:
        both = np.empty((2, max(n, SLICE_BYTES + 1)), np.uint64)
        both[:, 0] = 1
        both[0, 1:] = np.uint64(0xD6E8FEB86659FD93)
        both[1, 1:] = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
        np.multiply.accumulate(both, axis=1, out=both)
        if n > SLICE_BYTES + 1:
            return both
        _STATE["powers"] = both
    return _STATE["powers"]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 7) -> np.ndarray:
    """A 64-bit hash of each span, from one running sum over the bytes."""
    n = len(data)
    up, inverses = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(constants(256, seed)[data] * up[:n], out=total[1:])
    h = (total[ends] - total[starts]) * inverses[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive values; runs over text borders, which the caller masks."""
    k = constants(n, 11)
    count = max(0, len(h) - n + 1)
    g = np.zeros(count, np.uint64)
    for j in range(n):
        g += mix(h[j : j + count] + k[j])
    return mix(g)


def whole(first: np.ndarray, n: int, count: int) -> np.ndarray:
    """Which of `count` gram positions hold n values of one text."""
    ok = np.ones(count + n, bool)
    for back in range(1, n):
        at = first[1:-1] - back
        ok[at[at >= 0]] = False
    return ok[:count]


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive values from one running sum."""
    count = max(0, len(h) - n + 1)
    up, inverses = powers(len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[n : n + count] - total[:count]) * inverses[:count])
