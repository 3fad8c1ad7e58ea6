"""Vectorised word handling on Arrow buffers, shared by the text operators.

Texts are read straight from Arrow's UTF-8 buffers: a batch is one ``uint8``
array plus row offsets, so finding words, folding case and hashing are numpy
operations over bytes and no Python string is made. Batches are cut into runs of
rows, and ``cut`` cuts a long text further where an operator's working memory is
many times the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes handled at once by one numpy step.
BLOCK_BYTES = 1 << 20
LONG_SPAN = 64

_MULT = 0x9E3779B97F4A7C15 | 1
_U64 = (1 << 64) - 1
_INV = pow(_MULT, -1, 1 << 64)


def fold_table() -> np.ndarray:
    """Byte table that maps A-Z to a-z and leaves all else."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


FOLD = fold_table()
#: Bytes that belong to a word when words end at white space only.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words made of a-z, 0-9 and everything beyond ASCII (after folding).
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


def row_slices(batch: pa.RecordBatch, column: str, most_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Cut a batch into runs of rows of about ``most_bytes`` of text; one long row stands alone."""
    arr = batch.column(batch.schema.get_field_index(column))
    _, offs = buffers(arr)
    start, n = 0, batch.num_rows
    while start < n:
        stop = int(np.searchsorted(offs, offs[start] + most_bytes, "right")) - 1
        stop = min(n, max(stop, start + 1))
        yield start, batch.slice(start, stop - start)
        start = stop


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string array; a null counts as the empty text."""
    if arr.null_count:
        arr = arr.fill_null("")
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, o, d = arr.buffers()
    offs = np.frombuffer(o, np.int64, n + 1, arr.offset * 8)
    data = np.frombuffer(d, np.uint8) if d is not None and d.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of bytes that ``table`` marks, in order; runs end with their row."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = table[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offs[(offs > 0) & (offs < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(offs, s, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (Steele, Lea and Flood's SplitMix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POW or len(_POW["p"]) < n:
        size = max(n, 2 * BLOCK_BYTES)
        for key, m in (("p", _MULT), ("q", _INV)):
            a = np.full(size, m, np.uint64)
            a[0] = 1
            _POW[key] = np.cumprod(a, dtype=np.uint64)
    return _POW["p"], _POW["q"]


def cut(data: np.ndarray, offs: np.ndarray, most: int, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, row of each piece) of runs of rows of about ``most`` bytes; a longer row comes in pieces, each with ``overlap`` bytes of the next."""
    n = np.diff(offs)
    pieces = np.maximum(-(-n // most), 1)
    row = np.repeat(np.arange(len(n)), pieces)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = offs[:-1][row] + nth * most
    stop = np.minimum(begin + most, offs[1:][row])
    i = 0
    while i < len(row):
        j = max(i + 1, int(np.searchsorted(stop, begin[i] + most, "right")))
        # a piece that its row goes on behind stands last, so the overlap is of no other row
        more = int(min(overlap, offs[row[j - 1] + 1] - stop[j - 1]))
        yield data[begin[i] : stop[j - 1] + more], np.append(begin[i:j], stop[j - 1] + more) - begin[i], row[i:j]
        i = j


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes; equal bytes give equal values wherever they stand.

    A polynomial modulo 2^64 for spans of LONG_SPAN bytes or fewer; it has weak
    spots in longer ones, which have XXH64 instead.
    """
    out = np.empty(len(s), np.uint64)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + BLOCK_BYTES, "right")))
        lo, hi = int(s[i]), int(e[j - 1])
        p, q = _powers(hi - lo + 1)
        acc = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * p[: hi - lo], out=acc[1:])
        a, b = s[i:j] - lo, e[i:j] - lo
        out[i:j] = mix((acc[b] - acc[a]) * q[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    for k in np.flatnonzero(e - s > LONG_SPAN).tolist():
        out[k] = xxhash.xxh64_intdigest(data[s[k] : e[k]].tobytes(), 7)
    return out


def rows_of(row: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each row's items, for items in row order."""
    return np.searchsorted(row, np.arange(n + 1))
