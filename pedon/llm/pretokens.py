"""Pre-tokens of byte-level BPE found on Arrow buffers.

The pattern is the published one of these vocabularies: contractions, letters,
numbers and other signs with one space in front at most, and white space without
the last space before a word. Its alternatives are said here by the kinds of
neighbouring code points, so a slice of texts is cut by numpy at once.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np

from pedon.llm import textkit as tk

OTHER, LETTER, NUMBER, SPACE, UNSURE = range(5)
# Code points with Unicode's property White_Space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Bytes that a key holds; its 16th is the length.
KEY_BYTES = 15
#: Where a long text may be cut: between a visible ASCII sign and a space.
_SAFE = re.compile(rb"[!-~](?= )")
_KINDS: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Kind of each code point. Those that this Python's Unicode doesn't assign are UNSURE: a library's newer Unicode may."""
    if not _KINDS:
        table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        for c in range(sys.maxunicode + 1):
            kind = unicodedata.category(chr(c))
            if kind[0] in "LN" or kind == "Cn":
                table[c] = {"L": LETTER, "N": NUMBER, "C": UNSURE}[kind[0]]
        table[WHITE] = SPACE
        _KINDS.append(table)
    return _KINDS[0]


def cut_long(raw: bytes, most: int) -> Iterator[bytes]:
    """A text in pieces of about ``most`` bytes that meet where no pre-token goes across; a stretch without such a place stays whole."""
    at = 0
    while len(raw) - at > most:
        found = _SAFE.search(raw, at + most)
        if not found:
            break
        yield raw[at : found.end()]
        at = found.end()
    yield raw[at:]


def spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the pre-tokens of valid UTF-8 rows, as bytes, in order, and the rows that hold an UNSURE code point."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none, none, none
    text = data.tobytes().decode()
    plain = len(text) == len(data)
    cp = data if plain else np.frombuffer(text.encode("utf-32-le"), "<u4")
    at = np.arange(len(cp) + 1) if plain else np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    rows = offs if plain else np.searchsorted(at, offs)
    n, kind = len(cp), kinds()[cp]
    first = np.zeros(n + 1, bool)
    first[rows] = True
    start = np.ones(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    start |= first
    # of white space before something else the last stands alone, or goes with it if it is a space
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n])
    start[last] = True
    start[last[cp[last] == 0x20] + 1] = False
    _contractions(cp, kind, first, start)
    begin = np.flatnonzero(start[:n])
    row = np.searchsorted(rows, begin, "right") - 1
    unsure = np.flatnonzero(kind == UNSURE)
    return at[begin], at[np.append(begin[1:], n)], row, np.unique(np.searchsorted(rows, unsure, "right") - 1)


def _contractions(cp: np.ndarray, kind: np.ndarray, first: np.ndarray, start: np.ndarray) -> None:
    """Join an apostrophe that begins a pre-token with s, d, m, t, ll, ve or re behind it; what follows begins anew."""
    n = len(cp)
    a = np.flatnonzero(cp == ord("'"))
    a = a[a + 1 < n]
    a = a[start[a] & (kind[a + 1] == LETTER) & ~first[a + 1]]
    one = np.isin(cp[a + 1], [ord(c) for c in "sdmt"])
    two, pair = a + 2 < n, np.zeros(len(a), bool)
    two[two] = ~first[a[two] + 2]
    for x, y in ("ll", "ve", "re"):
        pair[two] |= (cp[a[two] + 1] == ord(x)) & (cp[a[two] + 2] == ord(y))
    start[a[one | pair] + 1] = False
    start[a[one] + 2] = True
    start[a[pair] + 3] = True


def keys(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and length of spans of KEY_BYTES bytes at most as two 64-bit numbers: equal keys are equal spans. A span's second number is never 0."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    words = np.ndarray((len(data) + 9,), "<u8", padded.data, strides=(1,))
    size = (e - s).astype(np.uint64)
    masks = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
    lo = words[s] & masks[np.minimum(size, 8)]
    hi = words[s + 8] & masks[np.maximum(size, 8) - np.uint64(8)]
    return lo, hi | size << np.uint64(56)


def spelled(lo: int, hi: int) -> bytes:
    """The span of a key."""
    return (lo.to_bytes(8, "little") + hi.to_bytes(8, "little"))[: hi >> 56]


def key_hash(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return tk.mix(lo ^ tk.mix(hi))


class KeyTable:
    """Open-addressed table from keys to small numbers, half full at most; it compares whole keys."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> None:
        slots = 1 << max(4, (2 * len(lo)).bit_length())
        self.last = np.uint64(slots - 1)
        self.lo, self.hi, self.value = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        left, slot = np.arange(len(lo)), key_hash(lo, hi) & self.last
        while len(left):
            free = np.flatnonzero(self.hi[slot] == 0)
            at, nth = np.unique(slot[free], return_index=True)
            took = free[nth]
            self.lo[at], self.hi[at], self.value[at] = lo[left[took]], hi[left[took]], value[left[took]]
            rest = np.ones(len(left), bool)
            rest[took] = False
            left, slot = left[rest], (slot[rest] + np.uint64(1)) & self.last

    def find(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        out, slot, left = np.full(len(lo), -1, np.int64), key_hash(lo, hi) & self.last, np.arange(len(lo))
        while len(left):
            same = (self.lo[slot] == lo[left]) & (self.hi[slot] == hi[left])
            out[left[same]] = self.value[slot[same]]
            on = ~same & (self.hi[slot] != 0)
            left, slot = left[on], (slot[on] + np.uint64(1)) & self.last
        return out
