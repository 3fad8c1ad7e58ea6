"""Benchmark decontamination: prefix-filtered set join of item windows with documents.

A window is 10 consecutive words of a benchmark item (all its words if it has
fewer) and is contained in a document where the same words stand in a row. A
window is a set of shingles of up to three words, and a document that contains
it has them all, so the join needs one of them: the window's prefix under an
order by rarity in the documents is its rarest shingle. Each occurrence of that
shingle fixes where the window would begin; length and position are checked
against the document's ends, the words' hashes are compared one by one, and what
is left is compared byte by byte, so that no collision counts.

The items are the stated query set and go to the tasks in blocks of bounded
size, one block at a time; documents never leave their task, so no key can be
hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pedon.llm import textkit as tk
from pedon.llm.graph import durable

WINDOW = 10
SHINGLE = 3
#: Bytes of benchmark text in a block, whose index takes some ten times as much; a larger benchmark takes more passes.
BLOCK_BYTES = 4 << 20
_BITS = 20


def _shingles(h: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that begin at each word; only those that end in the same row mean anything."""
    n = len(h)
    out = np.full(n, np.uint64(k), np.uint64)
    for j in range(k):
        part = np.zeros(n, np.uint64)
        part[: n - j] = h[j:]
        out = (out + part) * np.uint64(0xD1342543DE82EF95)
    return tk.mix(out)


def _fits(row: np.ndarray, k: int) -> np.ndarray:
    """Whether k words from each word on stand in the same row."""
    ok = np.zeros(len(row), bool)
    if len(row) >= k:
        ok[: len(row) - k + 1] = row[: len(row) - k + 1] == row[k - 1 :]
    return ok


def _words(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of the words, and the folded bytes that they stand in."""
    data, offs = tk.buffers(arr)
    data = tk.FOLD[data]
    s, e, row = tk.words(data, offs, tk.ALNUM)
    return tk.span_hashes(data, s, e), row, s, e, data


class _Index:
    """Words of a block of items, and the windows that begin at them.

    A window is the number of its first word; its shingles are hashes of the
    words that begin there and after.
    """

    def __init__(self, ids: list, texts: list, size: int) -> None:
        self.h, row, self.s, self.e, data = _words(pa.array(texts, pa.large_string()))
        self.data = data.copy()
        self.items = ["" if i is None else str(i) for i in ids]
        n = np.diff(tk.rows_of(row, len(ids)))
        if not len(self.h):
            return
        # an item of fewer words than a window is one window
        left = np.cumsum(n)[row] - np.arange(len(row))
        self.first = np.flatnonzero((left >= size) | ((n[row] < size) & (left == n[row])))
        self.length = np.minimum(n[row[self.first]], size)
        self.item = row[self.first]
        self.sizes = sorted({min(SHINGLE, int(x)) for x in np.unique(self.length)})
        self.of = {k: _shingles(self.h, row, k) for k in self.sizes}
        self.keys = np.unique(np.concatenate([self.of[k][_fits(row, k)] for k in self.sizes]))
        self._table(self.keys)

    def _table(self, keys: np.ndarray) -> None:
        self.look = np.zeros(1 << _BITS, bool)
        self.look[(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.at = keys

    def hits(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, index into ``at``) of each document shingle that is one of ``at``."""
        pos, key = [], []
        for k in self.sizes:
            g = _shingles(h, row, k)
            p = np.flatnonzero(self.look[(g >> np.uint64(64 - _BITS)).astype(np.int64)] & _fits(row, k))
            i = np.minimum(np.searchsorted(self.at, g[p]), len(self.at) - 1)
            ok = self.at[i] == g[p]
            pos.append(p[ok])
            key.append(i[ok])
        return np.concatenate(pos), np.concatenate(key)

    def keep_prefixes(self, counts: np.ndarray) -> None:
        """counts: how often the documents have each of ``keys``; keep each window's rarest shingle."""
        rarest = np.full(len(self.first), -1)
        offset = np.zeros(len(self.first), np.int64)
        for n in np.unique(self.length):
            at = np.flatnonzero(self.length == n)
            k = min(SHINGLE, int(n))
            for o in range(int(n) - k + 1):
                key = np.searchsorted(self.keys, self.of[k][self.first[at] + o])
                # equal windows choose alike: by count, then by hash
                better = (rarest[at] < 0) | (counts[key] < counts[rarest[at]]) | ((counts[key] == counts[rarest[at]]) & (key < rarest[at]))
                rarest[at[better]], offset[at[better]] = key[better], o
        order = np.argsort(rarest, kind="stable")
        self.first, self.length, self.item, self.offset = self.first[order], self.length[order], self.item[order], offset[order]
        used, begin = np.unique(rarest[order], return_index=True)
        self.begin = np.append(begin, len(order))
        self._table(self.keys[used])
        del self.keys, self.of

    def contained(self, h: np.ndarray, row: np.ndarray, s: np.ndarray, e: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence of a window."""
        pos, key = self.hits(h, row)
        n = self.begin[key + 1] - self.begin[key]
        pos = np.repeat(pos, n)
        win = np.repeat(self.begin[key], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = pos - self.offset[win]
        size = self.length[win]
        ok = (start >= 0) & (start + size <= len(h))
        start, win, size, pos = start[ok], win[ok], size[ok], pos[ok]
        ok = (row[start] == row[pos]) & (row[start + size - 1] == row[pos])
        start, win, size = start[ok], win[ok], size[ok]
        ok = np.ones(len(start), bool)
        for j in range(int(size.max()) if len(size) else 0):
            inside = j < size
            ok &= ~inside | (h[np.minimum(start + j, len(h) - 1)] == self.h[np.minimum(self.first[win] + j, len(self.h) - 1)])
        start, win, size = start[ok], win[ok], size[ok]
        ok = self._same_bytes(start, self.first[win], size, s, e, data)
        return start[ok], win[ok]

    def _same_bytes(self, mine: np.ndarray, its: np.ndarray, size: np.ndarray, s: np.ndarray, e: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Whether the words from ``mine`` on have the bytes of the items' words from ``its`` on; each pair of words is compared once."""
        if not len(mine):
            return np.zeros(0, bool)
        of = np.repeat(np.arange(len(mine)), size)
        step = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        pair = (mine[of] + step) * len(self.h) + its[of] + step
        pairs, back = np.unique(pair, return_inverse=True)
        a, b = pairs // len(self.h), pairs % len(self.h)
        n = e[a] - s[a]
        same = n == self.e[b] - self.s[b]
        i = 0
        while i < len(pairs):  # by blocks of bytes
            j = max(i + 1, int(np.searchsorted(np.cumsum(n[i:]), tk.BLOCK_BYTES, "right")) + i)
            at = np.flatnonzero(same[i:j]) + i
            m = n[at]
            shift = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            equal = data[np.repeat(s[a[at]], m) + shift] == self.data[np.repeat(self.s[b[at]], m) + shift]
            if len(at):
                same[at] = np.logical_and.reduceat(equal, np.cumsum(m) - m)
            i = j
        return np.logical_and.reduceat(same[back], np.cumsum(size) - size)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[tuple[list, list]]:
    """Items in blocks of about ``most`` bytes, one on the driver at a time."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // most))
    for b in range(n):
        part = (items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)).toArrow()
        yield part.column(0).to_pylist(), part.column(1).to_pylist()


def _index(spark: SparkSession, docs: DataFrame, text_col: str, ids: list, texts: list, size: int):
    """The block's index with its prefixes chosen, as a broadcast variable; None if no item has words."""
    index = _Index(ids, texts, size)
    if not len(index.h):
        return None
    whole = spark.sparkContext.broadcast(index)

    def count(batches):
        total = np.zeros(len(whole.value.keys), np.int64)
        for batch in batches:
            for _, part in tk.row_slices(batch, "text"):
                total += np.bincount(whole.value.hits(*_words(part.column(0))[:2])[1], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["key", "n"])

    seen = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(index.keys), np.int64)
    counts[seen.column(0).to_numpy()] = seen.column(1).to_numpy()
    whole.unpersist()
    index.keep_prefixes(counts)
    return spark.sparkContext.broadcast(index)


def _scan(index, spans: bool):
    """A task's function: (id, n_words, hit, items) of each row; hit has the words hit, or their number alone."""

    def run(batches):
        for batch in batches:
            for _, part in tk.row_slices(batch, "text"):
                h, row, s, e, data = _words(part.column(1))
                n = part.num_rows
                bounds = tk.rows_of(row, n)
                items: list[list[str]] = [[] for _ in range(n)]
                hit = np.zeros(len(h) + 1, np.int64)
                if index is not None and len(h):
                    ix = index.value
                    start, win = ix.contained(h, row, s, e, data)
                    np.add.at(hit, start, 1)
                    np.add.at(hit, start + ix.length[win], -1)
                    found = np.unique(row[start] * len(ix.items) + ix.item[win])
                    for r, i in zip((found // len(ix.items)).tolist(), (found % len(ix.items)).tolist(), strict=True):
                        items[r].append(ix.items[i])
                inside = np.cumsum(hit)[: len(h)] > 0
                if spans:
                    hits = [np.flatnonzero(inside[a:b]).tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                else:
                    hits = [[x] for x in np.diff(np.concatenate([[0], np.cumsum(inside)])[bounds]).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))],
                    names=["id", "n_words", "hit", "items"],
                )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: (id_col, n_words, n_hit, items array<string>).

    n_hit counts the words inside any occurrence of a window; items are the ids
    (as strings, sorted as such) of the items with an occurring window. Null
    and empty texts have no words; items without words match nothing; items
    with one text share its windows. A null item id counts as ''. Rows of
    ``docs`` that repeat get the same result each. Of a benchmark of several
    blocks one index exists at a time: each block's hits are written before
    the next index is built.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    out = "id {}, n_words long, hit array<long>, items array<string>"
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        found = docs.mapInArrow(_scan(_index(spark, docs, "text", *first, window), False), out.format(kind))
        return found.select(F.col("id").alias(id_col), "n_words", F.col("hit")[0].alias("n_hit"), "items")
    # several blocks: positions that they hit are united by row
    key = docs.select("id", F.xxhash64("text").alias("_h1"), F.md5(F.coalesce("text", F.lit(""))).alias("_h2"), "text")
    key = key.select(F.struct("id", "_h1", "_h2").alias("id"), "text")
    kind = key.schema["id"].dataType.simpleString()
    parts = None
    for ids, texts in chain([first, second], blocks):
        index = _index(spark, docs, "text", ids, texts, window)
        if index is not None:
            part = durable(key.mapInArrow(_scan(index, True), out.format(kind)).where("size(items) > 0"))
            parts = part if parts is None else parts.unionByName(part)
            index.destroy()
    base = key.mapInArrow(_scan(None, False), out.format(kind)).select("id", "n_words")
    if parts is None:
        return base.select(base["id"]["id"].alias(id_col), "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    found = parts.groupBy("id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("hit")))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return base.join(found, base["id"].eqNullSafe(found["id"]), "left").select(
        base["id"]["id"].alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with all its columns, without the rows in which a window of an item occurs; block by block.

    Rows with null or empty text stay, and so do rows with null ids, for ids
    aren't looked at; rows that repeat stay or go together. Of a benchmark of
    several blocks one index exists at a time: what each block leaves is
    written before the next index is built.
    """
    at = docs.columns.index(text_col)

    def scan(index):
        def run(batches):
            for batch in batches:
                for _, part in tk.row_slices(batch, text_col):
                    words = _words(part.column(at))
                    clean = np.ones(part.num_rows, bool)
                    if len(words[0]):
                        clean[words[1][index.value.contained(*words)[0]]] = False
                    yield part.filter(pa.array(clean))

        return run

    out, before = docs, None
    for ids, texts in _blocks(benchmark, item_col, item_text_col, block_bytes):
        if before is not None:
            out = durable(out)
            before.destroy()
        before = _index(docs.sparkSession, out, text_col, ids, texts, window)
        if before is not None:
            out = out.mapInArrow(scan(before), docs.schema)
    return out
