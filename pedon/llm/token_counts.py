"""Token counts of whole texts by a byte-level BPE tokenizer, in two tiers of pre-tokens.

A text's tokens are its pre-tokens' tokens, so its count is a sum of pre-token
lengths. The lengths of the corpus's frequent pre-tokens travel to every task in
one compact hash table of bounded size; what it lacks is encoded once by each
worker and remembered there in a bounded cache. No pre-token is shuffled: of the
first pass, which finds the frequent ones, each task gives its own most frequent
alone. The table saves work only; any table gives the same counts.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedon.llm import pretokens as pt
from pedon.llm import textkit as tk

LIMIT = 512
#: Pre-tokens in the table that travels: 24 bytes each, in twice as many slots.
FREQUENT = 1 << 16
#: A task names the pre-tokens that make up this share of its own, so it gives 1 / SHARE rows at most.
SHARE = 2e-5
#: Distinct pre-tokens that a task counts at once; the rarest half goes beyond that.
COUNTED = 1 << 20
#: Pre-tokens that a worker remembers, twice, each of so many bytes at most.
CACHE, CACHED_BYTES = 1 << 18, 64


class PretokenLengths:
    """Token counts of single pre-tokens, with a bounded memory."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.own = Tokenizer.from_file(path)
        #: strings that the library takes out of a text before it looks for pre-tokens.
        self.special = [t.content.encode() for t in self.own.get_added_tokens_decoder().values()]
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def __call__(self, parts: list[bytes]) -> np.ndarray:
        """The number of tokens of each pre-token."""
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        known, extra = self.young, {}
        fresh = []
        for p in set(parts).difference(known):
            if (n := self.old.get(p)) is None:
                fresh.append(p)
            else:
                known[p] = n
        for i in range(0, len(fresh), 4096):
            part = fresh[i : i + 4096]
            for p, n in zip(part, self.whole(part), strict=True):
                (known if len(p) <= CACHED_BYTES else extra)[p] = n
        return np.array([known[p] if p in known else extra[p] for p in parts], np.int64)

    def whole(self, texts: list[bytes]) -> list[int]:
        return [len(x.ids) for x in self.own.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]


_LENGTHS: dict[str, PretokenLengths] = {}


def _worker(path: str) -> PretokenLengths:
    if path not in _LENGTHS:
        _LENGTHS[path] = PretokenLengths(path)
    return _LENGTHS[path]


def _valid(raw: bytes) -> bytes:
    return raw.decode("utf-8", "replace").encode()


def pieces(batch: pa.RecordBatch, special: list[bytes]) -> Iterable[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bytes, piece offsets, row of each piece, special strings in each row) of runs of rows.

    Texts without special strings and of a block's length at most are one piece
    each; others are cut at special strings, and where no pre-token goes across.
    """
    for _, part in tk.row_slices(batch, "text"):
        data, offs = tk.buffers(part.column(part.schema.get_field_index("text")))
        raw, n = data.tobytes(), part.num_rows
        try:
            raw.decode()
        except UnicodeDecodeError:
            rows = [_valid(raw[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            raw, offs = b"".join(rows), np.cumsum([0, *map(len, rows)])
        taken = np.zeros(n, np.int64)
        if len(raw) <= tk.BLOCK_BYTES and not any(x in raw for x in special):
            yield part, np.frombuffer(raw, np.uint8), offs, np.arange(n), taken
            continue
        cut, row = [], []
        for r, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
            texts = [raw[a:b]]
            for x in special:
                texts = [y for t in texts for y in t.split(x)]
                taken[r] += raw.count(x, a, b)
            found = [p for t in texts for p in pt.cut_long(t, tk.BLOCK_BYTES)]
            cut += found
            row += [r] * len(found)
        yield part, np.frombuffer(b"".join(cut), np.uint8), np.cumsum([0, *map(len, cut)]), np.array(row, np.int64), taken


def blocks(data: np.ndarray, offs: np.ndarray) -> Iterable[tuple[int, np.ndarray, np.ndarray]]:
    """(first piece, bytes, offsets) of runs of pieces of about a block each."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offs, offs[i] + tk.BLOCK_BYTES, "right")) - 1))
        yield i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def _merged(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lo, hi, n = (np.concatenate([x[k] for x in found]) for k in range(3))
    order = np.lexsort((lo, hi))
    lo, hi, n = lo[order], hi[order], n[order]
    first = np.flatnonzero(np.append(True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))) if len(lo) else np.zeros(0, np.int64)
    return lo[first], hi[first], np.add.reduceat(n, first) if len(first) else n


def _distinct(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys with their counts, by hash; of keys that share a hash one stays, which a table that saves work only can bear."""
    _, first, n = np.unique(pt.key_hash(lo, hi), return_index=True, return_counts=True)
    return lo[first], hi[first], n


def frequent(texts: DataFrame, path: str, most: int = FREQUENT, share: float = SHARE) -> pt.KeyTable:
    """The table of the corpus's frequent pre-tokens of KEY_BYTES bytes at most, from all texts."""

    def run(batches):
        special, found, total = _worker(path).special, [], 0
        for batch in batches:
            for _, data, offs, _, _ in pieces(batch, special):
                for _, block, own in blocks(data, offs):
                    s, e, _, _ = pt.spans(block, own)
                    total += len(s)
                    short = e - s <= pt.KEY_BYTES
                    found.append(_distinct(*pt.keys(block, s[short], e[short])))
                    if sum(len(x[0]) for x in found) > 2 * COUNTED:
                        found = [_merged(found)]
                        if len(found[0][0]) > COUNTED:
                            keep = np.argsort(-found[0][2], kind="stable")[: COUNTED // 2]
                            found = [tuple(x[keep] for x in found[0])]
        if found:
            lo, hi, n = _merged(found)
            keep = n >= max(2.0, share * total)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep].astype(np.int64)) for x in (lo, hi, n)], names=["lo", "hi", "n"])

    named = texts.mapInArrow(run, "lo long, hi long, n long").groupBy("lo", "hi").agg(F.sum("n").alias("n"))
    top = named.orderBy(F.desc("n"), "lo", "hi").limit(most).select("lo", "hi").toPandas()
    lo, hi = (top[c].to_numpy(np.int64).astype(np.uint64) for c in ("lo", "hi"))
    own = PretokenLengths(path)
    return pt.KeyTable(lo, hi, own([pt.spelled(a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]))


def count_tokens(data: np.ndarray, offs: np.ndarray, table: pt.KeyTable, lengths: PretokenLengths) -> np.ndarray:
    """Tokens of each piece."""
    out = np.zeros(len(offs) - 1, np.int64)
    for i, block, own in blocks(data, offs):
        s, e, row, unsure = pt.spans(block, own)
        size = np.full(len(s), -1, np.int64)
        short = np.flatnonzero(e - s <= pt.KEY_BYTES)
        size[short] = table.find(*pt.keys(block, s[short], e[short]))
        miss = np.flatnonzero(size < 0)
        raw = block.tobytes()
        size[miss] = lengths([raw[a:b] for a, b in zip(s[miss].tolist(), e[miss].tolist(), strict=True)])
        got = np.bincount(row, size, len(own) - 1).astype(np.int64)
        if len(unsure):
            got[unsure] = lengths.whole([raw[own[r] : own[r + 1]] for r in unsure.tolist()])
        out[i : i + len(got)] = got
    return out


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, table: pt.KeyTable | None = None) -> DataFrame:
    """One row per row of ``docs``: (id_col, n_bytes, n_tokens, over_limit) as the tokenizer at ``path`` counts.

    Null and empty texts have no bytes and no tokens. Special strings inside a
    text are one token each, as the library takes them. Rows that repeat or have
    null ids are counted like any other; other columns are not read. A text of
    any length is counted in pieces that meet between pre-tokens; a single
    pre-token is encoded whole. Bytes that aren't valid UTF-8 are read as U+FFFD.
    ``table``: frequent pre-tokens, if they are known already.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(table or frequent(rows.select("text"), path))

    def run(batches):
        lengths = _worker(path)
        for batch in batches:
            for part, data, offs, row, taken in pieces(batch, lengths.special):
                n = part.num_rows
                tokens = taken + np.bincount(row, count_tokens(data, offs, sent.value, lengths), n).astype(np.int64)
                _, own = tk.buffers(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(own)), pa.array(tokens), pa.array(tokens > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
