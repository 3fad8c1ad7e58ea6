"""Alignment of two tokenizers' tokens over the same bytes, and which token pairs the corpus links.

Both tokenizers cut the same bytes (a space and the text). Where a token of each
ends, the bytes are cut into groups; every token of one side is linked to every
token of the other within its group. Ends are running sums of token lengths,
common cuts their intersection, group labels a search in the cuts, and links are
expanded by repetition, all by numpy over many stretches of text at once.

Neither tokenizer has a token across the place between something visible and a
space or line end behind it, or between a Latin letter and an ASCII sign, so a text is
the sequence of its stretches between such places, and a worker remembers the
alignment of stretches, bounded.

The documents that hold a pair are counted in tasks first, then in a shuffle by
pair and salt, then by pair. Counts of frequent pairs travel to every task (of
relative frequency FREQUENT or more, so their number is bounded by 1 / FREQUENT);
the other pairs of a document meet their counts in a join.
"""

from __future__ import annotations

import hashlib
import os
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedon.llm import pretokens as pt
from pedon.llm import textkit as tk
from pedon.llm.graph import durable

#: Share of all (document, pair) rows from which a pair's count travels.
FREQUENT = 1e-6
#: Shuffles by pair are spread over so many salts first.
SALTS = 8
#: Stretches that a worker remembers, twice, each of so many characters at most.
CACHE, CACHED_LENGTH = 150_000, 32
#: Links expanded, and pairs counted, at once.
LINKS = 1 << 21
PAIRS = 1 << 21

_WHITE = "".join(map(chr, pt.WHITE))
_INNER = "".join(c for c in _WHITE if c not in " \n")
_SIGN = re.escape("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: From a space or line end (or from a sign behind a letter) to before the next one that follows something visible, or before a sign behind a letter.
_STRETCH = re.compile(f"(?:[ \n][{_WHITE}]*+|[{_SIGN}])(?:[^{_LETTERS}{_WHITE}]++|[{_LETTERS}]++(?![{_SIGN}])|[{_INNER}][{_WHITE}]*+)*+[{_LETTERS}]*+")
#: What no piece may hold for that: something before a space, a line end, or a sign behind a letter.
_ACROSS = re.compile(f"[^▁]▁|\n|[{_LETTERS}][{_SIGN}]")


class Found(NamedTuple):
    """A stretch's alignment; ``pairs`` holds 64-bit (pair, number of links) after one another."""

    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    groups: str
    pairs: bytes


class Rows(NamedTuple):
    """Counts of each row, groups of its stretches, and (row, pair, number of links), distinct and sorted."""

    counts: np.ndarray
    groups: list[str]
    row: np.ndarray
    pair: np.ndarray
    times: np.ndarray


def _a_bytes(own) -> list[bytes]:
    """Bytes of each entry of a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(c): b for c, b in zip([*shown, *range(256, 256 + len(hidden))], [*shown, *hidden], strict=True)}
    entries = [own.id_to_token(i) for i in range(own.get_vocab_size())]
    return [bytes(byte[c] for c in e) if e and all(c in byte for c in e) else (e or "").encode() for e in entries]


def _b_bytes(own) -> list[bytes]:
    pieces = [own.id_to_piece(i) for i in range(own.get_piece_size())]
    return [bytes([int(p[3:-1], 16)]) if own.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


class Aligner:
    """Alignments of stretches by a byte-level BPE (A) and a piece model with byte fallback (B)."""

    def __init__(self, path_a: str, path_b: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.bytes_a, self.bytes_b = _a_bytes(self.a), _b_bytes(self.b)
        self.size_a, self.size_b = (np.array([len(x) for x in own]) for own in (self.bytes_a, self.bytes_b))
        self.wide = len(self.bytes_b)
        self.space = self.b.piece_to_id("▁")
        #: whether no piece goes across a stretch's border
        self.cuts = not any(_ACROSS.search(self.b.id_to_piece(i)) for i in range(self.wide) if not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_byte(i)))
        self.line_end = self.b.encode("\n")
        self.young: dict[str, Found] = {}
        self.old: dict[str, Found] = {}

    def stretches(self, text: str) -> list[str]:
        """``text`` begins with a space."""
        return _STRETCH.findall(text) if self.cuts else [text]

    def look_up(self, wanted: list[str]) -> list[Found]:
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        known, extra, fresh = self.young, {}, []
        for s in wanted:
            if s not in known:
                if (found := self.old.get(s)) is None:
                    fresh.append(s)
                else:
                    known[s] = found
        for i in range(0, len(fresh), 4096):
            part = fresh[i : i + 4096]
            for s, found in zip(part, self.align(part), strict=True):
                (known if len(s) <= CACHED_LENGTH else extra)[s] = found
        return [known[s] if s in known else extra[s] for s in wanted]

    def _encode_b(self, stretches: list[str]) -> list[list[int]]:
        # B adds a space: it stands for the stretch's own, or goes again with a line end before what begins without one
        got = self.b.encode([s[1:] if s[0] == " " else s if s[0] == "\n" else "\n" + s for s in stretches], num_threads=1)
        skip = {" ": 0, "\n": 1}
        return [[self.space] if s == " " else ids[skip.get(s[0], len(self.line_end)) :] for s, ids in zip(stretches, got, strict=True)]

    def align(self, stretches: list[str]) -> list[Found | None]:
        """The alignment of each stretch; None where a side's bytes aren't the stretch's."""
        ids_a = [x.ids for x in self.a.encode_batch_fast(stretches, add_special_tokens=False)]
        ids_b = self._encode_b(stretches)
        raw = [s.encode() for s in stretches]
        same = lambda ids, own: [b"".join([own[i] for i in x]) == r for x, r in zip(ids, raw, strict=True)]
        good = [k for k, (x, y) in enumerate(zip(same(ids_a, self.bytes_a), same(ids_b, self.bytes_b), strict=True)) if x and y]
        out: list[Found | None] = [None] * len(stretches)
        if not good:
            return out
        a, b = (np.array([i for k in good for i in ids[k]], np.int64) for ids in (ids_a, ids_b))
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        n_a, n_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
        # a stretch ends with a common cut
        last = np.searchsorted(common, np.cumsum([len(raw[k]) for k in good]))
        first = np.append(0, last[:-1] + 1)
        links = np.append(0, np.cumsum(n_a * n_b))
        pairs = self._pairs(a, b, group_a, n_b, stop_b - n_b, np.repeat(np.arange(len(good)), last - first + 1))
        text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        lo_a, hi_a, lo_b, hi_b = (x.tolist() for x in (stop_a - n_a, stop_a, stop_b - n_b, stop_b))
        shown = [f"{','.join(text_a[p:q])}|{','.join(text_b[r:s])}" for p, q, r, s in zip(lo_a, hi_a, lo_b, hi_b, strict=True)]
        ends = last + 1
        for k, i, j, n, own in zip(good, first.tolist(), ends.tolist(), (links[ends] - links[first]).tolist(), pairs, strict=True):
            out[k] = Found(len(ids_a[k]), len(ids_b[k]), j - i, n, ";".join(shown[i:j]), own)
        return out

    def _pairs(self, a: np.ndarray, b: np.ndarray, group: np.ndarray, n_b: np.ndarray, first_b: np.ndarray, stretch: np.ndarray) -> list[bytes]:
        """The distinct pairs of each stretch with their numbers of links."""
        per = n_b[group]
        total = np.cumsum(per)
        found, i = [], 0
        while i < len(a):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + LINKS, "right")))
            n = per[i:j]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            g = np.repeat(group[i:j], n)
            pair = np.repeat(a[i:j], n) * self.wide + b[first_b[g] + nth]
            found.append(summed(stretch[g], pair, np.ones(len(pair), np.int64)))
            i = j
        owner, pair, times = found[0] if len(found) == 1 else summed(*(np.concatenate([x[k] for x in found]) for k in range(3)))
        raw = np.stack([pair, times], 1).tobytes()
        at = (16 * np.searchsorted(owner, np.arange(stretch[-1] + 2))).tolist()
        return [raw[p:q] for p, q in zip(at[:-1], at[1:], strict=True)]

    def rows(self, texts: list[str]) -> tuple[Rows, np.ndarray]:
        """Alignments of texts that begin with a space, and which of them have both sides' bytes; empty ones have no tokens."""
        cut = [self.stretches(text) if text else [] for text in texts]
        row = list(map(len, cut))
        each_one = [s for own in cut for s in own]
        code = {s: i for i, s in enumerate(dict.fromkeys(each_one))}
        found = self.look_up(list(code))
        codes = list(map(code.__getitem__, each_one))
        flat = np.array(codes, np.int64)
        owner = np.repeat(np.arange(len(texts)), row)
        bad = np.array([f is None for f in found], bool)
        good = np.ones(len(texts), bool)
        good[owner[bad[flat]]] = False
        keep = good[owner]
        flat, owner = flat[keep], owner[keep]
        each = np.array([f[:4] if f else (0, 0, 0, 0) for f in found], np.int64).reshape(-1, 4)
        counts = np.stack([np.bincount(owner, each[flat, k], len(texts)) for k in range(4)], 1).astype(np.int64)
        shown = [f.groups if f else "" for f in found]
        named, ends = list(map(shown.__getitem__, codes)), np.cumsum(row).tolist()
        groups = [";".join(named[q - n : q]) if ok else "" for n, q, ok in zip(row, ends, good.tolist(), strict=True)]
        owner, flat, times = summed(owner, flat, np.ones(len(flat), np.int64))
        raw = np.frombuffer(b"".join([f.pairs if f else b"" for f in found]), np.int64).reshape(-1, 2)
        size = np.array([len(f.pairs) // 16 if f else 0 for f in found], np.int64)
        begin, n = (np.cumsum(size) - size)[flat], size[flat]
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return Rows(counts, groups, *summed(np.repeat(owner, n), raw[at, 0], raw[at, 1] * np.repeat(times, n))), good


def summed(row: np.ndarray, key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, key), sorted, with the sum of ``n``; rows below 2^24, keys below 2^40."""
    both = row.astype(np.uint64) << np.uint64(40) | key.astype(np.uint64)
    order = np.argsort(both, kind="stable")
    both, n = both[order], n[order]
    first = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
    both, n = both[first], np.add.reduceat(n, first) if len(first) else n
    return (both >> np.uint64(40)).astype(np.int64), (both & np.uint64((1 << 40) - 1)).astype(np.int64), n


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _worker(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _packed(pair: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted pairs and their numbers of links, as bytes: how many, the bytes of a number, and the numbers, compressed."""
    if not len(pair):
        return b""
    raw = np.stack([np.diff(pair, prepend=0), times])
    width = 8 if raw.max() >> 32 else 4
    return len(pair).to_bytes(7, "little") + bytes([width]) + pa.compress(raw.astype(f"<u{width}").tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not raw:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n, width = int.from_bytes(raw[:7], "little"), raw[7]
    own = np.frombuffer(pa.decompress(raw[8:], 2 * n * width, codec="zstd", asbytes=True), f"<u{width}").astype(np.int64)
    return np.cumsum(own[:n]), own[n:]


def _long(own: Aligner, raw: bytes) -> tuple[np.ndarray, bytes | None, np.ndarray, np.ndarray]:
    """(counts, digest, pairs, numbers of links) of a long text, in pieces that meet between stretches."""
    counts, digest, pairs, times, begun = np.zeros(4, np.int64), hashlib.sha256(), np.zeros(0, np.int64), np.zeros(0, np.int64), False
    for piece in pt.cut_long(raw, tk.BLOCK_BYTES) if own.cuts else [raw]:
        got, good = own.rows([piece.decode("utf-8", "replace")])
        if not good[0]:
            return np.zeros(4, np.int64), None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        digest.update((";" * begun + got.groups[0]).encode())
        begun = True
        counts += got.counts[0]
        _, pairs, times = summed(np.zeros(len(pairs) + len(got.pair), np.int64), np.append(pairs, got.pair), np.append(times, got.times))
    return counts, digest.hexdigest().encode(), pairs, times


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """(row, id, n_a, n_b, n_groups, n_links, groups_sha256, pairs[, groups]) of each row; ``row`` tells rows apart, ``groups`` is what is digested."""

    def run(batches):
        from pyspark import TaskContext

        own, row = _worker(path_a, path_b), TaskContext.get().partitionId() << 33
        for batch in batches:
            for _, part in tk.row_slices(batch, "text", tk.BLOCK_BYTES // 2):
                data, offs = tk.buffers(part.column(1))
                raw, at = data.tobytes(), offs.tolist()
                texts = [b" " + raw[p:q] if q > p else b"" for p, q in zip(at[:-1], at[1:], strict=True)]
                if len(raw) > tk.BLOCK_BYTES:  # one long row
                    counts, digest, pair, times = _long(own, texts[0])
                    counts, digests, blobs = counts[None], [digest.decode() if digest else ""], [_packed(pair, times)]
                    groups = [None]
                else:
                    got, _ = own.rows([t.decode("utf-8", "replace") for t in texts])
                    counts, groups = got.counts, got.groups
                    digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                    ends = tk.rows_of(got.row, len(texts)).tolist()
                    blobs = [_packed(got.pair[p:q], got.times[p:q]) for p, q in zip(ends[:-1], ends[1:], strict=True)]
                n = part.num_rows
                cols = [pa.array(np.arange(row, row + n)), part.column(0), *(pa.array(c) for c in counts.T.copy()), pa.array(digests, pa.string()), pa.array(blobs, pa.binary())]
                row += n
                yield pa.RecordBatch.from_arrays(cols + [pa.array(groups, pa.string())] * with_groups, names=["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"] + ["groups"] * with_groups)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary" + ", groups string" * with_groups)


def pair_counts(found: DataFrame, wide: int) -> DataFrame:
    """(pair, n, best): in how many rows of ``aligned`` each pair is linked, and whether no pair of its A id is in more. A pair is A id x ``wide`` + B id."""

    def run(batches):
        from pyspark import TaskContext

        salt, pair, n, waiting = TaskContext.get().partitionId() % SALTS, np.zeros(0, np.int64), np.zeros(0, np.int64), []
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(pair), pa.array(np.full(len(pair), salt, np.int32)), pa.array(n)], names=["pair", "salt", "n"])
        for batch in batches:
            waiting += [_unpacked(raw)[0] for raw in batch.column(0).to_pylist()]
            if sum(map(len, waiting)) > PAIRS:
                _, pair, n = summed(np.zeros(len(pair) + sum(map(len, waiting)), np.int64), np.concatenate([pair, *waiting]), np.append(n, np.ones(sum(map(len, waiting)), np.int64)))
                waiting = []
                if len(pair) > PAIRS:
                    yield rows()
                    pair, n = pair[:0], n[:0]
        if waiting or len(pair):
            _, pair, n = summed(np.zeros(len(pair) + sum(map(len, waiting)), np.int64), np.concatenate([pair, *waiting]), np.append(n, np.ones(sum(map(len, waiting)), np.int64)))
            yield rows()

    parts = found.select("pairs").mapInArrow(run, "pair long, salt int, n long")
    counts = durable(parts.groupBy("pair", "salt").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("n")))
    a = F.expr(f"pair div {wide}")
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # a row for each entry of the vocabulary at most
    return counts.join(F.broadcast(most), a == most["a"]).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", frequent: float = FREQUENT) -> DataFrame:
    """One row per row of ``docs``: (id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    Null and empty texts, and texts that a tokenizer doesn't give back byte for
    byte, have zeros and an empty digest and count for no pair. Rows that repeat
    or share an id are rows of their own and each counts as a document; other
    columns are not read. Of pairs with equal counts all are best. A long text is
    aligned in pieces that meet between stretches; a stretch is tokenised whole.
    ``frequent`` is the share of all (row, pair) from which a pair's count travels.
    """
    from sentencepiece import SentencePieceProcessor

    found = durable(aligned(docs, path_a, path_b, id_col, text_col))
    counts = durable(pair_counts(found, SentencePieceProcessor(model_file=path_b).get_piece_size()))
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(1, int(np.ceil(frequent * total)))
    head = counts.where(F.col("n") >= least).toPandas().sort_values("pair")
    sent = docs.sparkSession.sparkContext.broadcast((head["pair"].to_numpy(np.int64), head["n"].to_numpy(np.int64), head["best"].to_numpy(bool)))

    def run(batches):
        known, n_docs, best = sent.value
        for batch in batches:
            lists = [_unpacked(raw) for raw in batch.column(batch.schema.get_field_index("pairs")).to_pylist()]
            size = np.array([len(p) for p, _ in lists], np.int64)
            row = np.repeat(np.arange(len(lists)), size)
            pair, times = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in lists)]) for k in range(2))
            at = np.minimum(np.searchsorted(known, pair), max(0, len(known) - 1))
            hit = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            sums = np.zeros((2, len(lists)), np.int64)
            np.add.at(sums[0], row[hit], times[hit] * best[at[hit]])
            np.add.at(sums[1], row[hit], times[hit] * n_docs[at[hit]])
            ids = batch.column(0).to_numpy()
            rest, none = row[~hit], np.full(int((~hit).sum()), None)
            # a row's own columns go with a key of their own, which is no pair
            own = batch.select(["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]).to_struct_array()
            cols = [
                pa.array(np.append(ids, ids[rest])),
                pa.array(np.append(-1 - ids, pair[~hit])),
                pa.array(np.append(np.zeros(len(ids), np.int64), times[~hit])),
                pa.array(np.append(sums[0], np.zeros(len(rest), np.int64))),
                pa.array(np.append(sums[1], np.zeros(len(rest), np.int64))),
                pa.concat_arrays([own, pa.array(none, own.type)]),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "pair", "times", "n_best", "count_sum", "own"])

    kind = found.schema["id"].dataType.simpleString()
    own = f"struct<id: {kind}, n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups_sha256: string>"
    spread = found.mapInArrow(run, f"row long, pair long, times long, n_best long, count_sum long, own {own}")
    rare = counts.where(F.col("n") < least)
    met = spread.join(rare, "pair", "left").groupBy("row").agg(
        F.first("own", ignorenulls=True).alias("own"),
        F.sum(F.col("n_best") + F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("count_sum") + F.coalesce(F.col("times") * F.col("n"), F.lit(0))).alias("count_sum"),
    )
    return met.select(F.col("own.id").alias(id_col), "own.n_a", "own.n_b", "own.n_groups", "own.n_links", "n_best", "count_sum", "own.groups_sha256")
