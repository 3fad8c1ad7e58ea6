"""Packing of tokenised documents into training sequences, best fit decreasing.

A document is tokenised, ended by one id and cut into full windows and a
remainder. Pieces are dealt evenly over groups of bounded size, and each group
is packed by itself: longest piece first, each into the open sequence that it
fills most, found in a segment tree over remaining capacities.
"""

from __future__ import annotations

import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedon.llm import textkit as tk
from pedon.llm.graph import durable

SIZE = 2048
END_ID = 1
#: Pieces in a group, about.
GROUP_PIECES = 16_384
#: Distinct chunks that a worker remembers the ids of, twice.
CACHE = 500_000
#: Bytes of text tokenised at once.
SLICE = 8 << 20
#: Signs after a run of letters that the tokenizer cuts from it.
TAIL = b".,;:!?"


def _letters_only(word: bytes) -> bool:
    """Whether the tokenizer's normal form of a word (composed, then in small letters) is letters and nothing else, marks included."""
    if word.isascii():
        return word.isalpha()
    return unicodedata.normalize("NFC", word.decode()).lower().isalpha()


class ChunkTokenizer:
    """Ids of texts by a tokenizer whose pieces never span white space, with a bounded memory of chunks between white space.

    ASCII capitals are folded first, as the tokenizer's normaliser folds them;
    not in a text with '<|' (special tokens are found before folding) or with
    combining marks (they may compose with a small letter only).
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        self.encode = own.encode_batch_fast
        #: ids that end a run of letters, as the tokenizer cuts them.
        self.ends = np.array([(own.id_to_token(i) or "").endswith("</w>") for i in range(own.get_vocab_size())])
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text as little-endian unsigned 32-bit numbers."""
        rows = [(t if b"<|" in t or b"\xcc" in t or b"\xcd" in t else t.lower()).split() for t in texts]
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        need = set().union(*rows).difference(self.young)
        fresh = []
        for c in need:
            if (v := self.old.get(c)) is None:
                fresh.append(c)
            else:
                self.young[c] = v
        ids = self.young
        worded = [(c, w) for c in fresh if _letters_only(w := c.rstrip(TAIL))]
        self._letters([w for w in {w for _, w in worded} if w not in ids])
        self._one_by_one([t for t in {c[len(w) :] for c, w in worded} if t and t not in ids])
        ids.update((c, ids[w] + ids[c[len(w) :]]) for c, w in worded if len(c) > len(w))
        self._one_by_one([c for c in fresh if c not in ids])
        return [b"".join(map(ids.__getitem__, row)) for row in rows]

    def _one_by_one(self, chunks: list[bytes]) -> None:
        for i in range(0, len(chunks), 4096):
            part = chunks[i : i + 4096]
            got = self.encode([c.decode() for c in part], add_special_tokens=False)
            self.young.update((c, np.array(x.ids, "<u4").tobytes()) for c, x in zip(part, got, strict=True))

    def _letters(self, words: list[bytes]) -> None:
        """Words of letters only, many in one text; each has one id that ends it."""
        for i in range(0, len(words), 2048):
            part = words[i : i + 2048]
            got = np.array(self.encode([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends[got]) + 1)).tolist()
            if len(ends) != len(part):
                self._one_by_one(part)
                continue
            raw = got.tobytes()
            self.young.update((w, raw[a:b]) for w, a, b in zip(part, [0, *ends], ends, strict=False))


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, seq[, ids]) of each document's windows of ``size`` ids and its remainder; seq counts evenly within a task."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer not in _TOKENIZERS:
            _TOKENIZERS[tokenizer] = ChunkTokenizer(tokenizer)
        end, seq = np.array([end_id], "<u4").tobytes(), None
        for batch in batches:
            for _, part in tk.row_slices(batch, "text", SLICE):
                data, offs = tk.buffers(part.column(1))
                raw = data.tobytes()
                bounds = offs.tolist()
                got = _TOKENIZERS[tokenizer]([raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
                row, start, length, crc, total, ids = [], [], [], [], [], []
                for r, doc in enumerate(got):
                    doc += end
                    n = len(doc) // 4
                    for s in range(0, n, size):
                        x = doc[4 * s : 4 * (s + size)]
                        row.append(r)
                        start.append(s)
                        length.append(len(x) // 4)
                        crc.append(zlib.crc32(x))
                        total.append(n)
                        if with_ids:
                            ids.append(np.frombuffer(x, "<u4").astype(np.int32))
                if seq is None:
                    seq = crc[0]
                cols = [part.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total, range(seq, seq + len(row))))]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens", "seq"]
                seq += len(row)
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), names=names + ["ids"] * with_ids)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, seq long" + ", ids array<int>" * with_ids)


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; ties go to the piece that comes first and to the sequence that was left last."""
    leaves = 1 << size.bit_length()
    tree = [0] * (2 * leaves)  # open sequences by remaining capacity
    open_at: list[list[int]] = [[] for _ in range(size + 1)]
    seq, off, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0

    def add(cap: int, by: int) -> None:
        i = cap + leaves
        while i:
            tree[i] += by
            i >>= 1

    for p in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[p])
        # smallest capacity of need or more that some sequence has
        i = need + leaves
        while i > 1 and not tree[i]:
            while i & 1:
                i >>= 1
            i += i > 0
        if i > 1:
            while i < leaves:
                i = 2 * i if tree[2 * i] else 2 * i + 1
            cap = i - leaves
            s = open_at[cap].pop()
            add(cap, -1)
        else:
            s, cap, n = n, size, n + 1
        seq[p], off[p] = s, size - cap
        if cap > need:
            open_at[cap - need].append(s)
            add(cap - need, 1)
    return seq, off


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID, group_pieces: int = GROUP_PIECES, with_ids: bool = False) -> DataFrame:
    """One row per piece: (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    A null, empty or white-space text has the end id only. Repeated rows and
    null ids are packed like any other row. A sequence's pieces stand at
    offsets without gaps from 0; what is left up to ``size`` is padding. The
    group is in a sequence_id's upper half, the number within in the lower.
    """
    rows = durable(pieces(docs, tokenizer, id_col, text_col, size, end_id, with_ids))
    groups = max(1, -(-rows.count() // group_pieces))
    kind = rows.schema["id"].dataType.simpleString()

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["seq", "ids_crc32", "start", "length"], kind="stable").reset_index(drop=True)
        seq, off = best_fit_decreasing(part["length"].to_numpy(), size)
        part["sequence_id"], part["offset"] = (int(key[0]) << 32) + seq, off
        return part.drop(columns=["seq", "group"])

    out = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    packed = rows.withColumn("group", F.pmod("seq", F.lit(groups))).groupBy("group").applyInPandas(run, out)
    return packed.withColumnRenamed("id", id_col)
