"""Spelling variants of a corpus's words: which words are one edit apart, and the most frequent form each leads to.

A word has a bit for each letter that it holds an odd number of times. One edit
flips two bits at most, so of three bands of bits one is equal in both words.
Words meet in a join on equal bands, together with two more things an edit
leaves: the longer word's length, and the half of the word on the far side of
the edit, which keeps groups small when most words share their letters' parity.
What meets is verified; a pair counts where it meets first, so pairs are never
made distinct by a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedon.llm import textkit as tk
from pedon.llm.graph import durable

RUN = re.compile("[A-Za-zÀ-ÿ]+")
MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
#: One in so many (document, word) loses a letter.
DROPPED = 97
BANDS = 3
#: Distinct words that a task counts before it gives them out.
COUNTED = 200_000
#: Characters looked at together.
PIECE = 1 << 20
_SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


def _pieces(text: str):
    """A text in pieces of about PIECE characters that no run goes across."""
    at = 0
    while len(text) - at > PIECE:
        stop = at + PIECE
        if found := RUN.match(text, stop):
            stop = found.end()
        yield text[at:stop]
        at = stop
    yield text[at:]


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropped: int = DROPPED, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): runs of Latin letters of whole texts in small letters, with the letters that ``dropped`` takes away, of ``min_length`` letters and ``min_count`` occurrences or more."""

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for _, part in tk.row_slices(batch, "text"):
                data, offs = tk.buffers(part.column(1))
                raw, at = data.tobytes(), offs.tolist()
                for key, p, q in zip(part.column(0).to_pylist(), at[:-1], at[1:], strict=True):
                    seed = zlib.crc32(f"{'' if key is None else key}:".encode())
                    for piece in _pieces(raw[p:q].decode("utf-8", "replace").translate(_SMALL)):
                        for w, n in Counter(RUN.findall(piece)).items():
                            h = zlib.crc32(w.encode(), seed)
                            if h % dropped == 0:
                                w = w[: h % len(w)] + w[h % len(w) + 1 :]
                            if len(w) >= min_length:
                                counts[w] += n
                        if len(counts) > COUNTED:
                            yield batch_of(counts)
                            counts = Counter()
        yield batch_of(counts)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _bands() -> list[Column]:
    """Each band of the bits of letters held an odd number of times: neighbouring letters go to different bands."""
    bit = "ascii(c) - CASE WHEN ascii(c) < 192 THEN 97 ELSE 166 END"  # a to z are 0 to 25, U+00C0 to U+00FF 26 to 89
    return [F.expr(f"aggregate(filter(split(word, ''), c -> c <> ''), 0L, (m, c) -> m ^ CASE WHEN ({bit}) % {BANDS} = {b} THEN shiftleft(1L, ({bit}) div {BANDS}) ELSE 0L END)") for b in range(BANDS)]


def near_pairs(found: DataFrame) -> DataFrame:
    """(word, n, other, other_n): every ordered pair of different words of ``found`` (word, n) that are one inserted, deleted or replaced letter apart, once."""
    masked = found.select("word", "n", F.char_length("word").alias("size"), *(m.alias(f"m{b}") for b, m in enumerate(_bands())))
    # most: the longer word's length; the words of a pair agree in the first half of it, or in what the longer has behind that
    placed = masked.withColumn("most", F.explode(F.array("size", F.col("size") + 1)))
    placed = placed.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", F.explode(F.array(*map(F.lit, range(BANDS)))))
    kept, mask = F.expr("CASE side WHEN 0 THEN left(word, most div 2) ELSE right(word, most - most div 2) END"), F.expr("CASE band " + " ".join(f"WHEN {b} THEN m{b}" for b in range(BANDS)) + " END")
    keyed = placed.withColumn("key", F.xxhash64("most", "side", kept, "band", mask))
    a = keyed.where("size = most").alias("a")
    b = keyed.drop("most", "side", "band").alias("b")
    flips = [f"bit_count(a.m{i} ^ b.m{i})" for i in range(BANDS)]
    first_band = "CASE " + " ".join(f"WHEN a.m{i} = b.m{i} THEN {i}" for i in range(BANDS)) + " END"
    same_head, same_tail = "left(a.word, a.most div 2) = left(b.word, a.most div 2)", "right(a.word, a.most - a.most div 2) = right(b.word, a.most - a.most div 2)"
    met = " AND ".join(
        [
            "a.key = b.key",
            "(b.size = a.size - 1 OR b.size = a.size AND a.word < b.word)",  # words of equal length stand twice
            f"{' + '.join(flips)} <= 2",
            f"a.band = {first_band}",  # a pair counts in the first band that is equal, by its head if it can
            f"CASE a.side WHEN 0 THEN {same_head} ELSE {same_tail} AND NOT {same_head} END",
            "levenshtein(a.word, b.word, 1) = 1",
        ]
    )
    pairs = a.join(b, F.expr(met)).select(F.struct("a.word", "a.n").alias("x"), F.struct("b.word", "b.n").alias("y"))
    both = pairs.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("p"))
    return both.select("p.x.word", "p.x.n", F.col("p.y.word").alias("other"), F.col("p.y.n").alias("other_n"))


def forms(found: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n) of each word of ``found`` (word, n)."""
    best = near_pairs(found).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    joined = found.join(best, "word", "left")
    strong = -F.col("best.less") >= ratio * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n"))


def roots(known: DataFrame) -> DataFrame:
    """``known`` with the last word of each word's chain of forms, which end, as each form is more frequent. A round doubles the steps taken."""
    steps = durable(known.where(F.col("form").isNotNull()).select("word", F.col("form").alias("to")))
    moved = True
    while moved:
        beyond = steps.select(F.col("word").alias("to"), F.col("to").alias("beyond"))
        on = durable(steps.join(beyond, "to", "left").select("word", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")))
        moved, steps = not on.where("moved").isEmpty(), on.select("word", "to")
    return known.join(steps.withColumnRenamed("to", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropped: int = DROPPED, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: float = RATIO) -> DataFrame:
    """One row per word: (word, form, root, n, n_near, form_n).

    ``form`` is the word's most frequent neighbour at one edit (ties: the first
    in code-point order) if it is ``ratio`` times as frequent at least; else it
    and ``form_n`` are null. ``root`` is where forms lead. Null texts hold no
    words, a null id counts as the empty text before the colon, rows that repeat
    count again, and other columns are not read. Long texts are read in pieces.
    """
    found = durable(words(docs, id_col, text_col, dropped, min_length, min_count))
    return roots(durable(forms(found, ratio))).select("word", "form", "root", "n", "n_near", "form_n")
