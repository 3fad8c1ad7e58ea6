"""Language identification by bit-sliced Bloom filters of n-grams.

Every language has a Bloom filter of its frequent n-grams. The filters share
their hash functions and are stored sliced: slot i holds one bit per language,
so the conjunction of an n-gram's slots is the mask of all languages that
contain it. A text's n-grams are counted per language by those bits, the counts
are corrected for the filters' false positives, and the largest decides.

An n-gram is three symbols in a row; a symbol is an ASCII letter (case folded),
a byte beyond ASCII, or a gap (any run-in of other bytes counts byte by byte as
the same symbol).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedon.llm import textkit as tk
from pedon.llm.folds import fold
from pedon.llm.graph import durable

#: Least share of a language's n-grams that puts one into its filter (so a filter has 1 / SUPPORT at most); slots for each n-gram of the fullest filter; hash functions.
SUPPORT, SLOTS_EACH, HASHES = 5e-4, 8, 3
#: Languages in one word of a slot; more take more words.
WORD = 64
UNDETERMINED = "und"
#: Bytes of text whose n-grams are handled at once.
CUT = 1 << 18

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[0x61:0x7B] = np.arange(1, 27)
_SYMBOL[0x41:0x5B] = np.arange(1, 27)
_SYMBOL[0x80:] = np.arange(27, 27 + 128)
_N = 27 + 128
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, row) of each row's n-grams with two symbols that aren't gaps at least."""
    z = np.zeros(0, np.int64)
    if len(data) < 3:
        return z, z
    s = _SYMBOL[data]
    code = (s[:-2] * _N + s[1:-1]) * _N + s[2:]
    ok = (s[:-2] > 0).astype(np.int8) + (s[1:-1] > 0) + (s[2:] > 0) >= 2
    cuts = offs[(offs > 0) & (offs < len(data))]
    ok[np.minimum(cuts - 1, len(ok) - 1)] = False
    ok[np.maximum(cuts - 2, 0)] = False
    # a cut near the end leaves no n-gram behind it
    at = np.flatnonzero(ok)
    row = np.searchsorted(offs, at, "right") - 1
    whole = at + 3 <= offs[row + 1]
    return code[at[whole]], row[whole]


def _slots(code: np.ndarray, n: int) -> list[np.ndarray]:
    """The slots of each n-gram, one for each hash function; n, a power of two up to 2^20, is the number of slots."""
    h = tk.mix(code.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    bits = np.uint64(n - 1)
    return [((h >> np.uint64(20 * j)) & bits).astype(np.int64) for j in range(HASHES)]


@dataclass
class Filters:
    languages: list[str]  # sorted
    slots: np.ndarray  # (words, slots): masks of 64 languages each
    false_rate: np.ndarray  # by language
    fallback: str  # the commonest language

    def counts(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corrected counts (row, language), and n-grams of each row."""
        n = len(offs) - 1
        total, out = np.zeros(n, np.int64), np.zeros((n, len(self.languages)))
        for d, o, rows in tk.cut(data, offs, CUT, 2):
            code, piece = grams(d, o)
            if not len(code):
                continue
            bounds = tk.rows_of(piece, len(rows))
            each = np.diff(bounds)
            np.add.at(total, rows, each)
            full = np.flatnonzero(each)
            a, *rest = _slots(code, self.slots.shape[1])
            for w, masks in enumerate(self.slots):
                mask = masks[a]
                for b in rest:
                    mask &= masks[b]
                for i in range(w * WORD, min((w + 1) * WORD, len(self.languages))):
                    hit = (mask >> np.uint64(i % WORD)) & np.uint64(1)
                    np.add.at(out[:, i], rows[full], np.add.reduceat(hit.astype(np.int64), bounds[full]))
        rate = np.minimum(self.false_rate, 0.999)
        return np.maximum(out - rate * total[:, None], 0) / (1 - rate), total


def build(top: dict[str, np.ndarray], fallback: str) -> Filters:
    """Filters of the n-gram codes of each language."""
    languages = sorted(top)
    most = max((len(x) for x in top.values()), default=0)
    slots = np.zeros((max(1, -(-len(languages) // WORD)), 1 << min(20, max(10, int(SLOTS_EACH * most - 1).bit_length() if most else 0))), np.uint64)
    for i, lang in enumerate(languages):
        for s in _slots(top[lang], slots.shape[1]):
            slots[i // WORD, s] |= np.uint64(1 << i % WORD)
    fill = np.array([((slots[i // WORD] >> np.uint64(i % WORD)) & np.uint64(1)).mean() for i in range(len(languages))])
    return Filters(languages, slots, fill**HASHES, fallback)


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", support: float = SUPPORT) -> Filters:
    """Count every n-gram of every row that has a language, and keep those that make up ``support`` of their language's.

    Null texts count as empty. A language without n-grams is learned too, but
    nothing is found in its filter.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & (F.col(lang_col) != UNDETERMINED)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    size = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()

    def count(batches):
        held: dict[str, np.ndarray] = {}

        def flush(lang: str):
            n = held.pop(lang)
            at = np.flatnonzero(n)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "code", "n"])

        for batch in batches:
            for _, part in tk.row_slices(batch, "text"):
                names = part.column(0).to_pylist()
                for data, offs, rows_ in tk.cut(*tk.buffers(part.column(1)), CUT, 2):
                    code, row = grams(data, offs)
                    own = [names[r] for r in rows_]
                    for lang in sorted(set(own)):
                        if lang not in held and len(held) == 8:  # 15 MB each
                            yield flush(next(iter(held)))
                        n = held.setdefault(lang, np.zeros(_N**3, np.int32))
                        mine, c = np.unique(code[np.array([x == lang for x in own])[row]], return_counts=True)
                        n[mine] += c.astype(np.int32)
        for lang in list(held):
            yield flush(lang)

    counted = rows.mapInArrow(count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    counted = durable(counted)
    total = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    got = counted.join(F.broadcast(total), "lang").where(F.col("n") >= F.lit(support) * F.col("total")).select("lang", "code").toPandas()
    common = min(size, key=lambda r: (-r["n"], r["lang"]))["lang"] if size else UNDETERMINED
    return build({r["lang"]: got.loc[got["lang"] == r["lang"], "code"].to_numpy(np.int64) for r in size}, common)


def predict(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) of each row, over its whole text.

    score is the winner's share of all languages' corrected counts. Null text
    and text without a letter give 'und' at 0; text of letters that no filter
    knows gives the commonest learned language at 0. Ties go to the language
    that sorts first.
    """
    held = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        f = held.value
        names = np.array(f.languages or [UNDETERMINED], object)
        for batch in batches:
            for _, part in tk.row_slices(batch, "text", 1 << 18):
                data, offs = tk.buffers(part.column(1))
                n = part.num_rows
                c, _ = f.counts(data, offs)
                if not f.languages:
                    c = np.zeros((n, 1))
                best, total = c.argmax(axis=1), c.sum(axis=1)
                lang, score = names[best], np.where(total > 0, c.max(axis=1) / np.maximum(total, 1e-9), 0.0)
                lang[total == 0] = f.fallback
                seen = np.concatenate([[0], np.cumsum(_LETTER[data])])
                for i in np.flatnonzero(seen[offs[1:]] == seen[offs[:-1]]):
                    if not any(map(str.isalpha, data[offs[i] : offs[i + 1]].tobytes().decode())):
                        lang[i], score[i] = UNDETERMINED, 0.0
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: (id_col, held_out, lang_pred, score).

    Languages are learned from the rows with a language whose id isn't held out
    (CRC-32 modulo 4 is 2). Repeated rows get equal results; null ids are dealt
    with like others.
    """
    out = fold(F.col(id_col), 4) == 2
    filters = learn(docs.where(~out), lang_col, text_col)
    return predict(docs, filters, id_col, text_col).select(id_col, out.alias("held_out"), "lang_pred", "score")
