"""Log-likelihood of whole documents under a gated recurrent language model.

Words and one end per document are tokens. The model is a GRU over the commonest
words: its output is factored into a softmax over classes of words and one over
the words of a class, and one more class stands for all other words, which share
its probability in proportion to their smoothed corpus frequency. It is trained
by truncated back-propagation on the whole text of every training document, in
rounds: each task trains on its rows from the weights of the round before, and
the tasks' weights are averaged by tokens. Training and scoring carry the state
across windows, so a document's score is that of its whole text.

Words whose relative frequency is at least ``HEAD`` number at most 1 / HEAD and
travel to the tasks; the others' counts are joined by word.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedon.llm import textkit as tk
from pedon.llm.folds import fold
from pedon.llm.graph import durable

FOLDS = 10
#: Least relative frequency of the words whose counts are sent to the tasks.
HEAD = 2.5e-7
#: Words of the model, words of a class, size of the state.
VOCABULARY, CLASS, HIDDEN = 3584, 60, 16
#: Rounds that a pass over the training rows is split into; tokens of a round that make one more task, and most tasks of a round.
ROUNDS, TASK_TOKENS, MOST_TASKS = 2, 1_000_000, 256
#: Inputs of fewer training tokens are passed over again, up to MOST_PASSES times.
SMALL, MOST_PASSES = 1_000_000, 8
#: Pieces that the weights are averaged in.
PIECES = 256
#: Steps of a window, rows that are gone through side by side, and what gradients are divided by.
WINDOW, LANES, SCALE = 64, 256, 16
#: Hash that stands for the end of a document.
END = 0x5F0E0D0C0B0A0908
#: Bytes of text in which rows are dealt to lanes.
SLICE = 16 << 20


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the words of each row, each row closed by END."""
    data = tk.FOLD[data]
    s, e, row = tk.words(data, offs, tk.NOT_SPACE)
    n = len(offs) - 1
    ends = tk.rows_of(row, n)[1:] + np.arange(n)
    h = np.empty(len(s) + n, np.uint64)
    at = np.ones(len(h), bool)
    at[ends] = False
    h[at], h[ends] = tk.span_hashes(data, s, e), np.uint64(END)
    return h, np.repeat(np.arange(n), np.diff(np.concatenate([[-1], ends])))


def _window(where: np.ndarray, word: np.ndarray, begins: np.ndarray, last: np.ndarray):
    """(words, words before, whether there is one, whether a row begins) of a window's positions; last: the words before its first step. END is word 0."""
    seen = where >= 0
    at = np.maximum(where, 0)
    w, new = np.where(seen, word[at], 0), begins[at] & seen
    prev = np.concatenate([last[None, : where.shape[1]], w[:-1]])
    prev[new] = 0
    return w, prev, seen, new


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _exp(a: np.ndarray) -> np.ndarray:
    """Turns a into exp(a - m) in place, m being the largest of all or 0, and gives each row's sum."""
    a -= a.max(initial=0)
    np.maximum(a, -80, out=a)  # no row's sum is 0
    np.exp(a, out=a)
    return a @ np.ones(a.shape[1], a.dtype)


def windows(size: np.ndarray, bounds: np.ndarray, lanes: int, steps: int):
    """Number of lanes used, and an iterator of each window's (steps, live lanes) positions of words, -1 behind a lane's end.

    Rows are dealt to lanes, longest first, and lie there one after another.
    Lanes are in falling order of length, so that the live ones come first.
    """
    lanes = min(lanes, len(size))
    load, lane = np.zeros(lanes, np.int64), [[] for _ in range(lanes)]
    heap = [(0, i) for i in range(lanes)]
    for r in np.argsort(-size, kind="stable").tolist():
        got, i = heapq.heappop(heap)
        lane[i].append(r)
        heapq.heappush(heap, (got + int(size[r]), i))
        load[i] += size[r]
    order = np.argsort(-load, kind="stable")
    load = load[order]
    at = [np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in lane[i]] or [np.zeros(0, np.int64)]) for i in order]

    def run():
        length = int(load[0]) if lanes else 0
        for t0 in range(0, length, steps):
            live = int(np.searchsorted(-load, -t0, "left"))
            where = np.full((min(steps, length - t0), live), -1)
            for i in range(live):
                part = at[i][t0 : t0 + steps]
                where[: len(part), i] = part
            yield where

    return lanes, run()


@dataclass
class Gru:
    """Class of word i is i // CLASS; the word after the last stands for all others and is a class alone."""

    n: int  # words
    x: np.ndarray  # (n + 1, 3 H) what a word adds to the gates
    u: np.ndarray  # (H, 3 H)
    c: np.ndarray  # (H, classes + 1)
    cb: np.ndarray
    w: np.ndarray  # (classes, H, CLASS)
    wb: np.ndarray  # (classes, CLASS); -inf where a class has no word
    state: dict = field(default_factory=dict, repr=False)

    @classmethod
    def fresh(cls, counts: np.ndarray, others: float, seed: int = 11) -> Gru:
        """Before training its output is that of the counts, whatever the state."""
        rng = np.random.default_rng(seed)
        n, k = len(counts), max(1, -(-len(counts) // CLASS))
        padded = np.zeros(k * CLASS)
        padded[:n] = counts
        by = padded.reshape(k, CLASS)
        with np.errstate(divide="ignore"):
            wb = np.log(by)
            cb = np.log(np.append(by.sum(axis=1), max(others, 0.5)))
        wb[np.isinf(wb)] = -60
        cb[np.isinf(cb)] = -60
        f = lambda *s, scale=0.1: rng.normal(0, scale, s).astype(np.float32)
        return cls(n, f(n + 1, 3 * HIDDEN), f(HIDDEN, 3 * HIDDEN, scale=0.15), f(HIDDEN, k + 1, scale=0.02), (cb - cb.max()).astype(np.float32), f(k, HIDDEN, CLASS, scale=0.02), (wb - wb.max(axis=1, keepdims=True)).astype(np.float32))

    def step(self, word: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The state after one more word of each lane."""
        return self.steps(word[None], np.zeros((1, len(word)), bool), h)[0][0]

    def steps(self, prev: np.ndarray, new: np.ndarray, h: np.ndarray):
        """(states, their inputs, gates, candidates, u's part of the candidates) of (steps, lanes) words; h is the state before, which is zero where new."""
        t, n = prev.shape
        x = self.x[prev]
        hs, before, zr, m, un = (np.empty((t, n, k * HIDDEN), np.float32) for k in (1, 1, 2, 1, 1))
        fresh = new.any(axis=1)
        u_zr, u_m = np.ascontiguousarray(self.u[:, : 2 * HIDDEN]), np.ascontiguousarray(self.u[:, 2 * HIDDEN :])
        for i in range(t):
            own = before[i]
            own[:] = h
            if fresh[i]:
                own[new[i]] = 0
            gate, cand, part = zr[i], m[i], un[i]
            np.matmul(own, u_zr, out=gate)
            gate += x[i, :, : 2 * HIDDEN]
            _sigmoid(gate)
            np.matmul(own, u_m, out=part)
            np.multiply(gate[:, HIDDEN:], part, out=cand)
            cand += x[i, :, 2 * HIDDEN :]
            np.tanh(cand, out=cand)
            h = hs[i]
            np.subtract(own, cand, out=h)
            h *= gate[:, :HIDDEN]
            h += cand
        return hs, before, zr, m, un

    def log_probs(self, h: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Natural logarithm of each word's probability after state h."""
        k = np.where(word < self.n, word // CLASS, self.w.shape[0])
        a = h @ self.c
        a += self.cb
        own = a[np.arange(len(k)), k] - a.max(initial=0)
        out = own.astype(np.float64) - np.log(_exp(a))
        order = np.argsort(k.astype(np.int16), kind="stable")
        edge = np.searchsorted(k[order], np.arange(self.w.shape[0] + 1))
        h, word = h[order], word[order] % CLASS
        for j in np.flatnonzero(np.diff(edge)):
            at = slice(edge[j], edge[j + 1])
            b = h[at] @ self.w[j]
            b += self.wb[j]
            own = b[np.arange(len(b)), word[at]] - b.max(initial=0)
            out[order[at]] += own - np.log(_exp(b))
        return out

    def score(self, word: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Sum of log_probs over each row of words, bounds being the rows' offsets.

        The state is zero where a row begins and is carried from window to
        window elsewhere.
        """
        size = np.diff(bounds)
        total = np.zeros(len(size))
        begins = np.zeros(len(word), bool)
        begins[bounds[:-1][size > 0]] = True
        row = np.repeat(np.arange(len(size)), size)
        lanes, parts = windows(size, bounds, LANES, WINDOW)
        h, last = np.zeros((lanes, HIDDEN), np.float32), np.zeros(lanes, np.int64)
        for where in parts:
            w, prev, seen, new = _window(where, word, begins, last)
            hs = self.steps(prev, new, h[: where.shape[1]])[0]
            h, last = hs[-1], w[-1]
            np.add.at(total, row[where[seen]], self.log_probs(hs[seen], w[seen]))
        return total

    def fit(self, word: np.ndarray, bounds: np.ndarray, sq: dict[str, np.ndarray], rate: float = 0.2) -> None:
        """One pass of truncated back-propagation over whole rows of words, bounds being the rows' offsets.

        The state is carried as in score; sq holds the sums of squared gradients and is updated.
        """
        size = np.diff(bounds)
        begins = np.zeros(len(word), bool)
        begins[bounds[:-1][size > 0]] = True
        scale = np.float32(1 / SCALE)

        def update(k: str, grad: np.ndarray, at=slice(None)) -> None:
            np.maximum(grad, -1, out=grad)
            np.minimum(grad, 1, out=grad)
            total = sq[k][at] + grad * grad
            sq[k][at] = total
            grad *= np.float32(rate)
            grad /= np.sqrt(total, out=total)
            getattr(self, k)[at] -= grad

        lanes, parts = windows(size, bounds, LANES, WINDOW)
        h, last = np.zeros((lanes, HIDDEN), np.float32), np.zeros(lanes, np.int64)
        for where in parts:
            w, prev, seen, new = _window(where, word, begins, last)
            states, before, zr, m, un = self.steps(prev, new, h[: where.shape[1]])
            h, last = states[-1], w[-1]
            hs, word_ = states[seen], w[seen]
            k = np.where(word_ < self.n, word_ // CLASS, self.w.shape[0])
            p = hs @ self.c
            p += self.cb
            p *= (scale / _exp(p))[:, None]
            p[np.arange(len(k)), k] -= scale
            dh = p @ self.c.T
            gc, gcb = hs.T @ p, p.sum(axis=0)
            order = np.argsort(k.astype(np.int16), kind="stable")
            edge = np.searchsorted(k[order], np.arange(self.w.shape[0] + 1))
            own_h, own_w, own_d = hs[order], word_[order] % CLASS, dh[order]
            for j in np.flatnonzero(np.diff(edge)):
                at = slice(edge[j], edge[j + 1])
                own = own_h[at]
                q = own @ self.w[j]
                q += self.wb[j]
                q *= (scale / _exp(q))[:, None]
                q[np.arange(len(q)), own_w[at]] -= scale
                own_d[at] += q @ self.w[j].T
                update("w", own.T @ q, j)
                update("wb", q.sum(axis=0), j)
            dh[order] = own_d
            update("c", gc)
            update("cb", gcb)
            full = np.zeros(states.shape, np.float32)
            full[seen] = dh
            # what the gradient of the state is multiplied by, but for the recurrence
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            to_m = (1 - z) * (1 - m * m)
            to_z = (before - m) * z * (1 - z)
            to_r = to_m * un * r * (1 - r)
            to_un = to_m * r
            stay = z * ~new[:, :, None]
            dg = np.empty((*prev.shape, 3 * HIDDEN), np.float32)
            carry, u_t = np.zeros_like(h), np.ascontiguousarray(self.u.T)
            for t in range(len(prev) - 1, -1, -1):
                d = full[t]
                d += carry
                own = dg[t]
                np.multiply(d, to_z[t], out=own[:, :HIDDEN])
                np.multiply(d, to_r[t], out=own[:, HIDDEN : 2 * HIDDEN])
                np.multiply(d, to_un[t], out=own[:, 2 * HIDDEN :])
                np.matmul(own, u_t, out=carry)
                carry[new[t]] = 0
                carry += d * stay[t]
            flat = dg.reshape(-1, 3 * HIDDEN)
            gu = before.reshape(-1, HIDDEN).T @ flat
            np.multiply(full, to_m, out=dg[..., 2 * HIDDEN :])
            update("u", gu)
            prev = prev.ravel()
            order = np.argsort(prev.astype(np.int16) if self.n < 1 << 15 else prev, kind="stable")
            rows, first = np.unique(prev[order], return_index=True)
            update("x", np.add.reduceat(flat[order], first, axis=0), rows)

    def pack(self, sq: dict[str, np.ndarray]) -> np.ndarray:
        """The weights and their sums of squared gradients as one array."""
        return np.concatenate([a.ravel() for k in WEIGHTS for a in (getattr(self, k), sq[k])])

    def unpack(self, flat: np.ndarray) -> tuple[Gru, dict[str, np.ndarray]]:
        """A model of this one's shape, and the sums, from what pack gave."""
        sizes = [getattr(self, k).size for k in WEIGHTS for _ in range(2)]
        parts = iter(np.split(flat, np.cumsum(sizes)[:-1]))
        got = {k: (next(parts).reshape(getattr(self, k).shape).copy(), next(parts).reshape(getattr(self, k).shape).copy()) for k in WEIGHTS}
        return Gru(self.n, *(got[k][0] for k in WEIGHTS)), {k: v[1] for k, v in got.items()}


WEIGHTS = ("x", "u", "c", "cb", "w", "wb")


@dataclass
class Model:
    head: np.ndarray  # sorted hashes of the frequent words
    log_count: np.ndarray  # log10(c + 0.1) of each
    word: np.ndarray  # word of the GRU of each; n for others
    n: int  # words of the GRU

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash in head, or -1."""
        if not len(self.head):
            return np.full(len(h), -1)
        i = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
        return np.where(self.head[i] == h, i, -1)

    def words(self, found: np.ndarray) -> np.ndarray:
        return np.where(found >= 0, self.word[found], self.n) if len(self.word) else np.full(len(found), self.n)


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c): how often each token stands in all rows, by its 64-bit hash."""

    def run(batches):
        for batch in batches:
            for _, part in tk.row_slices(batch, "text", SLICE):
                h, c = np.unique(tokens(*tk.buffers(part.column(0)))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c, pa.int64())], names=["word", "c"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _model(head: np.ndarray, c: np.ndarray, n: int) -> tuple[Model, Gru]:
    """The look-up and the untrained GRU. head and c: the frequent words, sorted by hash, and their counts."""
    order = np.lexsort((head, -c))
    order = np.concatenate([order[head[order] == END], order[head[order] != END]])[:VOCABULARY]
    word = np.full(len(head), len(order))
    word[order] = np.arange(len(order))
    return Model(head, np.log10(c + 0.1), word, len(order)), Gru.fresh(c[order].astype(np.float64), float(n - c[order].sum()))


def _fit(rows: DataFrame, held, gru: Gru, n: int) -> Gru:
    """``gru`` trained on every row's whole text (id, text), which have n tokens; held: the broadcast Model.

    A row is read in one round of each pass. Every task starts from the weights
    of the round before; of its tasks' weights a round keeps the mean by
    tokens, made piece by piece, so that no task or driver holds many models.
    """
    sc = rows.sparkSession.sparkContext
    flat = gru.pack({k: np.full(getattr(gru, k).shape, 1e-2, np.float32) for k in WEIGHTS})
    tasks = int(min(MOST_TASKS, max(1, -(-n // (ROUNDS * TASK_TOKENS)))))
    passes = int(min(MOST_PASSES, max(1, -(-SMALL // max(1, n)))))
    for i in range(passes * ROUNDS):
        start = sc.broadcast(flat)

        def run(batches, start=start):
            from pyspark import TaskContext

            m, (own, sq), n_seen = held.value, gru.unpack(start.value), 0
            for batch in batches:
                for _, part in tk.row_slices(batch, "text", SLICE):
                    h, row = tokens(*tk.buffers(part.column(0)))
                    own.fit(m.words(m.find(h)), tk.rows_of(row, part.num_rows), sq)
                    n_seen += len(h)
            if n_seen:
                pieces = [x.tobytes() for x in np.array_split(own.pack(sq), PIECES)]
                same = lambda x, t: pa.array(np.full(PIECES, x), t)
                yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), same(TaskContext.get().partitionId(), pa.int32()), same(n_seen, pa.int64()), pa.array(pieces, pa.binary())], names=["piece", "part", "n", "weights"])

        def mean(g):
            g = g.sort_values("part")
            share = g["n"].to_numpy(np.float64) / g["n"].sum()
            total = sum(w * np.frombuffer(x, np.float32) for w, x in zip(share, g["weights"], strict=True))
            return pd.DataFrame({"piece": g["piece"].iloc[:1], "weights": [total.astype(np.float32).tobytes()]})

        own = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(ROUNDS)) == i % ROUNDS).select("text").coalesce(tasks)
        got = own.mapInArrow(run, "piece int, part int, n long, weights binary").groupBy("piece").applyInPandas(mean, "piece int, weights binary").collect()
        if got:
            flat = np.concatenate([np.frombuffer(r["weights"], np.float32) for r in sorted(got, key=lambda r: r["piece"])])
        start.unpersist()
    return gru.unpack(flat)[0]


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id_col, held_out, n_tokens, n_known, train_tokens, base_score, score).

    base_score is the log10 probability under smoothed word counts of the
    training rows (CRC-32 of the id modulo 10 is not 0), score that under the
    model. Null and empty texts have the end alone. Repeated rows get equal
    scores and count each. Without training rows both scores are 0.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    train = rows.where(fold(F.col("id"), FOLDS) != 0)
    counts = durable(count_words(train))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    frequent = F.col("c") >= HEAD * n
    head = counts.where(frequent).toPandas()
    hashes = head["word"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(hashes)
    model, gru = _model(hashes[by], head["c"].to_numpy()[by], n)
    held = sc.broadcast(model)
    net = sc.broadcast(_fit(train, held, gru, n))
    norm = float(np.log10(n + 0.1 * (v + 1)))
    # what the base leaves to the words that the GRU has no word for
    in_gru = model.word < model.n
    others = 1 - ((10.0 ** model.log_count[in_gru]).sum() / 10**norm if len(in_gru) else 0.0)
    others = float(np.log10(max(others, 1e-300)))

    def score(batches):
        m, gru = held.value, net.value
        for batch in batches:
            for _, part in tk.row_slices(batch, "text", SLICE):
                h, row = tokens(*tk.buffers(part.column(1)))
                size = part.num_rows
                bounds = tk.rows_of(row, size)
                found = m.find(h)
                known = found >= 0
                word = m.words(found)
                log_c = np.where(known, m.log_count[found], 0.0) if len(m.head) else np.zeros(len(h))
                add = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731  no row is without its end
                at = np.flatnonzero(~known)
                other, own = h[at], row[at]
                order = np.lexsort((other, own))
                other, own = other[order], own[order]
                first = np.flatnonzero(np.append(True, (other[1:] != other[:-1]) | (own[1:] != own[:-1]))) if len(at) else np.zeros(0, np.int64)
                tf = np.diff(np.append(first, len(at)))
                lists = pa.array(tk.rows_of(own[first], size), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array(add(known.astype(np.int64)), pa.int64()),
                        pa.array(add(log_c), pa.float64()),
                        pa.array(gru.score(word, bounds) / np.log(10) + add(np.where(word == m.n, log_c - norm - others, 0.0)), pa.float64()),
                        pa.ListArray.from_arrays(lists, pa.array(other[first].view(np.int64))),
                        pa.ListArray.from_arrays(lists, pa.array(tf, pa.int32())),
                    ],
                    names=["id", "key", "n_tokens", "head_known", "head_base", "model", "words", "tfs"],
                )

    # written once, for its rare words are looked up apart from the rest
    keyed = rows.withColumn("key", F.xxhash64("text"))
    scored = durable(keyed.mapInArrow(score, f"id {kind}, key long, n_tokens long, head_known long, head_base double, model double, words array<long>, tfs array<int>"))
    # rows that repeat send their rare words each: ``copies`` undoes that
    tail = scored.select("id", "key", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("tfs").alias("tf"))))
    tail = tail.join(counts.where(~frequent), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    tail = tail.groupBy("id", "key").agg(
        F.sum(F.col("tf") * F.log10(F.col("c") + F.lit(0.1))).alias("tail_base"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("tail_known"), F.sum("tf").alias("tail_tokens")
    )
    s, t = scored.drop("words", "tfs").alias("s"), tail.alias("t")
    joined = s.join(t, F.col("s.id").eqNullSafe(F.col("t.id")) & (F.col("s.key") == F.col("t.key")), "left")
    rare_tokens = F.col("s.n_tokens") - F.col("s.head_known")
    copies = F.greatest(F.round(F.coalesce(F.col("t.tail_tokens"), F.lit(0)) / F.greatest(rare_tokens, F.lit(1))), F.lit(1.0))
    base = F.coalesce(F.col("t.tail_base"), F.lit(0.0)) / copies
    return joined.select(
        F.col("s.id").alias(id_col),
        (fold(F.col("s.id"), FOLDS) == 0).alias("held_out"),
        "n_tokens",
        (F.col("head_known") + F.coalesce((F.col("tail_known") / copies).cast("long"), F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("head_base") + base - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("model") + base).alias("score"),
    )
