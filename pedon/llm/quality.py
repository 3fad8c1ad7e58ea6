"""Quality classifier: a byte-level convolutional network in numpy.

Filters of a few bytes run over every position of a text. Their responses are
max-pooled over overlapping chunks that cover the whole text (two neighbouring
blocks each), and the chunks' maximum and mean make the features of one
logistic unit. A filter's weights are tables by byte, so the convolution is a
sum of table look-ups, and the gradient of a max-pool reaches only the bytes
where a filter responds most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedon.llm import textkit as tk
from pedon.llm.folds import fold

WIDTH, FILTERS, BLOCK = 6, 12, 256
#: Labelled documents of each class that the network learns from, about; their whole texts are read.
SAMPLE_PER_CLASS = 1500
#: Blocks whose responses are held at once, so that memory doesn't grow with a text.
RUN = 256


@dataclass
class Net:
    table: np.ndarray  # (WIDTH, 257, FILTERS); byte 256 stands after the end
    bias: np.ndarray
    out: np.ndarray  # of the maximum and of the mean
    shift: float


def _pool(net: Net, data: np.ndarray, offs: np.ndarray, where: bool = False):
    """Block maxima of the filters' responses: (block values, row of each block[, position of each maximum, end of each block's row])."""
    n = np.diff(offs)
    blocks = -(-n // BLOCK)
    row = np.repeat(np.arange(len(n)), blocks)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = offs[:-1][row] + nth * BLOCK
    end = np.repeat(offs[1:], blocks)
    top = np.zeros((len(row), FILTERS), np.float32)
    pos = np.empty(top.shape, np.int64) if where else None
    for i in range(0, len(row), RUN):
        own = begin[i : i + RUN]
        a, b = int(own[0]), int(begin[i + RUN] if i + RUN < len(row) else len(data))
        ext = np.full(b - a + WIDTH, 256)
        more = min(len(data), b + WIDTH) - a
        ext[:more] = data[a : a + more]
        ends = np.unique(end[i : i + RUN])
        r = net.table[0][ext[: b - a]]
        for k in range(1, WIDTH):
            x = ext[k : k + b - a].copy()
            gone = (ends[:, None] - np.arange(1, k + 1) - a).ravel()  # what begins there would reach behind its row
            x[gone[(gone >= 0) & (gone < b - a)]] = 256
            r += net.table[k][x]
        top[i : i + RUN] = np.maximum.reduceat(r, own - a, axis=0)
        if where:
            for j, (c, d) in enumerate(zip(own - a, np.append(own[1:], b) - a, strict=True)):
                pos[i + j] = a + c + r[c:d].argmax(axis=0)
    return (top, row, pos, end) if where else (top, row)


def _features(net: Net, top: np.ndarray, row: np.ndarray, n: int):
    """Maximum and mean over the chunks of each row; rows without bytes have zeros."""
    first = tk.rows_of(row, n)
    act = np.maximum(top + net.bias, 0)
    # a chunk is a block and the next one of the same row; the last block closes the row
    nxt = np.minimum(np.arange(len(row)) + 1, max(len(row) - 1, 0))
    same = row[nxt] == row if len(row) else np.zeros(0, bool)
    chunk = np.where(same[:, None], np.maximum(act, act[nxt]), act) if len(row) else act
    feats = np.zeros((n, 2 * FILTERS), np.float32)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        feats[full, :FILTERS] = np.maximum.reduceat(chunk, first[full], axis=0)
        feats[full, FILTERS:] = np.add.reduceat(chunk, first[full], axis=0) / np.diff(first)[full, None]
    return feats, act, chunk, nxt, same, first


def probability(net: Net, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each row; a row without bytes has the bias alone."""
    top, row = _pool(net, data, offs)
    feats = _features(net, top, row, len(offs) - 1)[0]
    return 1 / (1 + np.exp(-np.clip(feats.astype(np.float64) @ net.out + net.shift, -40, 40)))


def train(texts: list[bytes], labels: np.ndarray, prior: float, seed: int = 7, epochs: int = 8, batch: int = 32) -> Net:
    """Fit by Adam on whole mini-batches; prior is the share of label 1 among all labelled rows, whatever the sample's share."""
    rng = np.random.default_rng(seed)
    net = Net(rng.normal(0, 0.3, (WIDTH, 257, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, 2 * FILTERS), 0.0)
    if not texts or labels.min() == labels.max():
        p = np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99)
        net.out[:] = 0
        net.shift = float(np.log(p / (1 - p)))
        return net
    slots = {k: [np.zeros_like(np.asarray(v, np.float64)), np.zeros_like(np.asarray(v, np.float64))] for k, v in (("table", net.table), ("bias", net.bias), ("out", net.out), ("shift", 0.0))}
    step = 0

    def adam(key: str, grad, rate: float):
        m, v = slots[key]
        m += 0.1 * (grad - m)
        v += 0.001 * (np.square(grad) - v)
        slots[key] = [m, v]
        return rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        rate = 0.02 * (1 - epoch / epochs)
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            step += 1
            part = [texts[j] for j in pick]
            data = np.frombuffer(b"".join(part), np.uint8)
            offs = np.concatenate([[0], np.cumsum([len(t) for t in part])])
            top, row, pos, end = _pool(net, data, offs, where=True)
            ext = np.append(data, np.zeros(WIDTH, np.uint8))
            feats, act, chunk, nxt, same, first = _features(net, top, row, len(part))
            p = 1 / (1 + np.exp(-np.clip(feats @ net.out + net.shift, -40, 40)))
            err = (p - labels[pick]) / len(part)
            d_feat = err[:, None] * net.out
            d_chunk = d_feat[row, FILTERS:] / np.maximum(np.diff(first), 1)[row, None]
            d_chunk += d_feat[row, :FILTERS] * (chunk == feats[row, :FILTERS])
            # a chunk's gradient goes to the block that has its maximum
            later = same[:, None] & (act[nxt] > act)
            d_act = np.where(later, 0, d_chunk)
            np.add.at(d_act, nxt, np.where(later, d_chunk, 0))
            d_act = d_act * (act > 0)
            grad = np.zeros(net.table.shape)
            col = np.broadcast_to(np.arange(FILTERS), pos.shape)
            for k in range(WIDTH):
                b = np.where(pos + k >= end[:, None], 256, ext[pos + k])
                np.add.at(grad[k], (b, col), d_act)
            net.table -= adam("table", grad, rate).astype(np.float32)
            net.bias -= adam("bias", d_act.sum(axis=0), rate).astype(np.float32)
            net.out -= adam("out", feats.T @ err + 1e-4 * net.out, rate)
            net.shift -= float(adam("shift", err.sum(), rate))
    share = labels.mean()
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    net.shift += float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return net


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> Net:
    """Fit the network on the whole texts of about ``per_class`` labelled documents of each class, picked by a hash of their id.

    An id with several labels counts with the largest, one with several texts
    with the smallest; null and empty texts and null ids aren't learned from.
    Without labels, or with labels of one class, every document gets one
    probability.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.create_map(*[F.lit(x) for k in (0, 1) for x in (k, min(1.0, per_class / max(1, n.get(k, 0))))])
    picked = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share[F.col("label")] * F.lit(float(1 << 30)))
    rows = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
        .join(F.broadcast(picked), "id")
        .groupBy("id")
        .agg(F.first("label").alias("label"), F.min("text").alias("text"))
        .toPandas()
        .sort_values("id")
    )
    rows = rows[rows["text"].map(lambda t: t is not None and len(t) > 0).astype(bool)]
    total = sum(n.values())
    return train([bytes(t) for t in rows["text"]], rows["label"].to_numpy(np.float64), n.get(1, 0) / total if total else 0.5)


def score(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of each row, over its whole text; null counts as empty, and an empty text has the network's constant."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            for _, part in tk.row_slices(batch, "text", 1 << 16):
                p = probability(held.value, *tk.buffers(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p, pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id_col, held_out, score, predicted).

    Labels of the held-out third of ids (CRC-32 modulo 3 is 1) aren't learned
    from. Repeated rows get equal scores; null ids are scored too.
    """
    net = learn(docs, labels.where(fold(F.col(id_col), 3) != 1), id_col, text_col)
    return score(docs, net, id_col, text_col).select(
        id_col, (fold(F.col(id_col), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep(docs: DataFrame, net: Net, text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, without the rows that score under 0.5.

    Null counts as empty, and an empty text has the network's constant, as all
    texts have where there was nothing to learn from; rows that repeat stay or
    go together, and ids aren't looked at.
    """
    held = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for _, part in tk.row_slices(batch, text_col, 1 << 16):
                yield part.filter(pa.array(probability(held.value, *tk.buffers(part.column(at))) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
