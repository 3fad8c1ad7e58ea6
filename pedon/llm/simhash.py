"""SimHash near-duplicate groups by multi-index hashing.

A fingerprint has 64 bits in two segments of 32. Of two fingerprints that differ
in two bits at most, either the first segments differ in one bit at most or the
second segments are equal. So every distinct fingerprint stands in one table for
each segment, under the segment's value; it looks up the Hamming ball of radius
one around its first segment (the values with one bit more, as those with one
bit less find it themselves) and the value of its second. What a look-up finds
is verified by the complete distance.

A value that more than ``HOT`` fingerprints share is split: its fingerprints are
tabled anew under that value and the ball of radius one around their other
segment, and what meets there is linked to the smallest fingerprint of the
entry, not pairwise, so that no list of pairs is built however many near copies
there are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pedon.llm import textkit as tk
from pedon.llm.graph import components, durable

SEED = 42
#: Fingerprints under one value of a segment that are compared pairwise; a value of more is split.
HOT = 32


def shingle_hashes(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64, row) of each row's shingles of k words, joined by one space; a shorter row is one shingle, a row without words none."""
    data = tk.FOLD[data]
    s, e, row = tk.words(data, offs, tk.NOT_SPACE)
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # words of the buffer, one space after each
    keep = tk.NOT_SPACE[data]
    size = e - s
    new_s = np.cumsum(size + 1) - size - 1
    packed = np.full(int(size.sum()) + len(s), 32, np.uint8)
    at = np.ones(len(packed), bool)
    at[new_s + size] = False
    packed[at] = data[keep]
    bounds = tk.rows_of(row, len(offs) - 1)
    n_row = np.diff(bounds)
    full = np.zeros(len(s), bool)
    full[: max(0, len(s) - k + 1)] = row[: max(0, len(s) - k + 1)] == row[k - 1 :]
    short = (n_row > 0) & (n_row < k)
    full[bounds[:-1][short]] = True
    first = np.flatnonzero(full)
    last = np.minimum(first + k, bounds[row[first] + 1]) - 1
    raw, digest = packed.tobytes(), xxhash.xxh64_intdigest
    begin, stop = new_s[first], new_s[last] + size[last]
    spans = ((a, b) for i in range(0, len(first), 1 << 16) for a, b in zip(begin[i : i + (1 << 16)].tolist(), stop[i : i + (1 << 16)].tolist(), strict=True))
    return np.fromiter((digest(raw[a:b], SEED) for a, b in spans), np.uint64, len(first)), row[first]


def majority(h: np.ndarray, row: np.ndarray, n: int, words64: int = 1) -> np.ndarray:
    """Fingerprint of each of n rows: the bits set in over half of the row's hashes (rows are in order); zero without any."""
    bounds = tk.rows_of(row, n)
    out = np.zeros((n, 8), np.uint8)
    for i in np.flatnonzero(np.diff(bounds)):
        part = h[bounds[i] : bounds[i + 1]]
        bits = np.zeros(64, np.int64)
        for j in range(0, len(part), 1 << 14):
            bits += np.unpackbits(part[j : j + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(bits * 2 > len(part), bitorder="little")
    return out.view(np.uint64).ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id_col, fp long) of each row; the fingerprint's 64 bits are those of the signed long. Null and empty texts have 0."""

    def run(batches):
        for batch in batches:
            for _, part in tk.row_slices(batch, "text"):
                h, row = shingle_hashes(*tk.buffers(part.column(1)), shingle)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(majority(h, row, part.num_rows).view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long").withColumnRenamed("id", id_col)


_BALL = "transform(sequence(0, 31), i -> {0} ^ shiftleft(1L, i))"


def segment_table(fps: DataFrame) -> DataFrame:
    """(segment, value, fp): each distinct fingerprint in the tables of both segments."""
    halves = F.array(F.struct(F.lit(0).alias("segment"), F.expr("shiftrightunsigned(fp, 32)").alias("value")), F.struct(F.lit(1).alias("segment"), F.expr("fp & 4294967295L").alias("value")))
    return fps.select("fp", F.inline(halves)).select("segment", "value", "fp")


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b) over the distinct values of ``fp``: enough verified pairs at distance two or less to connect all that such pairs connect."""
    table = segment_table(fps)
    # values that a flip of one bit 0 leads to, so that each pair of neighbours meets once
    up = F.filter(F.expr(_BALL.format("value")), lambda v: v > F.col("value"))
    looks = table.select("segment", F.explode(F.when(F.col("segment") == 0, F.concat(F.array("value"), up)).otherwise(F.array("value"))).alias("value"), "fp", F.col("value").alias("own"))
    looks = looks.select("segment", "value", "fp", (F.col("own") == F.col("value")).alias("own"))
    many = durable(table.groupBy("segment", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("segment", "value"))
    keys = ["segment", "value"]
    cold = table.join(many, keys, "left_anti").select(*keys, F.col("fp").alias("b"))
    near = looks.join(cold, keys).where("own = false or fp < b").select(F.col("fp").alias("a"), "b").where("bit_count(a ^ b) <= 2")
    # hot values: a member's other segment with its ball; a look-up from a neighbour has one bit less to spend
    other = F.when(F.col("segment") == 0, F.expr("fp & 4294967295L")).otherwise(F.expr("shiftrightunsigned(fp, 32)"))
    split = looks.join(many, keys, "left_semi").withColumn("other", other)
    split = split.select(*keys, F.explode(F.when(F.col("own"), F.concat(F.array("other"), F.expr(_BALL.format("other")))).otherwise(F.array("other"))).alias("other"), "fp", "own")
    # a window's rows are 33 members and 32 look-ups at most
    star = split.withColumn("a", F.min(F.when(F.col("own"), F.col("fp"))).over(Window.partitionBy(*keys, "other"))).where("a <> fp")
    star = star.select("a", F.col("fp").alias("b")).where("bit_count(a ^ b) <= 2")
    return near.unionByName(star).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per row of ``docs``: (id_col, fingerprint, component_id).

    Fingerprints link at two or fewer differing bits; component_id is the
    smallest id reachable over links. Equal texts and repeated rows have equal
    fingerprints and share a component; so do all null, empty and white-space
    texts (fingerprint zero). Null ids are passed over when the smallest id is
    sought. Other columns are not looked at.
    """
    rows = durable(fingerprints(docs, id_col, text_col, shingle))
    fps = durable(rows.groupBy("fp").agg(F.min(id_col).alias("low")))
    comp = components(links(fps.select("fp")))
    # the smallest id of each component, by fingerprint
    named = fps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    by_fp = named.join(least, "component").select("fp", "component_id")
    return rows.join(by_fp, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Ids or keys of at most so many rows (counted) are broadcast, so that texts needn't travel; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Texts under one key that are compared pairwise by a join; of more, in blocks of BLOCK.
MANY, BLOCK = 32, 1024
#: Bands of ROWS smallest hashes that near copies first meet by: texts at a similarity of 0.8 share none with a chance of 4e-9, at 0.5 they share one with 0.63, at 0.25 with 0.016.
BANDS, ROWS = 64, 6
#: Smallest hashes of a signature, one byte each, and the share that must agree in blocks without a similarity.
AGREE, SHARE = 256, 0.65
#: Bits of a shingle set's parities, and places that shingles are counted in to order them.
PARITY, PLACES = 2048, 1 << 20


def _once(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each row's distinct shingles of k words, in order of row and hash; a shorter row is one shingle, a row without words none."""
    data = tk.FOLD[data]
    s, e, row = tk.words(data, offs, tk.NOT_SPACE)
    h = tk.span_hashes(data, s, e)
    left = tk.rows_of(row, len(offs) - 1)[1:][row] - np.arange(len(row))
    size = np.diff(tk.rows_of(row, len(offs) - 1))[row]
    out = np.full(len(h), np.uint64(k), np.uint64)
    for j in range(k):  # a shorter row's shingle has zeros for the words that it lacks
        part = np.zeros(len(h), np.uint64)
        part[: max(0, len(h) - j)] = np.where(left[: max(0, len(h) - j)] > j, h[j:], np.uint64(0))
        out = tk.mix(out * np.uint64(0xD1342543DE82EF95) + part)
    full = (left >= k) | ((size < k) & (left == size))
    out, row = out[full], row[full]
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    first = np.append(True, (out[1:] != out[:-1]) | (row[1:] != row[:-1])) if len(out) else np.zeros(0, bool)
    return out[first], row[first]


def _small(ids: DataFrame) -> DataFrame:
    """``ids`` marked for broadcast where their number allows."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")


def _shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(id, shingles array<long>): the distinct shingle hashes of each row of (id, text)."""

    def run(batches):
        for batch in batches:
            for _, part in tk.row_slices(batch, "text"):
                h, row = _sets(*tk.buffers(part.column(1)), shingle)
                offs = tk.rows_of(row, part.num_rows).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offs), pa.array(h.view(np.int64)))], names=["id", "shingles"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, shingles array<long>")


def _parities(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """The shingles of each of n rows, dealt by hash into PARITY bits that are 1 where an odd number fell; as int64 words.

    Each shingle that only one of two texts has flips one bit of one of them, so
    the texts differ in as many shingles as bits or more.
    """
    at, times = np.unique(row * PARITY + (h % np.uint64(PARITY)).astype(np.int64), return_counts=True)
    bits = np.zeros(n * PARITY, np.uint8)
    bits[at] = times & 1
    return np.packbits(bits.reshape(n, PARITY), axis=1).view(np.int64)


def _commonness(rows: DataFrame, shingle: int) -> np.ndarray:
    """How common the shingles of each of PLACES places are in all texts of (id, text): four steps for each doubling of their number."""
    parts = 256

    def count(batches):
        n = None
        for batch in batches:
            for _, part in tk.row_slices(batch, "text"):
                h, _ = _sets(*tk.buffers(part.column(1)), shingle)
                n = np.zeros(PLACES, np.int64) if n is None else n
                n += np.bincount((h % np.uint64(PLACES)).astype(np.int64), minlength=PLACES)
        if n is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array(np.arange(parts), pa.int32()), "n": pa.array([x.tobytes() for x in n.reshape(parts, -1)], pa.binary())})

    def total(group: pa.Table) -> pa.Table:
        n = sum(np.frombuffer(x, np.int64) for x in group["n"].to_pylist())
        return pa.table({"part": group["part"].slice(0, 1), "n": pa.array([np.floor(4 * np.log2(n + 1)).astype(np.uint8).tobytes()], pa.binary())})

    found = rows.mapInArrow(count, "part int, n binary").groupBy("part").applyInArrow(total, "part int, n binary").collect()
    return np.frombuffer(b"".join(bytes(x["n"]) for x in sorted(found, key=lambda x: x["part"])) or bytes(PLACES), np.uint8)


def _prefixes(h: np.ndarray, row: np.ndarray, n: int, similarity: float, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the first shingles of each of n rows' sets in one order for all texts, one more than a similar text may lack.

    So two texts of the similarity share one of them, whatever the order; rare
    ones come first, that few others do.
    """
    bounds = tk.rows_of(row, n)
    size = np.diff(bounds)
    order = np.lexsort((h, common[(h % np.uint64(PLACES)).astype(np.int64)], row))
    first = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + (size > 0)
    held = np.arange(len(h)) - bounds[row] < first[row]
    return np.append(0, np.cumsum(first)), h[order][held]


def _signatures(rows: DataFrame, shingle: int, similarity: float | None = None) -> DataFrame:
    """(id, bands array<long>, sig binary) of each row of (id, text) with words: its bands of smallest hashes, tagged with their number, and one byte of each of the first AGREE.

    With a similarity, in place of the signature: (n, odd array<long>, first
    array<long>), its number of shingles, their parities, and its prefix.
    """
    held = None if similarity is None else rows.sparkSession.sparkContext.broadcast(_commonness(rows, shingle))
    rng = np.random.default_rng(SEED)
    flips, odds = (rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) for _ in range(2))

    def run(batches):
        for batch in batches:
            for _, part in tk.row_slices(batch, "text"):
                h, row = _sets(*tk.buffers(part.column(1)), shingle)
                bounds = tk.rows_of(row, part.num_rows)
                full = np.flatnonzero(np.diff(bounds))
                low = np.zeros((BANDS * ROWS, len(full)), np.uint64)
                for i in range(BANDS * ROWS if len(full) else 0):
                    low[i] = np.minimum.reduceat((h ^ flips[i]) * (odds[i] | np.uint64(1)), bounds[full])
                bands = np.zeros((len(full), BANDS), np.uint64)
                for i in range(BANDS):
                    key = np.full(len(full), np.uint64(i))
                    for j in range(ROWS):
                        key = tk.mix(key * np.uint64(0xD1342543DE82EF95) + low[i * ROWS + j])
                    bands[:, i] = key
                lists = lambda x: pa.ListArray.from_arrays(np.arange(len(full) + 1, dtype=np.int32) * x.shape[1], pa.array(x.view(np.int64).ravel()))
                out = {"id": part.column(0).take(pa.array(full)), "bands": lists(bands)}
                if held is None:
                    sig = np.ascontiguousarray(tk.mix(low[:AGREE]).astype(np.uint8).T)
                    out["sig"] = pa.array([x.tobytes() for x in sig], pa.binary())
                else:
                    offs, first = _prefixes(h, row, part.num_rows, similarity, held.value)
                    first = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(first.view(np.int64))).take(pa.array(full))
                    out |= {"n": pa.array(np.diff(bounds)[full], pa.int32()), "odd": lists(_parities(h, row, part.num_rows)[full]), "first": first}
                yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, bands array<long>, " + ("sig binary" if held is None else "n int, odd array<long>, first array<long>"))


def _agreeing(similarity: float | None) -> Callable[[pa.Table], pa.Table]:
    """For a block: (a, b) of its rows of side 0 and side 1, of different groups, whose parities allow the similarity; without one, whose signatures agree in SHARE."""

    def run(group: pa.Table) -> pa.Table:
        out = []
        left, right = (group.filter(pa.compute.equal(group["side"], x)).combine_chunks() for x in (0, 1))
        ids, of = right["id"], right["component"].to_numpy()
        if similarity is None:
            sigs = [np.frombuffer(b"".join(x["sig"].to_pylist()), np.uint8).reshape(-1, AGREE) for x in (left, right)]
        else:
            n = [x["n"].to_numpy() for x in (left, right)]
            odd = [pa.compute.list_flatten(x["odd"]).to_numpy().view(np.uint64).reshape(-1, PARITY // 64) for x in (left, right)]  # of signed words, numpy counts the bits of the absolute value
        for i, (own, comp) in enumerate(zip(left["id"], left["component"].to_numpy(), strict=True)):
            hit = np.flatnonzero(of != comp)
            if similarity is None:
                hit = hit[np.count_nonzero(sigs[1][hit] == sigs[0][i], axis=1) >= SHARE * AGREE]
            else:
                hit = hit[np.minimum(n[0][i], n[1][hit]) >= similarity * np.maximum(n[0][i], n[1][hit]) - 1e-9]
                apart = np.bitwise_count(odd[1][hit] ^ odd[0][i]).sum(axis=1, dtype=np.int64)
                hit = hit[apart <= (1 - similarity) / (1 + similarity) * (n[0][i] + n[1][hit]) + 1e-6]
            if len(hit):
                out.append(pa.table({"a": pa.repeat(own, len(hit)), "b": ids.take(pa.array(hit))}))
        empty = pa.table({"a": left["id"].slice(0, 0), "b": ids.slice(0, 0)})
        return pa.concat_tables([empty, *out]).combine_chunks()

    return run


def _by_bands(rows: DataFrame, keys: DataFrame | None = None, similarity: float | None = None) -> DataFrame:
    """(a, b) of candidates among rows (id, component, bands, sig) of different groups that share a band.

    Under a key of MANY texts or fewer all of them meet by a join. Under more,
    those outside the key's largest group meet all, in blocks of BLOCK by BLOCK
    that are a task's group each, and only pairs whose signatures agree come out.
    With other keys (id, component, key, n) and a similarity, rows need only (id,
    n, odd), and all pairs come out but those whose sizes or parities exclude it.
    """
    bounded = similarity is not None
    if keys is None:
        keys = rows.select("id", "component", F.explode("bands").alias("key"), F.lit(1).alias("n"))
    each = keys.groupBy("key", "component").agg(F.count(F.lit(1)).alias("k"))
    stats = durable(each.groupBy("key").agg(F.sum("k").alias("texts"), F.max(F.struct("k", "component")).alias("main")).where("texts > main.k"))
    few = durable(keys.join(stats.where(F.col("texts") <= MANY).select("key"), "key").select("key", "id", "component", "n"))
    t = F.lit(similarity if bounded else 0.0)
    pairs = few.toDF("key", "a", "ca", "na").join(few.toDF("key", "b", "cb", "nb"), "key").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (F.least("na", "nb") >= t * F.greatest("na", "nb") - 1e-9)).select("a", "b")
    many = stats.where(F.col("texts") > MANY).select("key", "main", F.ceil((F.col("texts") - F.col("main.k")) / BLOCK).cast("int").alias("n0"), F.ceil(F.col("texts") / BLOCK).cast("int").alias("n1"))
    hot = durable(keys.select("id", "component", "key").join(many, "key"))
    cols = ["n", "odd"] if bounded else ["sig"]
    held = hot.join(rows.select("id", *cols).join(_small(hot.select("id").distinct()), "id", "left_semi"), "id")
    dealt = lambda n: F.pmod(F.xxhash64("id", "key"), F.col(n)).cast("int")
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = held.where("component <> main.component").select("key", "id", "component", *cols, F.lit(0).alias("side"), dealt("n0").alias("i"), to("n1").alias("j"))
    right = held.select("key", "id", "component", *cols, F.lit(1).alias("side"), to("n0").alias("i"), dealt("n1").alias("j"))
    kind = rows.schema["id"].dataType.simpleString()
    return _once(pairs.unionByName(left.unionByName(right).groupBy("key", "i", "j").applyInArrow(_agreeing(similarity), f"a {kind}, b {kind}")))


def _to_commonest(met: DataFrame) -> DataFrame:
    """(a, b): each text of ``met`` (id, key, texts) and the commonest text under each of its bands: the one with the most company in all its bands (what near copies were made from)."""
    common = durable(met.groupBy("id").agg(F.sum(F.log("texts")).alias("common")))
    first = met.join(common, "id").groupBy("key").agg(F.max_by("id", F.struct("common", F.xxhash64("id"))).alias("b"))
    return _once(met.select(F.col("id").alias("a"), "key").join(first, "key"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(node, component) of the ids that have a link: texts whose sets of shingles have that Jaccard similarity or more.

    Each text is compared with the commonest text under its bands of smallest
    hashes first, which joins most copies. All texts then meet those of other
    groups with which they share a shingle of their prefixes, and every pair of
    the similarity does, so none is missed. The sets alone decide. Equal texts
    in different groups are a pair like others; repeated ids count as one text.
    """
    texts = _named(docs, id_col, text_col)
    signed = durable(_signatures(texts, shingle, similarity))
    bands = signed.select("id", "n", F.explode("bands").alias("key"))
    shared = durable(bands.groupBy("key").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"))
    met = bands.join(_small(shared), "key")
    apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)

    def ids_of(pairs: DataFrame) -> DataFrame:
        return _small(durable(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = durable(pairs)
        odd = signed.select("id", "n", "odd").join(ids_of(pairs), "id", "left_semi")
        both = pairs.join(odd.toDF("a", "na", "sa"), "a").join(odd.toDF("b", "nb", "sb"), "b")
        near = durable(both.where(apart <= F.lit((1 - similarity) / (1 + similarity)) * (F.col("na") + F.col("nb")) + 1e-6).select("a", "b").distinct())
        sets = durable(_shingle_sets(texts.join(ids_of(near), "id", "left_semi"), shingle))
        both = near.join(sets.toDF("a", "ha"), "a").join(sets.toDF("b", "hb"), "b")
        common = F.size(F.array_intersect("ha", "hb"))
        return durable(both.where(common >= F.lit(similarity) * (F.size("ha") + F.size("hb") - common)).select("a", "b").distinct())

    groups = durable(components(verified(_to_commonest(durable(met)))))
    grouped = signed.select("id", "first").join(_small(groups.withColumnRenamed("node", "id")), "id", "left")
    prefixes = grouped.select("id", F.coalesce("component", "id").alias("component"), F.explode("first").alias("key"))
    # shingles under which groups meet; most are of one text or one group
    of_key = Window.partitionBy("key")
    mixed = prefixes.withColumns({"low": F.min("component").over(of_key), "high": F.max("component").over(of_key)}).where("low < high")
    keys = durable(mixed.select("id", "component", "key").join(signed.select("id", "n"), "id"))
    found = verified(_by_bands(signed, keys, similarity))
    if found.isEmpty():
        return groups
    return components(found.unionByName(groups.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with a column _near_row: a number for each id and text, in order of ids, null ids last."""
    names = ["_near_null", "_near_id", "_near_text"]
    own = docs.withColumns(dict(zip(names, [F.col(id_col).isNull(), F.col(id_col), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)], strict=True)))
    order = durable(own.select(*names).distinct().orderBy(*names).withColumn("_near_row", F.monotonically_increasing_id()))
    known = _small(order.toDF("_a", "_b", "_c", "_near_row"))
    same = own["_near_null"].eqNullSafe(known["_a"]) & own["_near_id"].eqNullSafe(known["_b"]) & own["_near_text"].eqNullSafe(known["_c"])
    return own.join(known, same).select(*docs.columns, "_near_row")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with all its columns, without the rows that have a smaller id in their group of near copies.

    Rows whose shingles have the similarity link, and groups are closed over
    links. Null ids are compared like others and go last. Of one id or of null,
    the row stays whose text has the smallest SHA-256; rows that repeat both id
    and text stay or go together. Rows without words stay.
    """
    rows = docs
    if not docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) | F.col(id_col).isNull()).isEmpty():
        rows, id_col = _numbered(docs, id_col, text_col), "_near_row"
    groups = similar_groups(rows, id_col, text_col, shingle, similarity)
    gone = groups.where("node <> component").select(F.col("node").alias("_gone"))
    return rows.join(_small(gone), rows[id_col] == gone["_gone"], "left_anti").select(*docs.columns)
