"""The corpus pipeline against brute force, and its stages on odd tables."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pedon.llm import simhash

WORDS = [f"{a}{b}{c}" for a in "mi ra to lu ke so".split() for b in "ba di fo gu la".split() for c in "n s r".split()]


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(texts, ids):
    """Smallest id reachable over links of Jaccard similarity 0.8 or more, by all pairs."""
    sets, low = [shingles(t) for t in texts], list(range(len(texts)))
    near = [[j for j in low if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] or [i] for i in low]
    for _ in texts:
        low = [min(low[j] for j in near[i]) for i in range(len(texts))]
    return [ids[i] for i in low]


def test_near_copies_against_all_pairs(spark):
    texts = [prose(i, 12 + i % 40) for i in range(60)] + ["", None, "a b", "A  B", "one two three four five", "one two three four six"]
    rng = np.random.default_rng(1)
    for k in range(40):  # blocks replaced, appended and words changed, to both sides of the threshold
        w = prose(1000 + k, int(rng.integers(30, 200))).split()
        cut = int(len(w) * rng.uniform(0.02, 0.25))
        texts += [" ".join(w), " ".join(w[cut:] + prose(2000 + k, cut).split()), " ".join(w + prose(3000 + k, cut).split())]
        spots = set(rng.choice(len(w), max(1, len(w) // 60), replace=False).tolist())
        texts.append(" ".join("changed" if i in spots else x for i, x in enumerate(w)))
    line = prose(9, 30)
    texts += [f"{line} {prose(5000 + i, 12)}" for i in range(60)]  # a common passage
    ids = list(range(len(texts)))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(5)
    comp = {r["node"]: r["component"] for r in simhash.similar_groups(docs).collect()}
    assert [comp.get(i, i) for i in ids] == groups(texts, ids)


def test_near_copies_of_templates(spark):
    """Forms: 16 of 40 blocks with a common heading between, each text and one that differs in a block; every shingle stands in hundreds of texts."""
    rng = np.random.default_rng(3)
    blocks, heading = [prose(9000 + i, 20) for i in range(40)], prose(8999, 5)
    texts = []
    for _ in range(700):
        use = rng.permutation(40)[:17]
        other = use[:16].copy()
        other[rng.integers(16)] = use[16]
        texts += [f" {heading} ".join(blocks[i] for i in part) for part in (use[:16], other)]
    ids = list(range(len(texts)))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(5)
    comp = {r["node"]: r["component"] for r in simhash.similar_groups(docs).collect()}
    assert [comp.get(i, i) for i in ids] == groups(texts, ids)


def test_blocks_equal_all_pairs(spark, monkeypatch):
    """Small blocks and no join of few: what agrees in blocks is what agrees among all pairs that share a band."""
    monkeypatch.setattr(simhash, "MANY", 1)
    monkeypatch.setattr(simhash, "BLOCK", 3)
    base = prose(77, 60).split()
    texts = [" ".join(base[: 60 - k % 9] + prose(700 + k, k % 9).split()) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = simhash._signatures(docs, 5).withColumn("component", F.col("id") % 7).cache()
    held = [(r["id"], r["component"], set(r["bands"]), np.frombuffer(r["sig"], np.uint8)) for r in rows.collect()]
    want = {(a[0], b[0]) for a in held for b in held if a[0] < b[0] and a[1] != b[1] and a[2] & b[2] and (a[3] == b[3]).mean() >= simhash.SHARE}
    assert want and {(r["a"], r["b"]) for r in simhash._by_bands(rows).collect()} == want


def test_alike_but_apart_makes_no_row_for_each_pair(spark, monkeypatch):
    """500 texts at a similarity of 0.72 with each other and no link: what a step holds grows with the texts, not with their pairs (124,750)."""
    base, held = prose(4242, 220).split(), []
    texts = [" ".join(base[:100] + prose(20000 + i, 31).split() + base[131:]) for i in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    real = simhash.durable

    def counted(df):
        out = real(df)
        held.append(out.count())
        return out

    monkeypatch.setattr(simhash, "durable", counted)
    assert simhash.similar_groups(docs).count() == 0
    assert max(held) <= 70 * len(texts)


@pytest.mark.parametrize("many", [1, 32])
def test_pairs_that_share_no_band_link(spark, monkeypatch, many):
    """Bands only come first: with bands that near copies hardly share, groups are still those of all pairs, by joins and in blocks."""
    for name, value in (("BANDS", 6), ("ROWS", 60), ("MANY", many), ("BLOCK", 20)):
        monkeypatch.setattr(simhash, name, value)
    rng, line, texts = np.random.default_rng(21), prose(31, 15), []
    for k in range(40):
        w = prose(4000 + k, int(rng.integers(20, 200))).split()
        cut = int(len(w) * rng.uniform(0.02, 0.14))
        texts += [" ".join([line, *w]), " ".join([line, *w[cut:], *prose(6000 + k, cut).split()]), " ".join([line, *w, *prose(7000 + k, cut).split()])]
    ids = list(range(len(texts)))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(5)
    comp = {r["node"]: r["component"] for r in simhash.similar_groups(docs).collect()}
    want = groups(texts, ids)
    assert [comp.get(i, i) for i in ids] == want and len(set(want)) < 100


def test_blocks_keep_every_pair_of_the_similarity():
    """Parities are a bound: of 100 pairs of sets at a similarity of 0.8 or more none is dropped in a block."""
    rng, sets = np.random.default_rng(41), []
    for k in range(100):
        own = rng.integers(0, 1 << 64, 100 + 3 * k, dtype=np.uint64)
        lacks = int(rng.integers(1, len(own) // 9))
        sets += [own, np.append(own[lacks:], rng.integers(0, 1 << 64, lacks, dtype=np.uint64))]
    odd = np.concatenate([simhash._parities(np.sort(x), np.zeros(len(x), np.int64), 1) for x in sets])
    side, n = np.arange(200) % 2, [len(x) for x in sets]
    block = pa.table({"side": side, "id": np.arange(200), "component": np.arange(200), "n": pa.array(n, pa.int32()), "odd": list(odd), "sig": [bytes(256)] * 200})
    got = simhash._agreeing(0.8)(block)
    assert {(2 * k, 2 * k + 1) for k in range(100)} <= set(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True))


def test_null_and_repeated_ids_are_compared(spark):
    w = [prose(8100 + k, 100).split() for k in range(4)]
    near = lambda k, *at: " ".join("changed" if i in at else x for i, x in enumerate(w[k]))
    rows = [(1, near(0)), (None, near(0, 3)), (None, near(1)), (None, near(1, 5)), (2, near(2)), (2, near(2, 7)), (2, near(3)), (2, near(3)), (3, None), (None, ""), (None, "!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.near_dedup_filter(spark, docs, "").collect()]
    low = lambda k, *at: min(near(k), near(k, *at), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    assert sorted(got, key=str) == sorted([(1, near(0)), (None, low(1, 5)), (2, low(2, 7)), (2, near(3)), (2, near(3)), (3, None), (None, ""), (None, "!")], key=str)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    good = [prose(i, 60) for i in range(150)]
    bad = [" ".join("$%!#" + str(j * i % 97) for j in range(60)) for i in range(100)]
    item = prose(7777, 30)
    w = prose(500, 200).split()
    rest = [good[0] + " ", good[1].replace(" ", "\t"), " ".join(w), " ".join([*w[:100], "new", *w[101:]]), "Before " + item + " after", prose(600, 5000)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([*good, *bad, *rest])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 150), 0) for i in range(250)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {r[0]: r[1] for r in rows}


def test_run_against_brute_force(spark, corpus):
    folder, texts = corpus
    got = corpus_pipeline.run(spark, folder).toPandas()
    # good prose stays but for the copies of 0 and 1 (250, 251), the near copy of 252 and what holds the item
    assert set(got["doc_id"]) == {*range(150), 252, 255}
    own = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    total = {i: len(own.encode(texts[i], add_special_tokens=False).ids) + 1 for i in set(got["doc_id"])}
    assert got.groupby("doc_id")["length"].sum().to_dict() == total
    used = got.groupby("sequence_id")["length"].sum()
    assert used.max() <= 2048 and len(used) == -(-sum(total.values()) // 2048)  # no better packing exists


def test_stages_on_odd_tables(spark, corpus):
    folder, _ = corpus
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, keep string, _gone long"
    rows = [(1, None, None, None, None, "a", "b", 1), (2, "", "", "", 0, "a", "b", 1), (None, prose(1, 9), "en", "s", 1, "a", "b", 1), (None, None, None, None, None, None, None, None), (3, prose(1, 60), "en", "s", 1, "a", "b", 1), (3, prose(1, 60), "en", "s", 1, "a", "b", 1), (4, "x" * 3_000_000 + " y" * 500_000, "en", "s", 1, "a", "b", 1)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType, name
        n = {"exact_dedup": 4}.get(name, 7)
        assert out.count() <= 7 if name == "quality" else out.count() == n, name
        assert stage(spark, docs.limit(0), folder).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert packed.where("start = 0").count() == 7 and packed.where(F.col("doc_id").isNull()).count() == 2
