"""Token counts against the library, whole texts at a time."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pedon.llm import pretokens, textkit, token_counts

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
SCHEMA = "doc_id long, text string, n_tokens string, lo int, id int"
SIGNS = [*"aAbstdmlvre'’ 1٣ \n\t é中ßñ!?.,<|>", "<|endoftext|>", " '", "'s", "'ll", "  ", "͸", "😀", "é", "\x1c", "᠎", "​", "\U000105c0", "internationalisation"]
ODD = [None, "", " ", "\n\t ", "don't 'tis o'clock's", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "word " * 300_000, "x" * 40_000, "͸ neu", "'s", "a 's", "中文" * 9000]


def mixed(n, seed):
    pick = random.Random(seed)
    return ["".join(pick.choice(SIGNS) for _ in range(pick.randrange(40))) for _ in range(n)]


def library(texts):
    own = Tokenizer.from_file(PATH)
    return [len(own.encode(t or "", add_special_tokens=False).ids) for t in texts]


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 7, 7) for i, t in enumerate(texts)], SCHEMA)


def test_counts_equal_the_library_on_mixed_signs(spark):
    texts = mixed(6000, 3) + ["the frequent words and " * 9] * 50
    got = {r.doc_id: r for r in token_counts.token_counts(rows(spark, texts), PATH).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == library(texts)
    assert [got[i].n_bytes for i in range(len(texts))] == [len(t.encode()) for t in texts]


def test_odd_rows(spark):
    df = rows(spark, ODD)
    got = token_counts.token_counts(df.unionByName(spark.createDataFrame([(None, "word", None, None, None), (4, ODD[4], None, None, None)], SCHEMA)), PATH)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    own = sorted(map(tuple, got.collect()), key=str)
    want = [(i, len((t or "").encode()), n, n > 512) for i, (t, n) in enumerate(zip(ODD, library(ODD), strict=True))]
    assert own == sorted([*want, (None, 4, 1, False), want[4]], key=str)
    assert token_counts.token_counts(df.limit(0), PATH).count() == 0


def test_bytes_that_are_not_text_do_not_fail(spark):
    df = spark.sql("SELECT 1L AS doc_id, CAST(X'6162ff20c3' AS STRING) AS text UNION ALL SELECT 2L, 'ab'")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(df, PATH).collect()}
    assert got == {1: (5, library(["ab� �"])[0]), 2: (2, 1)}


@pytest.mark.parametrize("share", [2e-5, 0.01])
def test_the_table_holds_the_frequent_and_alters_no_count(spark, share):
    texts = [f" common word{i % 7} rare{i}" for i in range(400)]
    df = rows(spark, texts)
    table = token_counts.frequent(df.select("text"), PATH, share=share)
    data = np.frombuffer(b" common rare", np.uint8)
    found = table.find(*pretokens.keys(data, np.array([0, 7]), np.array([7, 12])))
    assert found.tolist() == library([" common", " rare"])
    small = token_counts.token_counts(df, PATH, table=table).orderBy("doc_id").collect()
    none = pretokens.KeyTable(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    assert small == token_counts.token_counts(df, PATH, table=none).orderBy("doc_id").collect()


def test_key_table_finds_every_key_and_no_other():
    rng = np.random.default_rng(0)
    raw = rng.integers(97, 101, 60_000).astype(np.uint8)
    s = np.arange(0, 59_000, 3)
    e = s + rng.integers(1, 16, len(s))
    lo, hi = pretokens.keys(raw, s, e)
    words = {raw[a:b].tobytes() for a, b in zip(s.tolist(), e.tolist(), strict=True)}
    assert {pretokens.spelled(a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)} == words
    _, first = np.unique(np.stack([lo, hi]), axis=1, return_index=True)
    half = first[::2]
    table = pretokens.KeyTable(lo[half], hi[half], np.arange(len(half)))
    want = {(a, b): k for k, (a, b) in enumerate(zip(lo[half].tolist(), hi[half].tolist(), strict=True))}
    assert table.find(lo, hi).tolist() == [want.get(k, -1) for k in zip(lo.tolist(), hi.tolist(), strict=True)]


def test_long_texts_are_cut_between_pretokens():
    text = ("it's  a test,\n of  cutting 中 文 ' x " * 400).encode()
    parts = list(pretokens.cut_long(text, 100))
    assert b"".join(parts) == text and len(parts) > 50
    counts = [len(x.ids) for x in Tokenizer.from_file(PATH).encode_batch([p.decode() for p in parts])]
    assert sum(counts) == library([text.decode()])[0]
    assert textkit.BLOCK_BYTES >= 1 << 20
