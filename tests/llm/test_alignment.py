"""Alignment of two tokenizers against whole texts taken byte by byte."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from pedon.llm import alignment

A, B = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, n_a string, row int, id int, pair int"
SIGNS = [*"aAbstdmlvre'’ 1٣ \n\t é中ßñ!?.,<|>\r▁", "<|endoftext|>", "<s>", "<0x41>", " '", "'s", "  ", "\n\n", " \n", ";\r\n", "😀", "\x1c", "​", "the", " and", " ization"]
ODD = [None, "", " ", "  ", "\n", "\n\t ", "a▁b", "x" * 9000, "中文" * 3000, "a b" * 5, "😀é" * 50, "<|endoftext|> <s> </s> <unk>", "word, and words.\nNext " * 60_000, " lead", "trail ", "trail  "]


def whole(texts):
    """The contract's columns, from tokens of whole texts and sets of byte offsets."""
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    bytes_a, bytes_b = alignment._a_bytes(a), alignment._b_bytes(b)
    rows, docs = [], Counter()
    for text in texts:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw = (" " + text).encode() if text else b""
        if b"".join(bytes_a[i] for i in ids_a) != raw or b"".join(bytes_b[i] for i in ids_b) != raw:
            ids_a = ids_b = []
        groups, ends = [], []
        for ids, size in ((ids_a, bytes_a), (ids_b, bytes_b)):
            at, own = 0, []
            for i in ids:
                at += len(size[i])
                own.append((at, i))
            ends.append(own)
        cuts = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
        k = [0, 0]
        for c in cuts:
            sides = []
            for s in (0, 1):
                i = k[s]
                while k[s] < len(ends[s]) and ends[s][k[s]][0] <= c:
                    k[s] += 1
                sides.append([x for _, x in ends[s][i : k[s]]])
            groups.append(sides)
        links = Counter((x, y) for p, q in groups for x in p for y in q)
        docs.update(links.keys())
        shown = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        rows.append((len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(shown.encode()).hexdigest() if ids_a else ""))
    best = defaultdict(int)
    for (x, _), n in docs.items():
        best[x] = max(best[x], n)
    return [(na, nb, ng, links.total(), sum(n for (x, y), n in links.items() if docs[x, y] == best[x]), sum(n * docs[p] for p, n in links.items()), sha) for na, nb, ng, links, sha in rows]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 7, 7, 7) for i, t in enumerate(texts)], SCHEMA)


def mixed(n, seed):
    pick = random.Random(seed)
    return ["".join(pick.choice(SIGNS) for _ in range(pick.randrange(30))) for _ in range(n)]


@pytest.mark.parametrize("frequent", [1e-6, 0.002, 1.0])
def test_equals_whole_texts(spark, frequent):
    texts = mixed(1500, 5)
    got = alignment.alignment(table(spark, texts), A, B, frequent=frequent).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == whole(texts) and [r.doc_id for r in got] == list(range(len(texts)))


def test_odd_rows(spark):
    df = table(spark, ODD).unionByName(spark.createDataFrame([(None, "lost words", None, None, None, None), (9, ODD[9], None, None, None, None)], SCHEMA))
    got = alignment.alignment(df, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    own = sorted(map(tuple, got.collect()), key=str)
    texts = [*ODD, "lost words", ODD[9]]
    assert own == sorted(zip([*range(len(ODD)), None, 9], *zip(*whole(texts), strict=True), strict=True), key=str)
    assert alignment.alignment(df.limit(0), A, B).count() == 0


def test_stretches_make_up_the_text():
    own = alignment.Aligner(A, B)
    assert own.cuts
    for t in mixed(3000, 6):
        assert "".join(own.stretches(" " + t)) == " " + t


def test_groups_are_what_is_digested(spark):
    df = table(spark, ["Some words", "😀"])
    for r in alignment.aligned(df, A, B, with_groups=True).collect():
        assert hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256
        assert r.groups.count(";") + 1 == r.n_groups


def test_links_are_expanded_in_blocks(monkeypatch):
    texts = [" " + t for t in mixed(200, 8)]
    whole_blocks, _ = alignment.Aligner(A, B).rows(texts)
    monkeypatch.setattr(alignment, "LINKS", 3)
    small, _ = alignment.Aligner(A, B).rows(texts)
    assert all((x == y).all() for x, y in zip(whole_blocks[2:], small[2:], strict=True))
