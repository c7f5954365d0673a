import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from kilonova.llm import bpe, queries

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = ["a", "e", "th", " ", "  ", "\n", "1", "é", "😀", "中", "'s", "'", "!!", "\t", "ß", "aaaa", "the", "ing", " the",
            " ", "́", "²", "AKIA", "=", "\r\n", "\x00", "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@pytest.mark.parametrize("leaf", [bpe.LEAF, 29])
def test_random_texts(library, leaf, monkeypatch):
    monkeypatch.setattr(bpe, "LEAF", leaf)
    mine, rnd = bpe.Bpe(bpe.read_ranks(PATH), P.PATTERN), random.Random(leaf)
    for _ in range(1500):
        t = "".join(rnd.choice(ALPHABET[:rnd.randint(2, len(ALPHABET))]) for _ in range(rnd.randint(0, 300)))
        ids = mine.encode(t)
        assert ids == library.encode_ordinary(t)
        assert mine.decode(ids) == t.encode()


def test_very_long_texts(library):
    mine = bpe.Bpe(bpe.read_ranks(PATH), P.PATTERN)
    for t in ("a" * 30_000, "ab" * 40_000, " " * 90_000, "Straße 12, " * 20_000, "=-" * 20_000 + "x\n" * 20_000):
        assert mine.encode(t) == library.encode_ordinary(t)


def test_query_equals_library(spark, library):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.queries()["op9_byte_bpe"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d.text)
        r = got[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()


def test_rows(spark):
    cols = "doc_id long, text string, ids string, n_tokens int, row string"
    rows = [(1, "the thing", "x", 1, "r")] * 2 + [(None, None, None, None, None), (3, "", "y", 2, "s")]
    enc = bpe.encode_texts(spark.createDataFrame(rows, cols), PATH, P.PATTERN)
    back = bpe.decode_ids(enc.select("row.doc_id", "ids", "n_tokens"), PATH, P.PATTERN).collect()
    assert sorted((r.row.doc_id or 0, bytes(r.decoded).decode(), r.row.n_tokens > 0) for r in back) == [
        (0, "", False), (1, "the thing", True), (1, "the thing", True), (3, "", False)]
    assert bpe.encode_texts(spark.createDataFrame([], cols), PATH, P.PATTERN).count() == 0
