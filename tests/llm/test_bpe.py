import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from poolshift.llm import bpe


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [None, "", " ", "\n\n  x  \n", "The theandreing inghat, it's WE'LL don't I'd", "a" * 700 + " b c", "é" * 200 + "日本語テキスト 123４５ ½ z\u0085y",
         "!" * 900 + "abcdefghijk" * 120, "𝔘𝔫𝔦 👩‍👩‍👧 \x00\x1f ​ x　y z", "<|endoftext|> is ordinary", "tab\tand\r\nnewline   ", "0123456789" * 30]


def test_round_trip_equals_the_library(make_docs, ranks, reference, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 40)
    monkeypatch.setattr(bpe, "COUNT_BLOCK", 40)
    rnd = random.Random(2)
    rows = list(enumerate(TEXTS)) + [(100 + i, " ".join(rnd.choice(TEXTS[4].split()) + rnd.choice(["", "qz", "é"]) for _ in range(30))) for i in range(20)]
    rows += [(5, TEXTS[5]), (None, "no id")]
    got = bpe.round_trip(make_docs(rows), ranks).collect()
    want = []
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_encode_then_decode(make_docs, ranks, reference):
    rows = list(enumerate(TEXTS))
    encoded = bpe.encode_documents(make_docs(rows), ranks)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == {i: reference.encode_ordinary(t or "") for i, t in rows}
    assert {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode_documents(encoded, ranks).collect()} == {i: (t or "").encode() for i, t in rows}


def test_long_words_take_the_same_merges(ranks, reference):
    rnd = random.Random(4)
    for _ in range(40):
        word = "".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 300)))
        assert bpe.merge_long(word.encode(), ranks) == reference.encode_ordinary(word)


def test_empty_table(make_docs, ranks):
    assert bpe.round_trip(make_docs([]), ranks).collect() == []


def test_pattern_is_the_tokenizers():
    assert bpe.PATTERN == public_tokenizers.PATTERN


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(bpe, "hash_words", lambda words: np.array([len(w) for w in words.to_pylist()], np.uint64))
    shared, hashes, lists = bpe._by_hash(pa.array(["abc", "de", "xyz"]), pa.array([[1], [2, 3], [4]], pa.list_(pa.int32())))
    asked = pa.array(["de", "xyz", "abc", "no", "longer"])
    at, own = bpe._places(asked, shared, hashes)
    assert own.tolist()[3:] == [True, True] and not own[0] and 1 <= own[1:3].sum() <= 1
    assert all(shared[int(i)] == w for i, o, w in zip(at, own, asked, strict=True) if not o)
    assert dict(zip(shared.to_pylist(), lists.to_pylist(), strict=True)) == {"abc": [1], "de": [2, 3], "xyz": [4]}
    assert bpe._places(asked, pa.array([], pa.string()), np.empty(0, np.uint64))[1].all()


def test_fold_finds_no_places_by_exceptions(spark, ranks, reference):
    """array_position ends each search by an exception: most of the fold's time was spent on them."""
    words = ["thereinghat", "aaaaaaaab", " étéçà", "zzqzzqzz", "a", "0123456789" * 6]
    folded = spark.createDataFrame([(words,)], "words array<string>").select(bpe._folded(F.col("words"), bpe.rank_map(ranks)).alias("ids"))
    assert "array_position" not in folded._jdf.queryExecution().analyzed().toString()
    assert folded.collect()[0]["ids"] == [reference.encode_ordinary(w) for w in words]
