"""The pipeline on a small corpus against plain versions of its stages."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from poolshift.llm import bpe, decontam, pii

from . import brute


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, make_docs, make_labels, make_items):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(5))
    items = [(n, " ".join(word() for _ in range(30))) for n in range(4)]
    docs, labels = [], []
    for i in range(240):
        words = [word() for _ in range(rnd.randint(12, 40))]
        if i % 4 == 0:
            words[3:3] = rnd.sample(["snarfle", "grumbolt", "veckless", "dimwort"], 3)
        if i % 10 == 3:
            words += items[i % 4][1].split()
        if i % 10 == 5:
            words.insert(4, "mail me@site.org or +1 (434) 555-2368")
        labels.append((i, 1, int(i % 4 == 0)))
        docs.append((i, " ".join(words)))
        if i % 10 == 7:
            docs.append((1000 + i, " ".join([*words, "end"])))
    docs += [(2000, None), (2001, ""), (2002, "x")]
    folder = str(tmp_path_factory.mktemp("corpus"))
    for name, df in (("documents", make_docs(docs).drop("score")), ("labels", make_labels(labels)), ("benchmark", make_items(items))):
        df.write.parquet(f"{folder}/{name}.parquet")
    return folder, docs, labels, items


def plain(docs, labels, items, accepted):
    """What is left after each stage; the toxic words are those planted."""
    toxic = {"snarfle", "grumbolt", "veckless", "dimwort"}
    kept = [(i, t) for i, t in docs if not toxic & set((t or "").split())]
    first = brute.near_duplicates(kept)
    kept = [(i, t) for i, t in kept if first[i][1] == i]
    seeds = [decontam.words_of(t) for _, t in items]
    kept = [(i, t) for i, t in kept if not any(brute.tiles(s, decontam.words_of(t), 3) / len(s) >= decontam.THRESHOLD for s in seeds)]
    return [(i, None if t is None else pii.redact(t, accepted)) for i, t in kept]


def test_run_matches_the_plain_stages(spark, corpus):
    folder, docs, labels, items = corpus
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in plain(docs, labels, items, {}):
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(got) == sorted(want)
    assert 0 < len(want) < len(docs)


def test_stages_keep_the_columns(spark, corpus):
    folder, *_ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(30)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_registered():
    import __spark_entry__ as E
    assert E.queries()["pipeline"] is corpus_pipeline.run
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in E.queries()}
