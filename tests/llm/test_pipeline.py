"""Every stage of the pipeline: against brute force on a small table, and on odd rows and columns."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P
from ledgerloom.llm import bpe, mixing

DDL = "doc_id long, text string, lang string, source string, n_chars long, size string, n_removed string, kept_text string, copies string, h string, cut int, whole int, inclusive string, score string, token_ids string, `a.b` int"
CLASH = ("big", "none", "old", "many", "hash", 1, 2, "yes", "high", "ids", 3)


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Texts with toxic words, copies, shared passages and odd rows, with labels beside them."""
    rng, rows, labels = np.random.default_rng(21), [], []
    words = [f"w{i}" for i in range(900)]
    some = lambda n: [str(x) for x in rng.choice(words, n)]
    passage = some(60)
    for i in range(240):
        w = some(int(rng.integers(20, 90)))
        if i % 6 == 0:
            w[3] = w[11] = "vile"
        if i % 20 == 1:
            w = [*w[:10], *passage, *w[10:]]
        rows.append((i, " ".join(w), "en", f"s{i % 4}"))
        if i < 200:
            labels.append((i, int(i % 6 == 0)))
    rows += [(300 + k, rows[k][1], "en", "s9") for k in (1, 2, 3)]  # exact copies
    near = rows[9][1].split()
    near[40 % len(near)] = "other"
    rows += [(310, " ".join([*rows[9][1].split() * 3, "x"]), "en", "s1"), (311, " ".join([*rows[9][1].split() * 3, "y"]), "en", "s1")]
    rows += [(320, None, None, None), (321, "", "en", None), (322, " \n ", "fr", "s1"), (323, "one", "fr", "s1"), (None, "no id stands here", "en", "s2"), (324, "a" * 30_000, "en", "s2"), (325, "b c " * 9_000, "en", "s2")]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *CLASH) for r in rows], DDL).repartition(3)
    return docs, folder


def test_toxic_go_and_clean_stay(spark, corpus):
    docs, folder = corpus
    got = P.reject_toxic(spark, docs, folder)
    assert got.schema == docs.schema
    want = [r for r in docs.collect() if not (r.text and "vile" in r.text.split())]
    assert rows_of(got) == sorted(repr(tuple(r)) for r in want)


def sets(text, n=5):
    w = [x.lower() for x in (text or "").split()]
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def test_one_of_each_group_stays(spark, corpus):
    docs, folder = corpus
    rows = docs.collect()
    ids = [r.doc_id for r in rows if r.doc_id is not None]
    s, root = {r.doc_id: sets(r.text) for r in rows}, {i: i for i in ids}
    find = lambda i: i if root[i] == i else find(root[i])
    for a in ids:
        for b in ids:
            n = len(s[a] & s[b])
            if a < b and n and 100 * n >= 80 * len(s[a] | s[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    got = P.drop_near_copies(spark, docs, folder)
    assert got.schema == docs.schema
    assert rows_of(got) == sorted(repr(tuple(r)) for r in rows if r.doc_id is None or find(r.doc_id) == r.doc_id)
    assert {300, 301, 302, 311}.isdisjoint(r.doc_id for r in got.select("doc_id").collect())


def test_passages_are_cut(spark, corpus):
    docs, folder = corpus
    rows = docs.collect()
    words = [(r.text or "").split() for r in rows]
    seen = Counter(tuple(w[k : k + 50]) for w in words for k in range(len(w) - 49))
    want = []
    for r, w in zip(rows, words):
        gone = {j for k in range(len(w) - 49) if seen[tuple(w[k : k + 50])] > 1 for j in range(k, k + 50)}
        if not gone:
            want.append(repr(tuple(r)))
        elif len(gone) < len(w):
            text = " ".join(x for j, x in enumerate(w) if j not in gone)
            want.append(repr(tuple((r.asDict() | {"text": text, "n_chars": len(text)})[c] for c in docs.columns)))
    got = P.cut_passages(spark, docs, folder)
    assert got.schema.simpleString() == docs.schema.simpleString() and rows_of(got) == sorted(want)
    less = docs.drop("n_chars")
    assert P.cut_passages(spark, less, folder).columns == less.columns


def test_mix_repeats_rows(spark, corpus):
    docs, folder = corpus
    got = P.mix_sources(spark, docs, folder)
    assert got.schema.simpleString() == docs.schema.simpleString()
    copies = {(r.doc_id, r.text): r.copies for r in mixing.mix(docs.select("doc_id", "text", "source")).collect()}
    want = [repr(tuple(r)) for r in docs.collect() for _ in range(copies[r.doc_id, r.text])]
    assert rows_of(got) == sorted(want) and set(copies.values()) <= {0, 1, 2}
    assert set(mixing.mix(docs).columns) >= {"h", "cut", "whole", "inclusive"}


def test_encoding(spark, corpus):
    docs, folder = corpus
    lib = bpe.codec().lib
    for r in P.encode(spark, docs, folder).collect():
        assert r.exact and r.n_tokens == len(r.token_ids)
    ids = {r.doc_id: r.token_ids for r in P.encode(spark, docs, folder).collect()}
    assert all(ids[r.doc_id] == lib.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect())


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_empty_and_repeated_rows(spark, corpus, name, stage):
    docs, folder = corpus
    empty = stage(spark, docs.limit(0), folder)
    assert empty.count() == 0
    twice = stage(spark, docs.union(docs), folder)
    if name == "near copies":  # of rows of one id one stays, rows without id all do
        assert twice.filter("doc_id is not null").count() == twice.filter("doc_id is not null").select("doc_id").distinct().count()
    elif name == "repeated passages":  # texts of 50 words or more are copies of each other
        assert all(len((r.text or "").split()) < 50 for r in twice.collect())
    else:
        assert twice.count() % 2 == 0
