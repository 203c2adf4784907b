"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from ledgerloom.llm import bpe, chroma, ctw, langid, minhash, mixing, rules, substrings, token_files, toxicity
from ledgerloom.llm.common import scratch

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ROWS = [(1, None, None, "s1"), (2, "", "en", None), (3, "one two three four five six seven", "en", "s1"), (3, "one two three four five six seven", "en", "s1"), (4, LONG, None, "s2"), (5, "\n\t  ", "fr", "s2"), (6, "a" * 5000, "fr", ""), (None, "no id here at all", "en", "s1")]
DDL = "doc_id long, text string, lang string, source string, size int, h string, score string, kept int, n string, r string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 7, "x", "y", 1, "n", "r") for r in ROWS], DDL).repartition(3)


def test_mixing(spark, docs):
    got = mixing.mix(docs).collect()
    assert len(got) == 8 and all(r.taken <= 2 * r["size"] for r in got) and [r.taken for r in got if r.doc_id == 1] == [0]
    assert mixing.mix(docs.limit(0)).count() == 0
    assert sum(r.target for r in {x.source: x for x in got}.values()) == pytest.approx(1.5 * sum(r["size"] for r in got))


def test_mixing_meets_targets(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 13), f"s{i % 5}") for i in range(3000)], "doc_id long, text string, source string")
    by = {}
    for r in mixing.mix(df).collect():
        t = by.setdefault(r.source, [r.target, 0])
        t[1] += r.taken
    assert len(by) == 5 and all(abs(t - n) <= 13 for t, n in by.values())


def test_rules(spark, docs):
    book = rules.ledger(docs.withColumns({"__w": F.lit(5), "__score": F.lit("x")}))
    got = {(r.doc_id, r.n_words): r for r in rules.judged(book).collect()}
    assert got[1, 0].base_failed and not got[1, 0].kept and got[4, 30_000].n_words == 30_000 and {(r["__w"], r["__score"]) for r in got.values()} == {(5, "x")}
    assert "text" not in book.columns and {v: rules.judged(book, p).filter("kept").count() for v, p in rules.POLICIES.items()} == {"v1": 0, "v0": 0, "strict": 0}
    assert {r.rule: r.n_fail for r in rules.ablations(book).collect() if r.policy == "v1"}["too_few_words"] == 7
    assert rules.judged(rules.ledger(docs.limit(0))).count() == 0


def test_bpe_is_the_library(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    got = {r.doc_id: r for r in bpe.round_trip(docs).collect()}
    for i, text, *_ in ROWS:
        assert got[i].token_ids == t.encode(text or "", add_special_tokens=False).ids and got[i].exact
    assert bpe.digests(docs.limit(0)).count() == 0
    c, rng = bpe.codec(), np.random.default_rng(5)
    parts = ["a", "'s", "'", "\n", " ", "  ", "é", "1", "!", "<|endoftext|>", "漢", "\x1c", " ", "don't"]
    for _ in range(3000):
        s = "".join(rng.choice(parts, rng.integers(0, 12)))
        assert np.frombuffer(c.encode(s), np.uint32).tolist() == t.encode(s, add_special_tokens=False).ids, repr(s)
    for s in ("a" * 7000, "abcab" * 2500, "漢" * 4000, "".join(rng.choice(list("theinonater"), 20_000))):
        c.joins = 0
        assert np.frombuffer(c.encode(s), np.uint32).tolist() == t.encode(s, add_special_tokens=False).ids and c.joins > 0


def test_token_files(spark, docs):
    m = token_files.write(docs, scratch(spark, "t"))
    got = sorted(token_files.read(m).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 3, 4, 5, 6]
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:]))
    c = bpe.codec()
    assert got[5].ids_crc32 == zlib.crc32(c.encode(LONG) + b"\0\0\0\0") and got[1].n_tokens == 1
    path = [r.path for r in m.collect()][0]
    reader = token_files.Reader(path)
    assert reader.doc(reader.ids[-1]).tolist()[-1] == 0
    data = bytearray(open(path.removeprefix("file://"), "rb").read())
    data[5] ^= 255
    open(path.removeprefix("file://") + ".bad", "wb").write(bytes(data))
    with pytest.raises(Exception):
        list(token_files.Reader(path + ".bad").docs())
    assert token_files.read(token_files.write(docs.limit(0), scratch(spark, "t"))).count() == 0


def test_substrings(spark, docs):
    got = {r.doc_id: r for r in substrings.dedup(docs, window=5, first=2).collect()}
    assert (got[3].n_removed, got[3].kept_text) == (7, "") and got[1].n_words == 0 and got[6].kept_text == "a" * 5000
    assert substrings.dedup(docs.limit(0)).count() == 0
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(list("abc"), rng.integers(0, 30)))) for i in range(40)]
    words = {i: t.split() for i, t in rows}
    for w, first in ((7, 2), (4, 9)):
        seen = Counter(tuple(x[k : k + w]) for x in words.values() for k in range(len(x) - w + 1))
        found = {r.doc_id: r.kept_text for r in substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string"), window=w, first=first).collect()}
        for i, x in words.items():
            gone = {j for k in range(len(x) - w + 1) if seen[tuple(x[k : k + w])] > 1 for j in range(k, k + w)}
            assert found[i] == " ".join(y for j, y in enumerate(x) if j not in gone)


def test_minhash(spark, docs):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()]
    assert (1, 0, 1, True) in got and got.count((3, 3, 3, True)) == 2 and (6, 1, 6, True) in got
    assert minhash.keep_one(docs).filter("doc_id = 3").count() == 1 and minhash.keep_one(docs).count() == 7
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 5000, 200)]
    rows = [(i, " ".join(f"x{rng.integers(9999)}" if rng.random() < 0.004 * (i % 9) else w for w in base)) for i in range(60)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(196)} for i, t in rows}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if root[a] != root[b] and 100 * n >= 80 * len(sets[a] | sets[b]):
                    low, high = sorted((root[a], root[b]))
                    root, changed = {k: low if v == high else v for k, v in root.items()}, True
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == root


def test_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(9)] + [(20, 30), (30, 25)], "u long, v long")
    assert sorted(tuple(r) for r in minhash.components(edges).collect()) == [(i, 0) for i in range(1, 10)] + [(25, 20), (30, 20)]


def test_toxicity(spark, docs):
    rows = [(i, " ".join([f"w{(i * 7 + k) % 50}" for k in range(30)] + (["vile"] if i % 4 == 0 else []))) for i in range(400)]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.train(df, lab)
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert all((got[i] >= 0.3) == (i % 4 == 0) for i in range(300, 400))
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, model).collect())
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs.limit(0), lab)).collect()} == {0.5}


def test_langid(spark, docs):
    m = langid.train(spark.createDataFrame([("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "de"), ("x", None)], "text string, lang string"))
    assert m.langs == ["en", "fr"]
    got = {r.doc_id: r for r in langid.identify(docs, m).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[5].lang_pred == "und" and got[3].lang_pred in ("en", "fr")
    both = spark.createDataFrame([("the cat and the dog " * 9 + "le chat et le chien " * 9,)], "text string")
    assert {x.lang for x in langid.identify(both, m).first().languages} == {"en", "fr"}
    assert langid.identify(docs, langid.Model([], [])).filter("lang_pred <> 'und'").count() == 0


def test_context_tree(spark, docs):
    m = ctw.train(docs)
    got = {r.doc_id: r for r in ctw.score(docs, m).collect()}
    assert got[1].n_tokens == 1 and got[1].score == got[2].score < 0 and got[3].score < got[1].score
    none = ctw.score(docs.limit(2), ctw.train(docs.limit(0))).collect()
    assert all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in none)
    one = spark.createDataFrame([(b, chr(b)) for b in range(33, 127) if not 65 <= b <= 90], "doc_id int, text string")
    assert 0 < sum(10**r.score for r in ctw.score(one, m).collect()) < 1
    x = np.array([0.5, 1, 3.7, 100.0])
    assert np.allclose(ctw.lgamma(x), [__import__("math").lgamma(v) for v in x])


def test_chroma(spark):
    words = [b"w%d" % i for i in np.random.default_rng(0).integers(0, 400, 200)]
    a, b = (chroma.fingerprint(chroma.chroma(*chroma.melody(b" ".join(w)))) for w in (words, words[30:]))
    r, offset, votes, overlap, error = (x.tolist() for x in chroma.search(a, chroma.Chunk([b], len(a))))
    assert (r, offset) == ([0], [-30 * chroma.NOTE]) and votes[0] > 100 and error[0] < 0.05
    text = b" ".join(words).decode()
    df = spark.createDataFrame([(0, text), (1, text), (2, " ".join(text.split()[30:])), (3, None), (4, "short")], "id long, text string")
    rows = chroma.align(chroma.fingerprints(df, "id", "text", chroma.melody), F.col("id") == 0).collect()
    assert {(r.query_id, r.match_id) for r in rows if r.kind == "member"} == {(0, 0), (1, 0), (2, 2), (3, None), (4, None)}
    assert [(r.query_id, r.match_id, r.offset) for r in rows if r.kind == "match"] == [(0, 2, -30 * chroma.NOTE)]
    assert chroma.decode_wav(b"nothing")[0].size == 0


def test_large_groups_meet_their_pivot(spark, monkeypatch):
    """Groups of many blocks: what is near the pivot, what is near only to that, and what is near to neither."""
    monkeypatch.setattr(minhash, "BLOCK", 6)
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in rng.integers(0, 5000, 200)]
    rows = [(i, " ".join(f"x{rng.integers(9999)}" if rng.random() < 0.004 * (i % 13) else w for w in base)) for i in range(120)]
    rows += [(200 + i, t.replace("w1", "v1")) for i, t in rows[:40]]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(196)} for i, t in rows}
    root = {i: i for i in sets}
    find = lambda i: i if root[i] == i else find(root[i])
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: find(i) for i in sets}


def test_pivot_is_the_middle_of_a_group(spark, monkeypatch):
    """Texts near one of them, and none near another: they meet that one, and none is left to meet all the rest."""
    monkeypatch.setattr(minhash, "BLOCK", 40)
    rng, staged, rows = np.random.default_rng(8), minhash.staged, {}

    def counted(df, name):
        out = staged(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(minhash, "staged", counted)
    base = [f"w{i}" for i in rng.permutation(5000)[:200]]
    texts = []
    for i in range(400):
        at = set((rng.permutation(19)[:4] * 10 + 5).tolist()) if i else set()
        texts.append((1000 - i, " ".join(f"x{i}y{k}" if k in at else w for k, w in enumerate(base))))
    got = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {601}
    assert rows["minhash-rest"] <= 40


def test_ablations(spark):
    """n_only against dropping the rule and judging again."""
    docs = spark.createDataFrame([(1, "a b c"), (2, "# # # # # # # # # # # # a"), (3, "x" * 1200), (4, "one two three four five six seven eight nine ten"), (5, "1 2 3 4 5 6 7 8 9 0 1 2"), (6, "a b c d e f g h i j k l m")], "doc_id long, text string")
    book = rules.ledger(docs).cache()
    got = {(r.policy, r.rule): (r.n_fail, r.n_only) for r in rules.ablations(book).collect()}
    for version, p in rules.POLICIES.items():
        kept = {r.doc_id for r in book.filter(p.keeps()).collect()}
        for i, rule in enumerate(rules.RULES):
            less = rules.Policy(version, p.fatal & ~(1 << i), p.counted & ~(1 << i), p.allowed)
            assert got[version, rule.name] == (book.filter(rule.fails).count(), len({r.doc_id for r in book.filter(less.keeps()).collect()} - kept))
    assert any(n for _, n in got.values())


def test_shared_folder(spark):
    """Only where all runs in one process may a machine-local folder stand in for the shared one."""
    from types import SimpleNamespace

    from ledgerloom.session import shared_dir

    conf = SimpleNamespace(get=lambda *_: None)
    fake = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="local-cluster[2,1,1024]"), conf=conf)
    with pytest.raises(ValueError):
        shared_dir(fake)


@pytest.mark.parametrize("share", [0.3, 1.5, 1.9, 2.5])
def test_water_filling(spark, share):
    """Targets against filling turn by turn, over many sources, some of size 0 and one null."""
    rng = np.random.default_rng(int(share * 10))
    size = {f"s{i:03}": int(n) for i, n in enumerate(rng.integers(0, 400, 120) ** 2 // 50)} | {None: 700}
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(size.items()), "source string, size long").repartition(4), share=share).collect()}
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, open_, left = {}, set(size), share * sum(size.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not full:
            want |= {s: level * weight[s] for s in open_}
            break
        want |= {s: 2.0 * size[s] for s in full}
        left -= sum(2 * size[s] for s in full)
        open_ -= full
    assert got == pytest.approx(want)
