"""Context-tree weighting against a recursive form of it, and the base score against a count in plain Python."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from ledgerloom.llm import ctw

SF = "/root/testdata/sf0.001"
D = ctw.DEPTH


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def steps(text: str):
    """Context, bits decided so far and next bit, for every bit of a text."""
    before = ctw.END * D
    for x in b" ".join(words_of(text)) + ctw.END:
        for k in range(8):
            yield before, (1 << k) | (x >> (8 - k)), (x >> (7 - k)) & 1
        before = (before + bytes([x]))[-D:]


def direct(train: list[str], texts: list[str]) -> list[float]:
    count, kids, memo = {}, {}, {}
    for t in train:
        for before, prefix, bit in steps(t):
            for d in range(D + 1):
                count.setdefault((before[D - d :], prefix), [0, 0])[bit] += 1
    for before, prefix in count:
        if before:
            kids.setdefault((before[1:], prefix), []).append((before, prefix))

    def node(n):
        """Logarithm of the weighted probability, and the weight of stopping."""
        if n not in memo:
            a, b = count[n]
            own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
            if len(n[0]) == D:
                memo[n] = own, 1.0
            else:
                below = sum(node(k)[0] for k in kids.get(n, []))
                top = max(own, below)
                memo[n] = top + math.log(math.exp(own - top) + math.exp(below - top)) - math.log(2), 1 / (1 + math.exp(min(700, below - own)))
        return memo[n]

    out = []
    for t in texts:
        total = 0.0
        for before, prefix, bit in steps(t):
            left, one = 1.0, 0.0
            for d in range(D + 1):
                n = before[D - d :], prefix
                if n not in count:
                    break
                (a, b), stop = count[n], node(n)[1]
                one += left * stop * (b + 0.5) / (a + b + 1)
                left *= 1 - stop
            one += left / 2
            total += math.log10(one if bit else 1 - one)
        out.append(total)
    return out


TRAIN = ["the cat sat on the mat", "the dog sat on the log and the cat", "ünïcode wörds hère", "a b c a b c a b d", "", "The END of it"]
def test_normal_form():
    texts = ["", " \n ", "  The  CAT\tsat \n", "a", "\x0bÄ é\x0c", "x" * 300 + "  y "]
    flat, first = ctw.normal([t.encode() for t in texts])
    assert [bytes(x) for x in np.split(flat, first[1:])] == [b" ".join(words_of(t)) + ctw.END for t in texts]
    token, at = ctw.tokens_of(flat, first)
    words = [w for t in texts for w in [*words_of(t), ctw.END]]
    assert len(token) == len(words) and len(set(zip(token.tolist(), words))) == len(set(words)) == len(set(token.tolist()))
    assert np.diff(at, append=len(token)).tolist() == [len(words_of(t)) + 1 for t in texts]


TEXTS = [*TRAIN[:2], "the cat and the frog", "zzz", "", "wörds of it", "the  CAT\n sat"]


@pytest.mark.parametrize("sizes", [None, (3, 7, 40)])
def test_against_the_recursive_form(spark, monkeypatch, sizes):
    """With production sizes, and with blocks and batches so small that every text needs many."""
    if sizes:
        monkeypatch.setattr(ctw, "BLOCK", sizes[0] * 10)
        monkeypatch.setattr(ctw, "BATCH", sizes[1])
        monkeypatch.setattr(ctw, "WINDOW", sizes[2])
        monkeypatch.setattr(ctw, "HELD", 20)
    model = ctw.train(spark.createDataFrame([(x,) for x in TRAIN], "text string"))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").coalesce(1)
    got = [r.score for r in ctw.score(docs, model).orderBy("doc_id").collect()]
    assert got == pytest.approx(direct(TRAIN, TEXTS), rel=1e-8)


def test_query(spark):
    d = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in d["doc_id"]}
    words = {i: [*words_of(t), ctw.END] for i, t in zip(d["doc_id"], d["text"])}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    got = ctw.op4(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(words)
    for r in got:
        ws = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
    assert sum(r.score for r in got if not r.held_out) > sum(r.base_score for r in got if not r.held_out)
