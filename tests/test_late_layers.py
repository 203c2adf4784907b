"""The similar and interval layers against plain loops over all pairs, and how many candidates they make."""

import random
from difflib import SequenceMatcher

import pytest

from ledgerloom.functions.similarity import code_ratio_of, ratios, score_tokens
from ledgerloom.operators import alike, graph, matching
from ledgerloom.session import staged

from .test_matching_layers import plain_turns
from .test_operators import items


class Counted:
    """staged(), and how many rows each name has had."""

    def __init__(self):
        self.rows = {}

    def __call__(self, df, name):
        out = staged(df, name)
        self.rows[name] = self.rows.get(name, 0) + out.count()
        return out


def sides(spark, seed, n, digits="012", quantities=(1.0, 100.0, 100.5, 102.0)):
    rng = random.Random(seed)
    words = ["tub", "cot", "PVC 2,5", "otel", "zid"]
    row = lambda: (rng.choice("12"), "PK" + "".join(rng.choice(digits) for _ in range(rng.choice([4, 5, 5, 20]))), " ".join(rng.sample(words, rng.randint(0, 3))), rng.choice(["m", "mp"]), rng.choice(quantities))
    return (matching.prepare(items(spark, [row() for _ in range(n)]), k) for k in (True, False))


def by_section(ref, offer, candidate):
    out = []
    for s in sorted({r["section"] for r in ref}):
        out += plain_turns([(a["seq"], b["seq"], *c) for a in ref for b in offer if a["section"] == b["section"] == s for c in candidate(a, b)])
    return sorted((r, o, round(x, 9)) for r, o, x in out)


def rows_of(df):
    return [r.asDict() for r in df.withColumn("t", score_tokens("denumire")).collect()]


def score(a, b):
    x, y = set(a["t"]), set(b["t"])
    return max(len(x & y) / len(x | y), len(x & y) / len(x)) if x and y else 0.0


def got_of(pairs):
    return sorted((r.ref_seq, r.of_seq, round(r.score, 9)) for r in pairs.collect())


@pytest.mark.parametrize("most", [10**9, 60, 0])
def test_similar_pairs_are_the_plain_ones(spark, monkeypatch, most):
    """Codes of few rests and long ones; in one partition, by section and by component."""
    monkeypatch.setattr(graph, "ONE_PARTITION", most)
    ref, offer = sides(spark, 5, 90)

    def candidate(a, b):
        cr = code_ratio_of(a["code"], b["code"])
        return [(0.6 * cr + 0.4 * score(a, b), score(a, b) >= 0.4)] if cr >= 0.8 else []

    want = by_section(rows_of(ref), rows_of(offer), candidate)
    assert len(want) > 20 and got_of(matching.similar_pairs(ref, offer)) == want


@pytest.mark.parametrize("most", [10**9, 60, 0])
def test_interval_pairs_are_the_plain_ones(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "ONE_PARTITION", most)
    ref, offer = sides(spark, 6, 150, "0123456789")

    def candidate(a, b):
        near = abs(a["qty"] - b["qty"]) <= 0.01 * max(a["qty"], b["qty"]) + 0.01
        return [(score(a, b), True)] if a["unit"] == b["unit"] and near and score(a, b) >= 0.4 else []

    want = by_section(rows_of(ref), rows_of(offer), candidate)
    assert len(want) > 50 and got_of(matching.interval_pairs(ref, offer)) == want


def test_rows_alike_make_one_candidate(spark):
    side = lambda code: matching.prepare(items(spark, [("1", f"{code}{i:04d}", "tub", "m", 5.0) for i in range(300)]), False)
    count = Counted()
    pairs = matching.interval_pairs(side("A"), side("B"), persist=count).collect()
    assert len(pairs) == 300 and all(r.ref_seq == r.of_seq for r in pairs)
    assert count.rows["interval-candidates"] == 1  # not 300 * 300


def test_codes_that_begin_alike_make_few_candidates(spark):
    """7 signs of which 6 must match in order: only codes with an equal rest meet, and of those only the ones that can be taken are kept."""
    rng = random.Random(3)
    some = [f"PK{k:05d}" for k in rng.sample(range(100_000), 1200)]
    words = ["tub", "cot", "otel", "zid", "var", "lac"]
    a, b = (matching.prepare(items(spark, [("1", c, rng.choice(words), "m", 1.0) for c in side]), False) for side in (some[::2], some[1::2]))
    near = {(x, y) for x in some[::2] for y in some[1::2] if SequenceMatcher(None, x, y).ratio() >= 0.8}
    met = {(r.r_code, r.o_code) for r in alike.code_candidates(a, b, 0.8).collect()}
    assert near <= met and len(met) < 1.5 * len(near) + 50
    count = Counted()
    matching.similar_pairs(a, b, persist=count).count()
    assert count.rows["similar-candidates"] < len(near) / 2  # those of other descriptions are never taken


def test_ratios_by_pattern():
    rng = random.Random(1)
    for n in (1, 5, 12, 40):
        a, b = (["".join(rng.choice("AB01") for _ in range(rng.randint(0, n))) for _ in range(400)] for _ in range(2))
        for _ in range(2):  # patterns of a batch of other widths are kept apart
            assert ratios(a, b) == [SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)]
    assert ratios([], []) == []
