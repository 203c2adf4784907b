"""The similarity joins and the greedy layers against plain loops over all pairs."""

import random
import time
from difflib import SequenceMatcher

import pytest

from ledgerloom.functions.similarity import code_ratio_of
from ledgerloom.operators import alike, graph, matching

from .test_operators import items


def codes(rng, n, signs="AB01", longest=9):
    return sorted({"".join(rng.choice(signs) for _ in range(rng.randint(1, longest))) for _ in range(n)})


@pytest.mark.parametrize("least", [0.75, 0.8, 0.9, 1.0])
def test_shared_grams_is_a_bound(least):
    """No pair of codes of that ratio shares fewer characters or neighbours than the filter asks for."""
    rng = random.Random(1)
    every = codes(rng, 400, "AB0", 10)
    count = lambda s, n: {g: sum(s[i : i + n] == g for i in range(len(s))) for g in {s[i : i + n] for i in range(len(s) - n + 1)}}
    seen = 0
    for a in every[::2]:
        for b in every[1::2]:
            if SequenceMatcher(None, a, b).ratio() >= least:
                seen += 1
                assert alike.reachable(len(a), len(b), least)
                for n in (1, 2):
                    x, y = count(a, n), count(b, n)
                    assert sum(min(x[g], y.get(g, 0)) for g in x) >= alike.shared_grams(len(a), len(b), least, n)
    assert seen > 20 or least == 1.0


@pytest.mark.parametrize("least", [0.75, 0.8])
def test_code_candidates_lose_no_pair(spark, least):
    rng = random.Random(7)
    short, same = codes(rng, 150), ["PK00" + c for c in codes(rng, 90, "0123456", 3)]
    left, right = short[::2] + same[::2] + ["$AB01", "A#B01", "x" * 60 + "1"], short[1::2] + same[1::2] + ["AB01", "x" * 59 + "12"]
    a, b = ((items(spark, [(s, c, "x", "m", 1.0) for s in ("1", "2") for c in side])) for side in (left, right))
    a, b = matching.prepare(a, False), matching.prepare(b, False)
    from ledgerloom.functions.codes import clean_code

    clean = lambda df: [r.c for r in df.select(clean_code("cod").alias("c")).distinct().collect()]
    want = {(s, x, y) for s in ("1", "2") for x in clean(a) for y in clean(b) if code_ratio_of(x, y) >= least}
    assert {(r.section, r.r_code, r.o_code) for r in alike.similar_codes(a, b, least).collect()} == want
    met = [tuple(r) for r in alike.code_candidates(a, b, least).collect()]
    assert len(met) == len(set(met)) and want <= set(met)


def test_signs_that_all_codes_share_are_not_met(spark):
    """Codes that agree in their first five signs: few of all pairs are candidates."""
    rng = random.Random(3)
    some = [f"PK000{k:05d}" for k in rng.sample(range(100_000), 1200)]
    a, b = (matching.prepare(items(spark, [("1", c, "x", "m", 1.0) for c in side]), False) for side in (some[::2], some[1::2]))
    assert alike.code_candidates(a, b, 0.8).count() < 600 * 600 / 4


def plain_turns(edges):
    """Each reference row in order takes its best offer row that is left; none where that one isn't sure."""
    used, out, by = set(), [], {}
    for r, o, s, sure in edges:
        by.setdefault(r, []).append((-s, o, sure))
    for r in sorted(by):
        left = sorted(x for x in by[r] if x[1] not in used)
        if left and left[0][2]:
            used.add(left[0][1])
            out.append((r, left[0][1], -left[0][0]))
    return out


@pytest.mark.parametrize("most", [10**9, 0])
def test_assignment_is_the_sequential_one(spark, monkeypatch, most):
    """In one partition, and dealt out by components."""
    monkeypatch.setattr(graph, "ONE_PARTITION", most)
    rng = random.Random(9)
    for n, links in ((40, 60), (200, 150), (30, 500)):
        edges = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(links)})
        edges = [(r, o, rng.choice([0.5, 0.7, 0.9]), rng.random() < 0.8) for r, o in edges]
        got = graph.assigned(spark.createDataFrame(edges, "ref_seq long, of_seq long, score double, sure boolean").repartition(3), "x")
        assert sorted((r.ref_seq, r.of_seq, r.score) for r in got.collect()) == sorted(plain_turns(edges))
    assert graph.assigned(spark.createDataFrame([], "ref_seq long, of_seq long, score double, sure boolean"), "x").count() == 0


def test_components_are_the_plain_ones(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500)]
    root = list(range(600))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    got = {r.u: r.v for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in range(600) if find(x) != x}


def plain_nearest(refs, offers):
    units, out = {u for _, _, u in refs}, []
    pool = sorted(offers, key=lambda x: (x[2] not in units, x[0], x[1]))
    for q, s, u in sorted(refs):
        if not pool:
            break
        best = min(range(len(pool)), key=lambda i: (pool[i][2] != u, abs(pool[i][0] - q), i))
        out.append((s, pool.pop(best)[1]))
    return out


def test_nearest_quantities_are_those_of_a_scan():
    rng = random.Random(2)
    for _ in range(400):
        side = lambda units: sorted((rng.choice([0.0, 1.0, 2.5, 3.0, 4.0, 7.0, 7.5]) + rng.choice([0, 0, 10]), k, rng.choice(units)) for k in range(rng.randrange(0, 25)))
        refs, offers = side(["m", "mp", "kg"]), side(["m", "mp", "buc", "t"])
        assert matching.nearest_pairs(refs, offers) == plain_nearest(refs, offers)


def test_a_key_of_a_hundred_thousand_rows_takes_seconds():
    rng = random.Random(8)
    refs, offers = (sorted((round(rng.uniform(0, 5000), 2), k, rng.choice(["m", "mp", "kg"])) for k in range(100_000)) for _ in range(2))
    start = time.time()
    assert len(matching.nearest_pairs(refs, offers)) == 100_000 and time.time() - start < 20


def test_descriptions_are_the_best_of_all(spark, monkeypatch):
    monkeypatch.setattr(alike, "BLOCK", 40)
    monkeypatch.setattr(alike, "CHUNK", 15)
    rng = random.Random(6)
    words = "beton simplu armat pentru fundatii cofraj din lemn usa metalica vopsea lavabila alba teava pvc 110 mm izolatie".split()
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))
    refs = [(text(), k) for k in range(130)] + [("beton simplu", 3), ("ăâî șț", 500)]
    queries = [text() for _ in range(40)] + ["beton simplu", "zzzz", "xyz qq", refs[5][0], "ăâî"]
    got = {r.d: r for r in alike.best_descriptions(spark.createDataFrame([(q,) for q in queries], "d string"), spark.createDataFrame(refs, "d string, seq long"), 0.45).collect()}
    for q in set(queries):
        best = max(((SequenceMatcher(None, q, d).ratio(), -s) for d, s in refs))
        assert (q in got) == (best[0] >= 0.45)
        if q in got:
            assert (got[q].score, got[q].ref_seq) == (pytest.approx(best[0]), -best[1])
    near = [r for r in got.values() if r.asked]
    assert near and sum(r.asked for r in near) < 0.8 * len(near) * len({d for d, _ in refs})


def layer(spark, ref, offer, **k):
    pairs, rows = matching.reconcile(ref, offer, **k)
    return {(r.ref_seq, r.of_seq): r.layer for r in pairs.collect()}, rows.collect()


def test_codes_differ_only_beside_another_difference(spark):
    ref, offer = items(spark, [("1", "$3275680", "teava pn 20", "m", 5.0)]), items(spark, [("1", "$3275630", "teava pn 20", "m", 5.0)])
    pairs, rows = layer(spark, ref, offer)
    assert pairs == {(0, 0): "similar"} and rows == []
    pairs, rows = layer(spark, ref, items(spark, [("1", "$3275630", "teava pn 20", "mp", 5.0)]))
    assert pairs == {(0, 0): "similar"} and sorted(r.tip for r in rows) == ["COD_SIMILAR", "UM_DIFERIT"]
    ref, offer = items(spark, [("1", "AUT3000", "aparat de sudura", "ora", 12.0)]), items(spark, [("1", "$77121", "aparat de sudura", "ora", 12.0)])
    pairs, rows = layer(spark, ref, offer)
    assert pairs == {(0, 0): "interval"} and rows == []


def test_descriptions_are_whole_and_section_names_cut(spark):
    from pyspark.sql import functions as F

    long = "d" * 150
    ref = items(spark, [("1", "AB01", long, "m", 5.0)]).withColumn("deviz_denumire", F.lit("n" * 130))
    offer = items(spark, [("1", "QQ9999", "w" * 150, "kg", 2.0), ("1", "QW9999", "q" * 150, "kg", 3.0)]).withColumn("deviz_denumire", F.when(F.col("seq") == 0, "n" * 130).otherwise("STRUCTURA e Devize 2024"))
    rows = {(r.tip, r.of_seq): r for r in layer(spark, ref, offer)[1]}
    lost, first, second = rows["ARTICOL_LIPSA", None], rows["ARTICOL_EXTRA", 0], rows["ARTICOL_EXTRA", 1]
    assert lost.ref_denumire == long and lost.deviz_denumire == "n" * 130
    assert first.oferta_denumire == "w" * 150 and first.deviz_denumire == "n" * 100 and second.deviz_denumire == "STRUCTURA"


def test_arithmetic_counts_with_prices(spark):
    from pyspark.sql import functions as F

    priced = lambda df, value: df.withColumns({"pret_material": F.lit(2.0), "val_material": F.lit(value)})
    ref = priced(items(spark, [("1", "AB01", "zid", "m", 5.0), ("1", "CD0123", "usa mare", "m", 5.0)]), 10.0)
    offer = priced(items(spark, [("1", "AB01", "zid", "m", 5.0), ("1", "CD0124", "usa mare", "m", 5.0)]), 99.0)
    assert not layer(spark, ref, offer)[1]
    rows = layer(spark, ref, offer, prices=True)[1]
    wrong = [r for r in rows if r.tip == "EROARE_ARITMETICA"]
    assert [(r.ref_seq, r.camp, r.calculat, r.declarat) for r in wrong] == [(0, "val_material", 10.0, 99.0)]  # alike codes are found too late to be checked
    assert {r.tip for r in rows if r.ref_seq == 1} == {"DIFERENTA_CAMP", "COD_SIMILAR"}


def test_surplus_rows_are_matched_by_text_before_components_drop_out(spark):
    from pyspark.sql import functions as F

    ref = items(spark, [("1", "AB01", "robinet cu sfera", "m", 5.0), ("1", "SD05A1", "alta", "buc", 1.0)]).withColumn("is_component", F.col("seq") == 1)
    offer = items(spark, [("1", "AB01", "robinet cu sfera", "m", 5.0), ("2", "SD05A1", "robinet cu sfere", "buc", 9.0), ("2", "SD05A1", "###", "kg", 7.0)])
    pairs, rows = layer(spark, ref, offer)
    assert pairs == {(0, 0): "exact", (0, 1): "suppressed"} and rows == []


def test_across_sections_nothing_but_the_section_differs(spark):
    from pyspark.sql import functions as F

    priced = lambda df, p: df.withColumns({"pret_material": F.lit(p), "val_material": F.lit(99.0)})
    pairs, rows = layer(spark, priced(items(spark, [("1", "AB01", "zid", "m", 5.0)]), 1.0), priced(items(spark, [("2", "AB01", "zid", "m", 5.0)]), 2.0), prices=True)
    assert pairs == {(0, 0): "cross_section"} and [r.tip for r in rows] == ["DEVIZ_MISMATCH"]


def test_a_dollar_code_without_unit_differs_by_unit_alone(spark):
    ref, offer = items(spark, [("1", "$5000123", "teava", "", 0.0)]), items(spark, [("1", "$5000123", "###", "m", 9.0)])
    pairs, rows = layer(spark, ref, offer)
    assert pairs == {(0, 0): "lenient"} and [r.tip for r in rows] == ["UM_DIFERIT"]


def test_codes_that_can_match(spark):
    """The count of characters in reach never falls below what a ratio matches."""
    from ledgerloom.functions.similarity import can_match

    rng = random.Random(12)
    every = [c for c in codes(rng, 300, "AB01", 12)] + ["", "É0A"]
    pairs = [(a, b) for a in every[::2] for b in every[1::3]]
    for least in (0.6, 0.75, 0.8, 1.0):
        may = can_match([a for a, _ in pairs], [b for _, b in pairs], least)
        want = [bool(a and b) and SequenceMatcher(None, a, b).ratio() >= least for a, b in pairs]
        assert all(m for m, w in zip(may, want) if w) and (least < 0.8 or may.sum() < 20 * max(1, sum(want)))
