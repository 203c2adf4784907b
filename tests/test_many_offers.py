"""Many offers in one plan, the ledger of a provider's calls, rules in SQL, progress, and torn lines."""

import json
import os
import threading

import pytest

from pyspark.sql import functions as F

from ledgerloom.operators import graph, matching, providers, sql
from ledgerloom.operators.parser import merged, parse_lines

from .test_operators import items


def bills(spark, seed):
    import random

    rng = random.Random(seed)
    codes = [f"CA{k:02d}A{k % 3}" for k in range(14)] + ["AUT6753", "$5000123", "SD05A1"]
    row = lambda: (rng.choice(["1", "2", "3"]), rng.choice(codes), rng.choice(["zid de caramida", "usa metalica", "teava pvc 110", "#"]), rng.choice(["m", "mp", "buc", ""]), float(rng.choice([0, 1, 1, 2, 5, 5.01, 40])))
    return items(spark, [row() for _ in range(45)])


@pytest.mark.parametrize("most", [10**9, 0])
def test_many_offers_are_each_alone(spark, monkeypatch, most):
    if most == 0:
        monkeypatch.setattr(graph, "ONE_PARTITION", 20)
    ref = bills(spark, 1).withColumn("is_component", F.col("cod") == "SD05A1")
    offers = {nr: bills(spark, nr) for nr in ((3, 7) if most else (4,))}
    every = None
    for nr, o in offers.items():
        o = o.withColumn("offer_nr", F.lit(nr))
        every = o if every is None else every.unionByName(o)
    pairs, rows = matching.reconcile_many(ref, every)
    told = lambda x, *more: sorted((repr((r.ref_seq, r.of_seq, r.layer, *[r[c] for c in more])) for r in x))
    got, found = pairs.collect(), rows.collect()
    for nr, o in offers.items():
        p, d = matching.reconcile(ref, o)
        assert told([r for r in got if r.offer_nr == nr], "score") == told(p.collect(), "score")
        assert told([r for r in found if r.offer_nr == nr], "tip", "camp", "ref", "oferta") == told(d.collect(), "tip", "camp", "ref", "oferta")


def test_no_offers(spark):
    none = bills(spark, 1).limit(0).withColumn("offer_nr", F.lit(1))
    pairs, rows = matching.reconcile_many(bills(spark, 1), none)
    assert pairs.count() == 0 and rows.count() == 0


class Counting:
    """Writes a file for every call; fails from the k-th on while a file says so."""

    def __init__(self, folder, slow=0.0):
        self.folder, self.slow = folder, slow

    def answer(self, task, rows):
        import time
        import uuid

        time.sleep(self.slow)
        calls = os.listdir(self.folder)
        if os.path.exists(self.folder + ".broken") and len(calls) >= 2:
            raise SystemExit("the task dies")
        open(f"{self.folder}/{uuid.uuid4().hex}", "w").close()
        return [{"category": r["denumire"].upper()} for r in rows]


def test_calls_that_were_answered_are_not_made_again(spark, tmp_path):
    """A task dies in its midst; when it is run again, only what was not answered is asked, and nothing the third time."""
    calls = str(tmp_path / "calls")
    os.mkdir(calls)
    rows = spark.createDataFrame([(f"d{k:03d}",) for k in range(60)], "denumire string").coalesce(1)
    ledger = providers.Ledger(f"file://{tmp_path}/ledger", patience=1.0)
    ask = lambda: providers.ask(rows, "categories", Counting(calls), batch=10, ledger=ledger, calls=1)
    open(calls + ".broken", "w").close()
    with pytest.raises(Exception):
        ask().collect()
    assert 1 <= len(os.listdir(calls)) < 6
    os.remove(calls + ".broken")
    for _ in range(2):
        assert [r.answer_category for r in ask().orderBy("denumire").collect()] == [f"D{k:03d}" for k in range(60)]
        assert len(os.listdir(calls)) == 6


def test_doubled_calls_wait_for_one_answer(tmp_path):
    calls = str(tmp_path / "calls")
    os.mkdir(calls)
    ledger, who = providers.Ledger(str(tmp_path / "ledger")), Counting(calls, 0.3)
    got = []
    tasks = [threading.Thread(target=lambda: got.append(providers.asked(who, "categories", [{"denumire": "a"}], ledger))) for _ in range(5)]
    for t in tasks:
        t.start()
    for t in tasks:
        t.join()
    assert got == [[{"category": "A"}]] * 5 and len(os.listdir(calls)) == 1


def test_a_failure_is_not_kept(tmp_path):
    class Fails:
        def answer(self, task, rows):
            raise ValueError

    ledger = providers.Ledger(str(tmp_path / "ledger"))
    assert providers.asked(Fails(), "categories", [{"denumire": "a"}], ledger) == []
    assert providers.asked(providers.JsonClient(lambda *a: json.dumps({"rows": [{"category": "b"}]})), "categories", [{"denumire": "a"}], ledger) == [{"category": "b"}]


def test_rules_in_sql(spark):
    from ledgerloom.functions import similarity as S

    sql.register_rules(spark)
    rows = spark.createDataFrame([("1x2x3", "12x3"), ("teava 110,45", "teava 11045 mm"), ("zid - lot 2", "zid - lot 3"), ("", "x"), (None, None)], "a string, b string")
    rows.createOrReplaceTempView("said")
    got = spark.sql("SELECT a, token_score(a, b) AS t, name_ratio(a, b) AS n, code_ratio(a, b) AS c, text_ratio(a, b) AS x, description_ratio(a, b) AS d FROM said")
    want = rows.select("a", S.token_score("a", "b").alias("t"), S.name_ratio("a", "b").alias("n"), S.code_ratio("a", "b").alias("c"), S.text_ratio("a", "b").alias("x"), S.description_ratio("a", "b").alias("d"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert S.name_ratio_of("zid - lot 2", "zid - lot 3") == 1.0 and S.name_ratio_of("arhitectura", "arhitectura noua") < 1.0
    assert [tuple(r) for r in spark.sql("SELECT cod, um, cantitate FROM parse_lines(array('1', 'CA01A1 - beton', 'mc', '5.000'))").collect()] == [("CA01A1", "mc", 5.0)]


def test_progress(spark):
    told = []
    pairs, _ = matching.reconcile(bills(spark, 1), bills(spark, 2), persist=sql.watched(lambda name, n, seconds: told.append((name, n))))
    assert ("pairs", pairs.count()) in told and dict(told)["ref-items"] == 45


def test_torn_lines_are_joined():
    assert merged(["100", "mp", "x"]) == ["100 mp", "x"] and merged(["100", "km"]) == ["100", "km"] and merged(["12345", "mp"]) == ["12345", "mp"]
    assert merged(["9", "5102437", "BUCATA", "22,00000", "Usa", "metalica", "10", "CK23A"]) == ["9 5102437 - Usa metalica", "BUCATA", "22,00000", "10", "CK23A"]
    assert merged(["9", "5102437", "cutie mare", "22", "Usa"])[0] == "9 5102437 - Usa"
    got = parse_lines(["9", "5102437", "BUCATA", "22,00000", "Usa metalica", "10", "CK23A", "mp", "3,5", "Geam"])
    assert [(r["cod"], r["denumire"], r["um"], r["cantitate"]) for r in got] == [("$5102437", "Usa metalica", "buc", 22.0), ("CK23A", "Geam", "mp", 3.5)]


def test_site_marks_are_a_parameter():
    said = ["1", "CA01A1 - Beton 424", "mc", "5.000", "2", "CB02B1 - Cofraj", "mp", "7.000"]
    assert [r["cod"] for r in parse_lines(said)] == ["CB02B1"] and [r["cod"] for r in parse_lines(said, site=())] == ["CA01A1", "CB02B1"]
    assert [r["cod"] for r in parse_lines(said, site=("Cofraj",))] == ["CA01A1"]
