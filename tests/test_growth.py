"""Work that must grow with the rows, not with their pairs."""

from pyspark.sql import functions as F

from ledgerloom.operators import pages


def test_rescue_folds_a_long_document(spark):
    n = 20_000
    p = spark.range(n).select(F.lit("d").alias("doc_id"), F.col("id").alias("page_number"), F.when(F.col("id") == 0, F.array(F.lit("articole"))).otherwise(F.array(F.lit("Sectiunea tehnica SECTIUNEA FINANCIARA"))).alias("lines"), (F.col("id") == 0).alias("is_f3"), F.when(F.col("id") == 0, "AB").otherwise("").alias("deviz_cod")).withColumn("full", F.concat_ws(" ", "lines"))
    got = pages.rescue_candidates(p, p.select("doc_id", "page_number", F.lit(0).cast("long").alias("score")).limit(0))
    assert got.filter("candidate = 'AB'").count() == n - 1
    assert "collect_list" not in got._jdf.queryExecution().toString()  # no document is gathered into one row


def test_components_as_spans_of_a_list(spark):
    from ledgerloom.operators import components

    m = 300
    items = spark.range(2 * m).select(F.when(F.col("id") % 2 == 0, "P").otherwise(F.format_string("C%04d", "id")).alias("cod"), F.col("id").alias("seq"), (F.col("id") % 2 == 1).alias("is_component"), F.when(F.col("id") % 2 == 1, "P").alias("parent_code"))
    got = components.spans(items)
    assert got.count() == 2 * m  # not m * m
    want = {(r.cod, r.seq): (len(r.components), min(r.components, default=None)) for r in components.hierarchy(items).collect()}
    assert {(r.cod, r.seq): (r.n, r.least) for r in got.filter("NOT is_component").collect()} == want
    # a component at its parent's own place does not stand behind it, and no code is no parent's
    edge = spark.createDataFrame([("P", 1, False, None), ("c", 1, True, "P"), (None, 0, False, None), ("x", 2, True, None)], "cod string, seq long, is_component boolean, parent_code string")
    assert [(r.n, r.least) for r in components.spans(edge).filter("NOT is_component").collect()] == [(0, None)] * 2


def test_intervals_meet_as_classes(spark):
    from ledgerloom.operators import matching

    rows = spark.range(200).select(F.lit("s").alias("section"), F.lit("m").alias("unit"), F.when(F.col("id") < 100, 100.0).otherwise(100.5).alias("qty"), *[F.lit("x").alias(c) for c in ("code", "norm", "denumire", "um")], F.col("id").alias("seq"))
    c = matching.interval_classes(rows, rows, F.sum("seq").alias("seqs"))
    assert c.count() == 4 and c.agg(F.sum(F.col("r_n") * F.col("o_n"))).first()[0] == matching.interval_candidates(rows, rows).count() == 40_000
    assert c.agg(F.sum(F.col("r_seqs") * F.col("o_n"))).first()[0] == matching.interval_candidates(rows, rows).agg(F.sum("r_seq")).first()[0]


def test_first_differences_make_no_pairs(spark):
    from ledgerloom.operators import compare

    rows = spark.range(400).select(F.lit("s").alias("section"), F.lit("C").alias("code"), F.lit("C").alias("cod"), F.lit("m").alias("um"), (F.lit(100.0) + F.col("id") * 0.01).alias("cantitate"), F.col("id").alias("seq"))
    got = compare.first_differences(rows, rows, ["section", "code"]).collect()
    assert [(r.ref_seq, r.oferta_seq, r.tip, r.camp) for r in got] == [(0, 51, "DIFERENTA_CAMP", "cantitate")]
    near = rows.filter("seq < 20")
    assert compare.first_differences(near, near, ["section", "code"]).count() == 0


def test_exact_pairs_shuffle_each_side_once(spark):
    from ledgerloom.operators import matching

    n = spark.range(0, 30_000).select(F.lit("s").alias("section"), F.concat(F.lit("C"), (F.col("id") % 9_000).cast("string")).alias("code"), F.col("id").alias("seq"), F.lit("m").alias("unit"), (F.col("id") % 7).cast("double").alias("qty"))
    # keys below 3,000 have more rows than one, those from 7,000 on lack one side
    ref = n.filter("seq < 9000 or seq >= 27000 and seq < 30000").withColumn("seq", F.col("seq") + 0)
    offer = n.filter("seq < 7000").withColumn("seq", F.col("seq") + 1_000_000)
    p = matching.exact_pairs(ref, offer)
    got = {(r.ref_seq, r.of_seq) for r in p.collect()}
    assert {(r, o) for r, o in got if 3_000 <= r < 9_000} == {(i, i + 1_000_000) for i in range(3_000, 7_000)}
    assert len(got) == 7_000 and len({o for _, o in got}) == 7_000
    assert p._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1
    few = ref.filter("seq < 400 or seq >= 27000 and seq < 27400"), offer.filter("seq < 1000300")
    whole = matching.exact_pairs(*few).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # keys go on from one batch into the next
    try:
        assert sorted(matching.exact_pairs(*few).collect()) == sorted(whole) and len(whole) == 300
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_many_parts_are_not_broadcast(spark, tmp_path):
    from ledgerloom.plans import bill

    n = 2_100_000
    spark.range(n).select(F.col("id").alias("p_partkey"), *[F.lit(c).alias(c) for c in ("p_name", "p_brand")], F.lit(1).alias("p_size"), F.lit(2.0).alias("p_retailprice")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(40).select(F.col("id").alias("l_orderkey"), (F.col("id") * 50_000).alias("l_partkey"), F.col("id").alias("l_suppkey"), F.lit(1).alias("l_linenumber"), F.lit(3.0).alias("l_quantity"), F.lit(6.0).alias("l_extendedprice")).write.parquet(f"{tmp_path}/lineitem.parquet")
    codes = bill.bill(spark, str(tmp_path)).select("l_orderkey", "cod")
    assert codes.count() == 40
    assert "Broadcast" not in codes._jdf.queryExecution().executedPlan().toString()


def test_arithmetic_reads_offer_items_only(spark):
    from ledgerloom.operators import matching

    items = lambda ids, price: matching.whole(spark.createDataFrame([(i, f"AB{i % 5}", "x", "m", float(i), "1", "", False, price, float(i)) for i in ids], "seq long, cod string, denumire string, um string, cantitate double, deviz string, deviz_denumire string, is_component boolean, pret_material double, val_material double"))
    ref, offer = items(range(1, 20), 1.0), items(range(101, 120), 2.0)
    pairs = matching.exact_pairs(matching.prepare(ref, True), matching.prepare(offer, False)).unionByName(spark.createDataFrame([(1, 101, "cross_section", 1.0)], "ref_seq long, of_seq long, layer string, score double"))
    none = matching.prepare(ref.limit(0), True)
    columns = ["ref_seq", "of_seq", "tip", "camp", "calculat", "declarat"]
    want = matching.discrepancies(pairs, ref, offer, none, none, prices=True).filter("tip = 'EROARE_ARITMETICA'").select(*columns)
    got = matching.arithmetic_of(pairs, offer)
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 19


def test_running_text_is_not_shuffled(spark, monkeypatch):
    """A document's items meet by document once; printed sections are not shuffled again."""
    from ledgerloom.plans import cases

    built = []

    def keep(text, site):
        built.append(text)
        return text.select("doc_id", F.lit("d").alias("deviz"), F.lit("n").alias("deviz_denumire"))

    monkeypatch.setattr(cases.extraction, "extract_text", keep)
    cases.sliced_text(spark, "/root/testdata/sf0.001")
    plan = built[0]._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and not [x for x in plan.splitlines() if "hashpartitioning(doc_id" in x and "code" in x]
