"""From OCR documents to comparisons: extraction, rescan, providers, streaming."""

import pytest

from pyspark.sql import functions as F

from ledgerloom.operators import comparison, extraction, matching, providers
from ledgerloom.sources.ocr import DOCUMENT

from .test_operators import items


def page(n, *lines):
    return {"page_number": n, "lines": [{"content": x} for x in lines]}


def item(nr, code, name, um, qty):
    return [str(nr), f"{code} - {name}", um, f"{qty:.3f}", "1.00", "2.00"]


@pytest.fixture(scope="module")
def docs(spark):
    head = lambda code: ["Formularul F3", f"Deviz oferta {code} LOT {code}"]
    ref = [page(1, *head("310012"), *item(1, "CA01A1", "Beton simplu", "mc", 5), *item(2, "CB02B1", "Cofraje din lemn", "mp", 7)), page(2, *item(3, "CC03C1", "Armaturi de otel", "kg", 9)), page(3, *head("310013"), *item(1, "EF03D1", "Lampa de perete", "buc", 4)), page(4, "nimic"), page(5, *head("310014"), *item(1, "GH04E1", "Vopsea alba", "mp", 6))]
    offer = [page(1, *head("310012"), *item(1, "CA01A1", "Beton simplu", "mc", 5), *item(2, "CB02B1", "Cofraje din lemn", "ml", 7), *item(3, "QQ99Z9", "Cu totul altceva aici", "ora", 1)), page(2, *head("310013"), *item(1, "EF03D1", "Lampa de perete", "buc", 8))]
    return spark.createDataFrame([("di_referinta", ref, []), ("di_oferta_1", offer, [])], "doc_id string, " + DOCUMENT)


def test_pages_are_staged_without_their_text(docs):
    class Staged(Exception):
        pass

    def persist(df, name):
        raise Staged(name, df.columns)

    with pytest.raises(Staged) as told:
        extraction.extract(docs, persist=persist)
    name, columns = told.value.args
    assert name == "pages" and "lines" in columns and "full" not in columns


def test_extract(docs):
    got = {(r.doc_id, r.cod): (r.deviz, r.um, r.cantitate) for r in extraction.extract(docs).collect()}
    assert got["di_referinta", "CA01A1"] == ("310012", "mc", 5.0) and got["di_referinta", "EF03D1"] == ("310013", "buc", 4.0)
    assert len(got) == 9 and extraction.extract(docs.limit(0)).count() == 0
    assert [r.doc_id for r in extraction.empty_documents(extraction.classified(docs.filter("false"))).collect()] == []


def test_compare_documents(docs):
    c = comparison.reconcile_documents(docs)[1]
    tips = {(r.tip, r.ref_cod, r.oferta_cod) for r in c.discrepancies.collect()}
    assert {("UM_DIFERIT", "CB02B1", "CB02B1"), ("DIFERENTA_CAMP", "EF03D1", "EF03D1"), ("ARTICOL_LIPSA", "GH04E1", None), ("ARTICOL_EXTRA", None, "QQ99Z9")} <= tips
    assert {(r.side, r.deviz) for r in c.sections.collect()} == {("missing", "310014")}
    assert not any(r.posibil_omis_din_extractie for r in c.discrepancies.collect())


def test_rescan_finds_a_section_that_was_missed(spark):
    lines = ["Pag 1", "STADIUL FIZIC: oferta 226108 STRUCTURA", *item(1, "CA01A1", "Beton", "mc", 5)]
    docs = spark.createDataFrame([("d", [page(1, *lines), page(2, *item(2, "CB02B1", "Cofraje", "mp", 7)), page(3, "STADIUL FIZIC: oferta 226109 ALTA", *item(1, "CC03C1", "Otel", "t", 1))], [])], "doc_id string, " + DOCUMENT)
    classes = extraction.classified(docs).withColumns({"is_f3": F.lit(False), "deviz_cod": F.lit("")})
    targets = spark.createDataFrame([("d", "226108"), ("d", "999999")], "doc_id string, target string")
    none = extraction.items_of(classes)
    got, open_ = extraction.rescan(classes, none, targets)
    assert sorted((r.cod, r.deviz) for r in got.collect()) == [("CA01A1", "226108"), ("CB02B1", "226108")]
    assert [r.target for r in open_.collect()] == ["999999"]


def test_reference_names_resolve_partial_keys(spark):
    docs = spark.createDataFrame([("d", [page(1, "Formular F3", "Obiectul: Cladire", "Categoria de lucrari: Zidarie Lista", *item(1, "CA01A1", "Beton", "mc", 5))], [])], "doc_id string, " + DOCUMENT)
    ref = items(spark, [("4.1-03", "AB01", "x", "m", 1.0)]).withColumn("deviz_denumire", F.lit("zidarie"))
    r = extraction.classified(docs, ref).first()
    assert (r.deviz_cod, r.extraction_method) == ("4.1-03", "reference_matched")
    assert extraction.classified(docs, ref.withColumn("deviz_denumire", F.lit("cu totul altceva"))).first().extraction_method == "partial_fallback"


class Told:
    """Answers page questions with a section, item questions with the first candidate, and names with their upper case."""

    def answer(self, task, rows):
        import json

        if task == "classify_pages":
            return [{"label": "F3", "deviz_cod": "555555"} for _ in rows]
        if task == "fuzzy_items":
            return [{"of_seq": json.loads(r["candidates"])[0]["of_seq"], "score": 0.9} for r in rows]
        if task == "section_names":
            return [{"ref_name": r["offer_name"].upper()} for r in rows]
        if task == "extract_items":
            return [{"items": json.dumps([{"cod": "AB1", "denumire": r["text"][:3], "um": "m", "cantitate": 2.0, "is_component": False}])} for r in rows]
        return [{} for _ in rows]


def test_a_provider_decides_pages_and_items(spark):
    docs = spark.createDataFrame([("d", [page(1, "fara semne", *item(1, "CA01A1", "Beton", "mc", 5))], [])], "doc_id string, " + DOCUMENT)
    assert extraction.extract(docs).count() == 0
    assert [(r.cod, r.deviz) for r in extraction.extract(docs, provider=Told()).collect()] == [("CA01A1", "555555")]
    ref, offer = items(spark, [("1", "AB0123", "zid", "m", 5.0)]), items(spark, [("1", "AB0199", "tencuiala", "mp", 50.0)])
    assert matching.reconcile(ref, offer)[0].count() == 0
    pairs, rows = matching.reconcile(ref, offer, provider=Told())
    assert [(r.ref_seq, r.of_seq, r.layer) for r in pairs.collect()] == [] or pairs.first().layer == "provider"
    ref, offer = items(spark, [("1", "AB0123", "zid", "m", 5.0)]), items(spark, [("1", "AB0129X", "tencuiala", "mp", 50.0)])
    assert [r.layer for r in matching.reconcile(ref, offer, provider=Told())[0].collect()] == ["provider"]


def test_provider_tasks(spark):
    names = spark.createDataFrame([("zid",)], "offer_name string")
    assert [tuple(r) for r in providers.section_names(names, Told()).collect()] == [("zid", "ZID")] and providers.section_names(names).count() == 0
    found = providers.extracted(spark.createDataFrame([("d", "abc\ndef")], "doc_id string, text string"), Told())
    assert [(r.cod, r.denumire, r.cantitate) for r in found.collect()] == [("AB1", "abc", 2.0)]
    parts = spark.createDataFrame([("d", "AB1", 2.0), ("d", "AB2", 2.0)], "doc_id string, cod string, cantitate double")
    assert [r.cod for r in providers.drop_found(parts, found).collect()] == ["AB2"]
    client = providers.JsonClient(lambda model, messages, temperature: 'Sure:\n```json\n{"rows": [{"category": "a"}]}\n```')
    assert client.answer("categories", [{"denumire": "x"}]) == [{"category": "a"}]
    for raw in ('{"a": 1}', 'x ```json\n{"a": 1}\n``` y', 'b {"a": 1} c'):
        assert providers.reply_object(raw) == {"a": 1}
    assert providers.reply_object("none") == {} and providers.reply_object(None) == {}


def test_similar_codes_lose_no_pair(spark):
    """Codes that meet over shared characters, against every pair of them."""
    import random

    from ledgerloom.functions.similarity import code_ratio_of

    rng = random.Random(5)
    codes = sorted({"".join(rng.choice("AB01") for _ in range(rng.randint(1, 8))) for _ in range(160)})
    a, b = items(spark, [("1", c, "x", "m", 1.0) for c in codes[::2]]), items(spark, [("1", c, "x", "m", 1.0) for c in codes[1::2]])
    a, b = matching.prepare(a, False), matching.prepare(b, False)
    for least in (0.8, 0.75):
        got = {(r.r_code, r.o_code) for r in matching.similar_codes(a, b, least).collect()}
        assert got == {(x, y) for x in codes[::2] for y in codes[1::2] if code_ratio_of(x, y) >= least}


def test_streamed_offers(spark, tmp_path):
    from ledgerloom.streaming import offers

    rows = [(1, i, f"AB0{i}", "x", "m", float(i), "1", "", False) for i in range(4)]
    df = spark.createDataFrame(rows, "offer_nr int, seq long, cod string, denumire string, um string, cantitate double, deviz string, deviz_denumire string, is_component boolean").withColumn("arrived", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    df.union(df).write.json(f"{tmp_path}/in")
    ref = items(spark, [("1", "AB00", "x", "m", 1.0)])
    q = offers.compare_arrivals(offers.incoming(spark, f"{tmp_path}/in"), ref, f"{tmp_path}/out", f"{tmp_path}/state", lambda r, o: o.join(r.select("cod"), "cod", "left_anti").select("offer_nr", "cod"))
    q.awaitTermination(120)
    assert sorted(r.cod for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["AB01", "AB02", "AB03"]


def test_prices_and_context(spark):
    priced = lambda rows, p: items(spark, rows).withColumn("pret_material", F.lit(p))
    ref, offer = priced([("1", "AB01", "zid", "m", 5.0), ("1", "CD02", "vopsea", "mp", 1.0)], 10.0), priced([("1", "AB01", "zid", "m", 5.0), ("1", "QQ99Z", "altceva", "kg", 2.0)], 12.0)
    _, without = matching.reconcile(ref, offer)
    assert {r.tip for r in without.collect()} == {"ARTICOL_LIPSA", "ARTICOL_EXTRA"}
    _, rows = matching.reconcile(ref, offer, prices=True)
    got = {r.tip: r for r in rows.collect()}
    d = got["DIFERENTA_CAMP"]
    assert (d.camp, d.ref, d.oferta, d.ref_pret_material, d.oferta_pret_material, d.is_component) == ("pret_material", 10.0, 12.0, 10.0, 12.0, False)
    assert got["ARTICOL_EXTRA"].oferta_pret_material == 12.0 and got["ARTICOL_EXTRA"].ref_pret_material is None
    assert set(matching.CONTEXT) <= set(rows.columns)


def test_parse_lines_in_sql(spark):
    from ledgerloom.operators import parser

    parser.register(spark)
    got = spark.sql("SELECT p.cod, p.um, p.cantitate FROM VALUES (array('1', 'CA01A1 - Beton', 'mc', '5.000')) t(l), LATERAL parse_lines(t.l) p").collect()
    assert [tuple(r) for r in got] == [("CA01A1", "mc", 5.0)]
