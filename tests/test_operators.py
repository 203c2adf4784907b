from pyspark.sql import functions as F

from ledgerloom.operators import audits, components, dedup, matching, pages, providers, sections, tables

ITEM = "seq long, cod string, denumire string, um string, cantitate double, deviz string, deviz_denumire string, is_component boolean"


def items(spark, rows):
    return spark.createDataFrame([(i, c, d, u, q, s, "", False) for i, (s, c, d, u, q) in enumerate(rows)], ITEM)


def test_greedy_takes_unit_then_nearest_quantity(spark):
    ref = items(spark, [("1", "AB01", "x", "m", q) for q in (161.0, 482.0, 756.0)])
    offer = items(spark, [("1", "AB01", "x", "m", q) for q in (161.0, 207.0, 482.0, 756.0)])
    got = matching.exact_pairs(matching.prepare(ref, True), matching.prepare(offer, False)).collect()
    assert sorted((r.ref_seq, r.of_seq) for r in got) == [(0, 0), (1, 2), (2, 3)]
    ref, offer = items(spark, [("1", "AB01", "x", "m", 5.0), ("1", "AB01", "x", "mp", 9.0)]), items(spark, [("1", "AB01", "x", "mp", 5.0), ("1", "AB01", "x", "m", 50.0)])
    got = matching.exact_pairs(matching.prepare(ref, True), matching.prepare(offer, False)).collect()
    assert sorted((r.ref_seq, r.of_seq) for r in got) == [(0, 1), (1, 0)]


def test_all_layers(spark):
    ref = items(spark, [("1", "AB01A", "zid", "m", 5.0), ("1", "AUT6753", "auto", "ora", 2.0), ("1", "CD02", "tencuiala", "mp", 3.0), ("2", "EF03", "vopsea", "mp", 7.0), ("1", "GH0412", "usa lemn", "buc", 4.0), ("1", "ZZ99", "lipsa", "m", 1.0)])
    offer = items(spark, [("1", "AB01A", "zid", "mp", 5.0), ("1", "$6753", "auto", "ora", 2.0), ("1", "CD021", "tencuiala", "mp", 3.0), ("3", "EF03", "vopsea", "mp", 7.0), ("1", "GH0413", "usa lemn", "buc", 4.0), ("1", "QQ1234X", "altceva complet", "kg", 8.0)])
    pairs, rows = matching.reconcile(ref, offer)
    layers = {r.ref_seq: (r.of_seq, r.layer) for r in pairs.collect()}
    assert layers == {0: (0, "exact"), 1: (1, "normalized"), 2: (2, "variant"), 3: (3, "cross_section"), 4: (4, "similar")}
    tips = sorted((r.tip, r.ref_cod, r.oferta_cod) for r in rows.collect())
    assert ("ARTICOL_LIPSA", "ZZ99", None) in tips and ("ARTICOL_EXTRA", None, "QQ1234X") in tips
    assert ("UM_DIFERIT", "AB01A", "AB01A") in tips and ("DEVIZ_MISMATCH", "EF03", "EF03") in tips and not any(t[0] == "COD_SIMILAR" for t in tips)


def test_nothing_to_match(spark):
    none = items(spark, [("1", "AB01", "x", "m", 1.0)]).limit(0)
    pairs, rows = matching.reconcile(none, none)
    assert pairs.count() == 0 and rows.count() == 0


def test_code_suffixes_and_fragments(spark):
    df = items(spark, [("1", "$22121", "", "m", 1.0), ("1", "22222121", "", "m", 2.0), ("1", "CK01", "", "m", 1.0), ("1", "22121", "", "m", 1.0)])
    assert sorted(r.seq for r in dedup.drop_code_suffixes(df).collect()) == [1, 2]
    assert sorted(r.seq for r in dedup.drop_code_fragments(df).collect()) == [1, 2]


def test_sections(spark):
    ref = items(spark, [("A", c, "", "m", 1.0) for c in ("x1", "x2", "x3")])
    offer = items(spark, [("B", c, "", "m", 1.0) for c in ("x1", "x2", "x3")])
    assert [tuple(r) for r in sections.equivalences(ref, offer).collect()] == [("B", "A", 1.0, 3, 3)]
    assert sections.equivalences(ref, ref).count() == 0
    assert sections.orphans(ref, offer, ref.limit(0)).count() == 3
    assert {r.deviz for r in sections.corrected(ref, offer).collect()} == {"A"}
    side = lambda rows: spark.createDataFrame(rows, "deviz string, denumire string")
    got = {r.offer_deviz: (r.ref_deviz, r.how) for r in sections.map_by_name(side([("1", "structura 1"), ("2", "arhitectura")]), side([("1", "x"), ("9", "arhitectura"), ("8", "structura 2")])).collect()}
    assert got == {"1": ("1", "code"), "9": ("2", "name"), "8": ("1", "similar")}


def page(spark, *texts):
    rows = [(1, i, n, c) for i, t in enumerate(texts) for n, c in enumerate(t.split("\n"))]
    return pages.page_text(spark.createDataFrame(rows, "doc_id int, page_number int, line_no int, content string"))


def test_page_labels_and_keys(spark):
    got = {r.page_number: (r.label, r.deviz_cod, r.extraction_method) for r in pages.classify(page(spark, "Formularul F3\nDeviz oferta 226238\n1 CA01J1 - Beton", "Formular F3\nObiectul: 4.1 Cladire\nCategoria de lucrari: 03 Arhitectura", "Recapitulatie\nTOTAL GENERAL", "ceva", "Formular C6\nCA01J1", "Formular F3\nDeviz 7")).collect()}
    assert got == {0: ("F3", "226238", "explicit"), 1: ("F3", "4.1-03", "compound"), 2: ("NON_F3", "", "none"), 3: ("AMBIGUOUS", "", "none"), 4: ("NON_F3", "", "none"), 5: ("NON_F3", "", "none")}


def test_fill_resets_after_ambiguous(spark):
    df = spark.createDataFrame([(1, i, l, c, "") for i, (l, c) in enumerate([("F3", "A"), ("F3", ""), ("NON_F3", ""), ("AMBIGUOUS", ""), ("F3", "")])], "doc_id int, page_number int, label string, deviz_cod string, deviz_den string")
    assert [r.filled_cod for r in pages.fill_sections(df).orderBy("page_number").collect()] == ["A", "A", "", "A", ""]


def test_tables_and_merge(spark):
    docs = [("d", [], [
        {"row_count": 6, "column_count": 2, "cells": [{"row_index": 5, "column_index": 0, "content": "STADIUL FIZIC"}, {"row_index": 5, "column_index": 1, "content": "226108 STRUCTURA"}]},
        {"row_count": 4, "column_count": 5, "cells": [{"row_index": 0, "column_index": 0, "content": "SECTIUNEA TEHNICA"}, {"row_index": 1, "column_index": 0, "content": "Nr."}, {"row_index": 1, "column_index": 1, "content": "Capitol de lucrari"}, {"row_index": 1, "column_index": 2, "content": "U.M."}, {"row_index": 1, "column_index": 3, "content": "Cantitatea"}, {"row_index": 3, "column_index": 1, "content": "CA01J1 - Beton simplu"}, {"row_index": 3, "column_index": 2, "content": "mc"}, {"row_index": 3, "column_index": 3, "content": "12,5"}]},
    ])]
    from ledgerloom.sources.ocr import DOCUMENT

    c = tables.cells(spark.createDataFrame(docs, "doc_id string, " + DOCUMENT))
    assert [(r.cod, r.denumire, r.um, r.cantitate, r.deviz) for r in tables.table_items(c).collect()] == [("CA01J1", "beton simplu", "mc", 12.5, "226108")]
    line = items(spark, [("1", "A1", "", "m", 0.0), ("1", "B2", "", "m", 3.0)])
    tab = items(spark, [("1", "A1", "t", "m", 4.0), ("1", "B2", "t", "m", 3.0), ("1", "B2", "t", "mp", 3.0), ("1", "C3", "t", "m", 1.0)])
    assert sorted((r.cod, r.um, r.cantitate, r.side) for r in tables.merge(line, tab).collect()) == [("A1", "m", 4.0, 1), ("B2", "mp", 3.0, 1), ("C3", "m", 1.0, 1)]


def test_components_and_audits(spark):
    said = [">>> componenta 012", "037 SC27A2", "BUC.", "1.000", "PORTPAHAR DIN FONTA", "001 AUT3000", "ORA", "2.000", "APARAT DE SUDURA", "002 SA43D1", "M", "2.000", "TEAVA", ">>> componenta 013", "036 6701362", "ROBINET", ">>> componenta 014", "BETON", "x", ">>> componenta 015", "SC27A2", "KG", ">>> componenta 16 17 SD05A1"]
    ln = spark.createDataFrame([("d", 1, i, c) for i, c in enumerate(said)], "doc_id string, page_number int, line_no int, content string")
    assert sorted((r.line_no, r.cod, r.um, r.cantitate, r.denumire) for r in components.blocks(ln).collect()) == [(0, "SC27A2", "BUC", 0.0, "portpahar din fonta"), (5, "AUT3000", "ORA", 0.0, "aparat de sudura"), (13, "$6701362", "", 0.0, "robinet")]
    assert audits.code_context(spark.createDataFrame([("SD05A1",)], "code string"), ln).count() == 1
    assert {r.code: r.cause for r in audits.missing_causes(spark.createDataFrame([("SD05A1",), ("QQ77",)], "ref_cod string"), ln).collect()} == {"SD05A1": "exact", "QQ77": "genuine"}


def test_providers(spark):
    df = spark.createDataFrame([("__partial__CLADIRE:ARHITECTURA NOUA", "partial", {"object": {"num": "", "text": "CLADIRE"}, "category": {"num": "", "text": "ARHITECTURA NOUA"}})], "deviz_cod string, extraction_method string, section struct<object:struct<num:string,text:string>,category:struct<num:string,text:string>>")
    r = providers.resolve_partial(df).first()
    assert (r.deviz_cod, r.extraction_method) == ("ARHITECTURA", "partial_fallback")

    class Stub:
        def answer(self, task, rows):
            raise RuntimeError

    assert providers.ask(df.select("deviz_cod"), "resolve_partial", Stub()).filter(F.col("answer_deviz_cod").isNotNull()).count() == 0
    assert [x.text for x in providers.chunks(spark.createDataFrame([("d", "aaaa\nbbbb\ncc")], "doc_id string, text string"), 9).collect()] == ["aaaa\nbbbb", "cc"]
