"""Written reports, read back from their files, and the texts in them."""

import io
import re
import zipfile

import pytest

from ledgerloom.functions.texts import observation, systemic_alert
from ledgerloom.sources import ocr, office, sinks

DDL = "offer_nr int, tip string, camp string, ref double, oferta double, ref_deviz string, oferta_deviz string, ref_cod string, oferta_cod string, ref_denumire string, oferta_denumire string, ref_um string, oferta_um string, ref_cantitate double, oferta_cantitate double"
ROWS = [
    (1, "ARTICOL_LIPSA", None, None, None, "07", None, "AB1", None, "zid & tencuiala", None, "mp", None, 2.0, None),
    (1, "DIFERENTA_CAMP", "cantitate", 2.0, 3.0, "07", "07", "AB2", "AB2", "x", "x", "mp", "mp", 2.0, 3.0),
    (1, "ARTICOL_EXTRA", None, None, None, None, "07", None, "QQ1", None, "nou", None, "buc", None, 1.0),
    (2, "UM_DIFERIT", "um", None, None, "12", "12", "CD1", "CD1", "y", "y", "mp", "mc", 1.0, 1.0),
    (2, "DIFERENTA_CAMP", "pret_material", 5.0, 6.0, "12", "12", "CD2", "CD2", "y", "y", "mp", "mp", 1.0, 1.0),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, DDL)


def texts(data: bytes, name: str) -> list[str]:
    body = zipfile.ZipFile(io.BytesIO(data)).read(name).decode()
    return re.findall(r"<(?:w:)?t[^>]*>([^<]*)</(?:w:)?t>|<v>([^<]*)</v>", body)


def test_observations(rows):
    got = [r[0] for r in rows.select(observation()).collect()]
    assert got == ["Articol lipsă din ofertă", "Cantitate diferită: referință 2.0 mp, ofertat 3.0 mp", "Articol suplimentar în ofertă (nu există în referință)", "Unitate de măsură diferită: referință mp, ofertat mc", "Preț material diferită: referință 5.0 lei, ofertat 6.0 lei"]


def test_docx(spark, rows):
    item = "seq long, cod string, deviz string"
    ref, offer = spark.createDataFrame([(1, "AB1", "07"), (2, "AB2", "07")], item), spark.createDataFrame([(1, "AB2", "07"), (2, "QQ1", "07")], item)
    t = [a for a, _ in texts(office.report_docx(rows.filter("offer_nr = 1"), ref, offer, "Raport"), "word/document.xml")]
    assert t[0] == "Raport" and "Nr. neconformități: 3" in t and "zid &amp; tencuiala" in t
    order = [t.index(x) for x in ("Deviz 07 - lipsă 1, suplimentare 1, diferență +0", "AB1", "Articole suplimentare în ofertă", "QQ1", "SUMAR 07: 2 coduri cu neconformități, 2 articole în referință, 2 în ofertă")]
    assert order == sorted(order)


def test_xlsx(spark, rows):
    from pyspark.sql import functions as F

    data = office.report_xlsx(rows, "Primaria", prices=False, investment="Pod", offers=[(2, "di_oferta_2.json", "SC ALFA SRL"), (3, "di_oferta_3.json", "")], date="2024-01-02")
    names = zipfile.ZipFile(io.BytesIO(data)).namelist()
    assert {f"xl/worksheets/sheet{k}.xml" for k in (1, 2, 3, 4)} <= set(names)
    sheet = lambda k: [a or b for a, b in texts(data, f"xl/worksheets/sheet{k}.xml")]
    assert sheet(1) == ["Beneficiar:", "Primaria", "Obiect investiție:", "Pod", "Oferta", "Total neconcordanțe", "Oferta 2", "1", "Oferta 3", "0", "Oferta 1", "3"]
    head = ["Beneficiar:", "Primaria", "Obiect investiție:", "Pod", "Data:", "2024-01-02", "Oferta:"]
    assert sheet(2) == [*head, "Oferta 2 — di_oferta_2.json", "Ofertant:", "SC ALFA SRL", "Nr.\ncrt.", "Cerința din caietul de sarcini", "Ce a ofertat\nSC ALFA SRL", "Observații", "Categoria de lucrari: 12", "1", "CD1  mp  1.0\ny", "CD1  mc  1.0\ny", "UNITATE DE MĂSURĂ DIFERITĂ\nRef: mp  |  Ofertă: mc"]
    assert sheet(3)[-1] == "Nicio neconcordanță detectată."
    assert "—" in sheet(4) and "LIPSĂ ARTICOL" in sheet(4) and "CANTITATE DIFERITĂ\nRef: 2.0  |  Ofertă: 3.0" in sheet(4)
    data = office.report_xlsx(rows.withColumns({"suspect": F.col("tip") == "UM_DIFERIT", "motiv_suspiciune": F.lit("alt pret")}), alert=systemic_alert(0.456))
    assert "⚠️ ALERTĂ SISTEMICĂ: 45% din itemii verificați sunt suspecți" in sheet(1) and "⚠️ alt pret" in sheet(3) and "Suspect" in sheet(3)
    with pytest.raises(ValueError):
        office.report_xlsx(rows, most=2)


def test_files(spark, rows, tmp_path):
    sinks.report_sheets(rows, f"{tmp_path}/sheets")
    back = spark.read.option("header", True).csv(f"{tmp_path}/sheets/rows")
    assert back.count() == 5 and {r.offer_nr for r in back.collect()} == {1, 2}
    page = sinks.report_html(rows.filter("offer_nr = 1"), "A & B")
    assert "A &amp; B" in page and "missing 1, surplus 1, difference 0" in page
    sinks.comparison_json(rows, f"{tmp_path}/cmp")
    assert spark.read.json(f"{tmp_path}/cmp").count() == 5


def test_sources(spark, tmp_path):
    (tmp_path / "di_oferta_2.json").write_text('{"pages": [{"page_number": 1, "lines": [{"content": "OFERTANT,"}, {"content": "SC ALFA"}, {"content": "SRL"}, {"content": "Data 1.1"}]}]}')
    (tmp_path / "di_oferta_x.json").write_text('{"tables": []}')
    (tmp_path / "di_referinta.json").write_text('{"pages": []}')
    docs = ocr.documents(spark, str(tmp_path))
    assert [(r.doc_id, r.offer_nr) for r in ocr.offers(docs).collect()] == [("di_oferta_2", 2)] and ocr.reference(docs).count() == 1
    from ledgerloom.operators import pages

    assert [(r.doc_id, r.bidder) for r in pages.bidder_names(pages.lines(docs)).collect()] == [("di_oferta_2", "SC ALFA SRL")]
    (tmp_path / "want.txt").write_text("# none\nab1|zid\nbad line\n|x\n")
    assert [tuple(r) for r in ocr.expected_items(spark, str(tmp_path / "want.txt")).collect()] == [("AB1", "zid")]
    lib = ocr.patterns(spark)
    assert ocr.pattern_by_name(lib, "MANECIU").count() == 1 and ocr.pattern_by_name(lib, "none").count() == 0
