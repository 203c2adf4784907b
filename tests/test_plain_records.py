"""Records of the plain form are read at once, and give what the rules give line by line."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import parser

ODD = ["Formularul F3", "Deviz oferta 310012 LOT", "", "12", "5", "6.L", "6700123", "Teava", ">>> componenta 3", "001 AB123", "ORA", "kg", "2.00", "L", "PN16", "TOTAL GENERAL", "material:", "a RON", "12.50", "CA01J1", "AB1CD", "9", "BUCATA", "22,00", " x ", "Artisan x", "x\ny"]


def record(rng):
    code = rng.choice(["PK", "CM", "ABC", "STE"]) + rng.choice(["00001", "123", "2001", "0010001"])
    told = rng.choice(["large ring", "ab", "x  y z", "TOTAL GENERAL", "beton cub", "L: A1 - x", "material:", "a S.R.L.", " q w"])
    return [rng.choice(["1", "2", "7", "424", "0"]), f"{code} - {told}", rng.choice(["kg", "km", "MC.", "pag", "zz"]), rng.choice(["17.000", "0.000", "12", "3.5", "424.00"]), rng.choice(["900.00", "1.5", "7"]), rng.choice(["12.34", "000", "5,00"])]


def good(rng):
    return [rng.choice("1129"), f"PK{rng.randrange(99999):05} - {rng.choice(['large ring', 'hot bolt'])}", rng.choice(["kg", "buc", "m"]), f"{rng.randint(1, 50)}.000", f"{rng.uniform(900, 1000):.2f}", f"{rng.uniform(900, 90000):.2f}"]


def text_of(lines):
    return "\n".join(x.replace("\x1a", "\x1aa").replace("\n", "\x1an") for x in lines)


def told(found, more):
    plain = {"is_component": False, "parent_code": None, "subcomponents": []} | {p: 0.0 for p in parser.PRICES}
    return [plain | dict(zip(("cod", "denumire", "um", "cantitate", "pret_material", "val_material"), r)) for r in found] + (more or [])


@pytest.mark.parametrize("site", [(), parser.SITE])
def test_plain_records_give_what_the_rules_give(site):
    rng, at_once = random.Random(4), 0
    for _ in range(4000):
        lines = []
        for _ in range(rng.randint(1, 6)):
            r = rng.random()
            lines += good(rng) if r < 0.6 else record(rng) if r < 0.75 else rng.sample(ODD, rng.randint(1, 3)) if r < 0.9 else ODD[:2]
        found, more = parser.parse_text(text_of(lines), site)
        assert told(found, more) == parser.parse_lines(lines, site)
        at_once += len(found)
        # what the rules do not read begins no component's block
        assert more is not None or not parser.near_blocks(lines)
    assert at_once > 2000


def test_no_rule_reads_a_bill_of_plain_records(monkeypatch):
    rng = random.Random(5)
    lines = [*ODD[:2], *good(rng), *ODD[:2], *[x for _ in range(50) for x in ["1", *good(rng)[1:]]]]
    monkeypatch.setattr(parser, "parse_lines", None)
    found, more = parser.parse_text(text_of(lines), ())
    assert len(found) == 51 and more is None


def test_rows_of_several_lines_and_rows_of_one(spark):
    rng = random.Random(6)
    rows = [("d", s, "n", p, 0, [*ODD[:2], *good(rng), *record(rng), "x\ny", None]) for s in "ab" for p in range(9)]
    pages = spark.createDataFrame(rows, "doc_id string, deviz string, deviz_denumire string, page_number int, line_no int, lines array<string>")
    one = pages.select("doc_id", "deviz", "deviz_denumire", "page_number", F.posexplode("lines").alias("line_no", "content"))
    want = sorted(map(repr, parser.parse(one, ()).collect()))
    assert sorted(map(repr, parser.parse(pages, ()).collect())) == want and len(want) > 18


def test_a_printed_bill_is_not_numbered_and_its_lines_are_not_rows(spark):
    from ledgerloom.plans import cases

    plan = cases.parsed_bill(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan


def test_running_text_is_read_where_it_lies(spark):
    """Neither lines nor sections of a running text are rows; nothing is shuffled or staged."""
    from ledgerloom.operators import extraction

    def forbidden(*_):
        raise AssertionError("staged")

    item = ["1", "PK00001 - large ring", "kg", "2.000", "9.00", "18.00"]
    text = ["Centralizator", "Deviz oferta 310011 LOT A", "x", "Formularul F3", *item, "Deviz oferta 310012 LOT B", *item, ">>> componenta 1", "001 AB12", "kg", "2.00", "beton", "FORMULAR C6", *item, "Deviz oferta 310011 LOT C", *item, ">>> componenta 2", "AB12"]
    out = extraction.extract_text(spark.createDataFrame([("a", "\n".join(text)), ("b", "\n".join(item)), ("c", None), ("d", "\n".join(["STADIUL FIZIC: Zidarie", *item]))], "doc_id string, text string"), persist=forbidden)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    got = sorted((r.doc_id, r.deviz, r.deviz_denumire, r.cod, r.um, r.cantitate, r.is_component, r.line_no) for r in out.collect())
    plain = ("PK00001", "kg", 2.0, False)
    assert got == [("a", "310011", "LOT A", *plain, 0), ("a", "310011", "LOT A", *plain, 1), ("a", "310012", "LOT B", "AB12", "kg", 0.0, True, 17), ("a", "310012", "LOT B", *plain, 0), ("b", "DOC", "Document", *plain, 0), ("d", "SF_ZIDARIE_01", "Zidarie", *plain, 0)]


def test_documents_are_shuffled_once_before_and_once_after_they_are_read(spark):
    """Documents without tables are read where the fill has them; their items are shuffled once, and joined and staged nowhere."""
    from ledgerloom.operators import extraction

    def forbidden(*_):
        raise AssertionError("staged")

    item = ["1", "PK00001 - large ring", "kg", "2.000", "9.00", "18.00"]
    page = lambda k, *lines: (k, [(x,) for x in ("Formularul F3", "Deviz oferta 310012 LOT", *lines)])
    docs = spark.createDataFrame([("d", [page(2, *item, "1", "PK00002 - hot bolt", "m", "3.000", "9.00", "18.00"), page(1, *item, ">>> componenta 1", "001 AB12", "kg", "2.00", "beton")])], "doc_id string, pages array<struct<page_number:int,lines:array<struct<content:string>>>>")
    out = extraction.extract(docs, persist=forbidden, site=())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Join" not in plan
    assert [(r.seq, r.cod, r.um, r.cantitate, r.deviz, r.is_component) for r in out.orderBy("seq").collect()] == [(0, "PK00001", "tona", 2.0, "310012", False), (1, "PK00002", "m", 3.0, "310012", False), (2, "AB12", "tona", 0.0, "310012", True)]


def test_ends_of_codes_in_a_scope(spark):
    """The sorted form for rows with a scope drops the rows that the joined form drops in each part of it."""
    from ledgerloom.operators import dedup

    rng = random.Random(8)
    codes = ["", None, "1234", "$1234", "91234", "A1234", "234", "34", "AB34", "B34", "b34", "123456789", "0123456789", "56789", "6789"]
    rows = [(d, i, rng.choice(codes), rng.choice("st"), float(rng.randrange(2)), rng.choice(["m", None])) for d in "xyz" for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id string, seq long, cod string, deviz string, cantitate double, um string")
    want = sorted((d, r.seq) for d in "xyz" for r in dedup.drop_code_suffixes(df.filter(F.col("doc_id") == d)).collect())
    assert sorted((r.doc_id, r.seq) for r in dedup.drop_code_suffixes(df, scope=("doc_id",)).collect()) == want and 20 < len(want) < 120
