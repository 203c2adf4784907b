from ledgerloom.functions import codes as C
from ledgerloom.functions import similarity as S
from ledgerloom.functions import texts as T
from ledgerloom.functions import units as U


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"a {kind}").select(f("a").alias("x")).first().x


def test_codes(spark):
    for value, want in {"CK01A01^": "CK01A01", "$2911": "$2911", "ID03A01-": "ID03A01", None: ""}.items():
        assert one(spark, value, C.clean_code) == want
    for value, want in {"$22000561": "$2200056", "AUT6753": "$6753", "6753": "$6753", "SA13I#": "SA131", None: ""}.items():
        assert one(spark, value, C.normalize_code) == want
    assert one(spark, "226U08", C.normalize_section) == "226008"
    assert one(spark, "01 02 STRUCTURA OB 2", C.section_name_key) == "STRUCTURA OB2"


def test_units_and_numbers(spark):
    for value, want in {"1.840,50": 1840.5, "1,840.50": 1840.5, "650,00": 650.0, "1.840.00": 0.0, "x": 0.0, None: 0.0}.items():
        assert one(spark, value, U.parse_number) == want
    assert [one(spark, v, U.is_unit) for v in ("M.C.", "m cub", "8 MM", "TO?N", "UM", "")] == [True, True, False, True, False, False]
    assert one(spark, "99 M", U.table_quantity) == 99.0


def test_similarity(spark):
    assert (S.ratio("tide", "diet"), S.ratio("diet", "tide")) == (0.25, 0.5)
    df = spark.createDataFrame([("beton armat C16", "beton")], "a string, b string")
    assert df.select(S.token_score("a", "b")).first()[0] == 1 / 3
    assert df.select(S.code_ratio_from(0.9)("a", "b")).first()[0] == 0.0
    assert df.select(S.text_ratio("a", "b")).first()[0] == S.text_ratio_of("beton armat C16", "beton")


def test_texts(spark):
    assert one(spark, "TSC35XA1 - Sapatura", T.item_cell).asDict() == {"code": "TSC35XA1", "description": "Sapatura"}
    assert one(spark, "6715504 - Piesa", T.item_cell).code == "$6715504"
    assert one(spark, "a L:SL30 -0001:2452958 b", T.component_codes) == ["2452958"]
    assert one(spark, "STADIUL FIZIC: oferta 226108 STRUCTURA", T.stage_section).code == "226108"
    for raw in ('{"a": 1}', 'text ```json\n{"a": 1}\n``` end', 'before {"a": 1} after'):
        assert one(spark, raw, T.reply_json).strip() == '{"a": 1}'
    assert one(spark, "no json", T.reply_json) == "{}"
