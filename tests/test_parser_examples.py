"""The forms that bills take, each in its own words: one-line and many-line items, price blocks, linked rows, headings and OCR noise."""

from ledgerloom.operators.parser import component_mark, parse_lines, unit

HEAD = ["Antet", "SECTIUNEA TEHNICA", "SECTIUNEA FINANCIARA", "Nr.", "Capitol de lucrari", "U.M.", "Cantitatea", "Pretul unitar", "(fara TVA)", "- Lei -", "TOTALUL", "0", "1", "2", "3", "4", "5 = 3 x 4"]


def block(*values):
    return [x for label, (a, b) in zip(("material:", "manopera:", "utilaj:", "transport:"), values) for x in (label, a, b)]


NONE = (("0.00", "0.00"),) * 4


def by_code(lines):
    return {r["cod"]: r for r in parse_lines(lines)}


PRICED = [*HEAD, "7", "CB02C1 - SAPARE SANT IN TEREN TARE CU ADANCIME < 2M", "M.C.", "35.000", "21.92", "767.20", *block(("0.99", "34.65"), ("10.50", "367.50"), ("10.43", "365.05"), ("0.00", "0.00")),
          "8", "CC03D1 - ARMATURI IN GRINZI DIN OTEL FASONAT", "MP", "120.000", "62.44", "7,492.80", *block(*NONE)]


def test_priced_items_one_after_another():
    got = by_code(PRICED)
    a, b = got["CB02C1"], got["CC03D1"]
    assert (a["denumire"], a["um"], a["cantitate"]) == ("SAPARE SANT IN TEREN TARE CU ADANCIME < 2M", "mc", 35.0)
    assert (b["denumire"], b["um"], b["cantitate"]) == ("ARMATURI IN GRINZI DIN OTEL FASONAT", "mp", 120.0)


def test_price_labels_are_no_descriptions():
    for r in parse_lines(PRICED):
        assert not any(w in r["denumire"].lower() for w in ("material", "manopera", "utilaj", "transport"))


def test_sizes_and_types_on_a_line_of_their_own_are_no_items():
    for spec, code in (("DN40", "3271990"), ("S6051", "2600111"), ("PN16", "3276555")):
        got = by_code(["5", f"{code} - TEAVA DIN MATERIAL SPECIAL", spec, "m", "12.500"])
        assert spec not in got and f"${code}" in got


LINKED = ["STADIUL FIZIC: oferta 310208 INSTALATII", "0", "1", "2", "6", "EB03A2", "CONDUCTA DE CUPRU,", "MONTATA INGROPAT", "m", "410,00", "16,72", "6.855,20", *block(*NONE), "6.L", "2710015", "CONDUCTA CUPRU TIP", "FLEXIBIL D=16", "ML.", "410,00", "1,75", "717,50",
          "7", "EC16D1", "CUTIE DE LEGATURA", "buc", "14,00", "9,92", "138,88", *block(*NONE), "7.L", "7418999", "CUTIE PENTRU LEGATURI", "BUC.", "14,00", "18,00", "252,00",
          "8", "ED09B#", "LAMPA DE PERETE", "buc", "21,00", "82,39", "1.730,19", *block(*NONE), "8.L", "7402109", "LAMPA ROTUNDA 20W", "BUC.", "11,00", "92,00", "1.012,00", "8.L", "7402111", "LAMPA CU SENZOR", "BUC.", "10,00", "194,00", "1.940,00"]


def test_linked_rows_are_items_with_a_dollar_sign():
    got = by_code(LINKED)
    assert set(got) >= {"EB03A2", "EC16D1", "$2710015", "$7418999", "$7402109", "$7402111"} and len(parse_lines(LINKED)) == 7
    assert "ED09B" in got or "ED09B#" in got


def test_linked_rows_keep_their_own_fields():
    r = by_code(LINKED)["$2710015"]
    assert (r["cantitate"], r["um"]) == (410.0, "ml") and "cupru" in r["denumire"].lower() and "6.l" not in r["denumire"].lower()


def test_descriptions_of_one_to_three_lines():
    for text in (["Servicii de proiectare"], ["Intocmire dosar pentru", "obtinerea avizelor - depunere la autoritati"], ["Raport al unui specialist privind", "efectele asupra mediului - consultare -", "informarea publicului"]):
        got = parse_lines(["1", f"VB04K02 - {text[0]}", *text[1:], "BUC", "1.0"])
        assert [(r["cod"], r["denumire"], r["um"], r["cantitate"]) for r in got] == [("VB04K02", " ".join(text), "buc", 1.0)]
    two = parse_lines(["1", "VB01A01 - Consultanta", "BUC", "2.0", "2", "VB01A02 - Analiza", "BUC", "1.0"])
    assert [(r["cod"], r["cantitate"]) for r in two] == [("VB01A01", 2.0), ("VB01A02", 1.0)]


def test_a_code_with_a_bracket_opens_an_item_after_a_page_head():
    got = by_code(["310238 pag", "40", "Formularul F3", "Lista cu cantitatile de lucrari", "Deviz oferta 310238 MONTAJ CAZAN", "001", "IB22C1 [1]", "BUC.", "2.000", "MONTARE CAZAN"])
    assert got["IB22C1"]["um"] == "buc" and got["IB22C1"]["cantitate"] == 2.0


def test_section_numbers_are_no_items():
    assert "$310108" not in by_code(["310108 STRUCTURA DE BAZA HALA", "e Devize", "Formular F3", "SECTIUNEA TEHNICA"])
    assert "$310508" not in by_code(["310508 pag", "01", "STRUCTURA DE BAZA"])


def test_a_model_behind_a_name_is_no_item():
    got = parse_lines(["3", "SB07A1 - LAVOAR DE PERETE", "CAB4-A", "buc", "3.000"])
    assert [r["cod"] for r in got] == ["SB07A1"] and parse_lines(["LAVOAR DE PERETE", "CAB4-A", "buc", "3.000"]) == []


def test_what_the_next_line_decides():
    (r,) = parse_lines(["4", "TB10A1 - TEAVA", "25", "MM", "G", "M", "7.500"])
    assert (r["um"], r["cantitate"]) == ("M".lower(), 7.5) and "25" in r["denumire"]


def test_units_in_a_token():
    assert (unit("m²"), unit("m2"), unit("M CUB"), unit("8 MM")) == ("mp", "mp", "mc", None) and unit("100 m2") is not None


def test_component_marks():
    marks = [(">>> componenta 3", "AB1"), ("L:AB1 -0001:22", "AB1"), ("material:", "AB1")]
    assert all(component_mark("X1", last, line) for line, last in marks)
    assert component_mark("17.L", "AB1", "") and component_mark("2.3", "2", "") and not component_mark("2.3", "4", "") and not component_mark("AB2", "AB1", "beton")
