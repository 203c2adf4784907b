from ledgerloom.operators.parser import parse_lines


def rows(lines):
    return [(r["cod"], r["denumire"], r["um"], r["cantitate"]) for r in parse_lines(lines)]


def test_one_line_items_with_price_labels():
    got = rows(["7", "QA11B2 - Strat de baza", "MP", "12.500", "3.00", "37.50", "material:", "1.00", "12.50", "8", "CA01J1 - Beton", "M.C.", "55.0", "10.00", "550.00"])
    assert got == [("QA11B2", "Strat de baza", "mp", 12.5), ("CA01J1", "Beton", "mc", 55.0)]


def test_description_over_several_lines():
    assert rows(["1", "CK01A01 - Tencuieli", "interioare", "MP", "1.0", "2", "VA02B08 - Zugraveli", "MP", "2.0"]) == [("CK01A01", "Tencuieli interioare", "mp", 1.0), ("VA02B08", "Zugraveli", "mp", 2.0)]


def test_linked_items_get_a_dollar_sign_and_specs_are_no_items():
    assert rows(["6", "RPC01A - Montare", "ML", "650,00", "6.L", "6700123", "Teava", "DN32", "ml", "650,00"]) == [("RPC01A", "Montare", "ml", 650.0), ("$6700123", "Teava", "ml", 650.0)]


def test_glued_number_scattered_fields_and_bracket_suffix():
    assert rows(["3CF41B01* - Tencuiala", "mp", "20.5"]) == [("CF41B01", "Tencuiala", "mp", 20.5)]
    assert rows(["9", "5102437", "BUCATA", "22,00000", "Robinet cu bila", "alama"]) == [("$5102437", "Robinet cu bila alama", "buc", 22.0)]
    assert rows(["226228 pag", "001", "SD05A1 [1]", "BUC.", "2.000", "ROBINET"]) == [("SD05A1", "ROBINET", "buc", 2.0)]


def test_integer_after_unit_is_a_quantity_and_headers_are_no_items():
    assert rows(["1 VA02B08", "finisaje", "mp", "100"]) == [("VA02B08", "finisaje", "mp", 100.0)]
    assert rows(["226108 pag", "Pagina 1 din 3", "TOTAL GENERAL", "", None or ""]) == []


def test_components():
    r = parse_lines(["1", "CA01J1 - Beton", "mc", "5.0", "L:SL30 -0001:2452958 - teava", "ml", "3.0"])
    assert [(x["cod"], x["is_component"], x["parent_code"]) for x in r] == [("CA01J1", False, None), ("$2452958", True, "CA01J1")]


def test_rules_left_out_do_not_act():
    """The rules that lines of figures are spared, and the patterns that other lines are spared, would not have acted on them."""
    import random

    from ledgerloom.operators import parser

    rng = random.Random(4)
    assert len(parser.BY_STATE["read"][1]) < len(parser.BY_STATE["read"][0])
    for _ in range(3000):
        line = "".join(rng.choice("0123456789.,") for _ in range(rng.randint(1, 9)))
        for state in ("idle", "wait", "read"):
            for quantity in (0.0, 2.0):
                m = parser.Machine()
                m.item, m.waiting, m.next = parser.Item("CK01A01", um="buc" if quantity else "", quantity=quantity) if state == "read" else None, int(state == "wait"), "buc"
                first = next(i for i, (states, test, _) in enumerate(parser.RULES) if state in states and test(m, line))
                assert first in parser.FIGURES
        assert parser.skipped_figure(line) == parser.skipped(line) == bool(parser._skips(parser.SITE)[0].search(line))
    for line in ("Cheltuieli directe", "Profit", "x pag", "PU x", "S. C. x", "STE-x", "ABC S.R.L.", "a TARGO b", "proſit", "plain words", "Din care:", "- proiect"):
        assert parser.skipped(line) == bool(parser._skips(parser.SITE)[1].search(line))
