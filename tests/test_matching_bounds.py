"""The similarity layer's length filter against a join without it, at the bound of the ratio."""

from ledgerloom.functions.similarity import code_ratio_of
from ledgerloom.operators import matching

ITEM = "seq long, cod string, denumire string, um string, cantitate double, deviz string, deviz_denumire string, is_component boolean"
REF = ["$CA02A1B", "$123456", "1234", "CA02A", "$$12345678", "AB12$", "$", "ZZ9"]
OFFER = ["CA02A", "1234", "$123456", "$CA02A1B", "123456", "$AB123", "$$", "YY8877"]


def test_dollar_codes_at_the_bound(spark):
    side = lambda codes, ref: matching.prepare(spark.createDataFrame([(i, c, "zid", "m", 1.0, "1", "", False) for i, c in enumerate(codes)], ITEM), ref)
    ref, offer = side(REF, True), side(OFFER, False)
    for least in (0.8, 0.75):
        want = {(i, j) for i, a in enumerate(REF) for j, b in enumerate(OFFER) if code_ratio_of(a, b) >= least}
        got = {r.seq for r in matching.code_similarity_candidates(ref, offer, least).collect()}
        assert got == {i for i, _ in want}
        assert {(0, 0), (1, 1), (2, 2), (3, 3)} <= want
        for i, j in want:
            one = matching.similar_pairs(ref.filter(f"seq = {i}"), offer.filter(f"seq = {j}"), least).collect()
            assert [(r.ref_seq, r.of_seq) for r in one] == [(i, j)]


def test_dollar_codes_are_not_lost(spark):
    side = lambda code: spark.createDataFrame([(0, code, "zid de caramida", "m", 5.0, "1", "", False)], ITEM)
    pairs, rows = matching.reconcile(side("$CA02A1B"), side("CA02A"))
    assert [r.layer for r in pairs.collect()] == ["similar"]
    assert not {"ARTICOL_LIPSA", "ARTICOL_EXTRA"} & {r.tip for r in rows.collect()}
