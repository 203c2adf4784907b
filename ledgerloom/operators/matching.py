"""The layered join of reference items and offer items.

Layers run on residuals: each takes what the ones before left on both sides and returns pairs (ref_seq, of_seq, layer,
score). Equi-joins carry every layer. The exact layer reads one key at a time; the other greedy layers deal candidate
pairs out by the components of their graph (graph.py), as the order of consumption is part of the result. Ties go to the
smaller ordinal.

Every row takes part in every layer until it is matched: a matched key does not use up its other rows, and these are
reported where nothing matches them.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import clean_code, normalize_code, section_key, text
from ..functions.similarity import code_ratio_from, score_tokens, tokens_score
from ..functions.texts import programme_name
from ..functions.units import compare_unit
from ..session import ship, staged
from .alike import REST, by_rests, code_lengths, long_candidates, similar_codes, suppressed_extras
from .compare import PRICES, arithmetic, arithmetic_errors, dedup_discrepancies, diffs, field_rank, lenient
from .dedup import dedup_items
from .graph import PAIRS, assigned, assigned_classes
from .runs import runs

#: Layers whose pairs share a key or a variant of it.
EARLY = ("exact", "normalized", "variant", "surplus")
FIELDS = ("seq", "cod", "denumire", "um", "cantitate", "deviz", "deviz_denumire", "is_component")


#: What every discrepancy carries of both items.
CONTEXT = ("layer", "ref_seq", "of_seq", *[f"{side}_{c}" for c in ("cod", "denumire", "deviz", "um", "cantitate") for side in ("ref", "oferta")], "deviz_denumire", "is_component", *[f"{side}_{c}" for side in ("ref", "oferta") for c in PRICES])


def whole(items: DataFrame) -> DataFrame:
    """Items with all prices and values, 0 where a column is missing."""
    return items.withColumns({c: F.lit(0.0) for c in PRICES if c not in items.columns})


def is_artefact(quantity: str = "cantitate", unit: str = "um") -> Column:
    """A row without quantity whose unit is empty or in upper case comes from a heading."""
    u = text(unit)
    return (F.coalesce(F.col(quantity), F.lit(0.0)) == 0) & ((u == "") | (u == F.upper(u)))


def prepare(items: DataFrame, reference: bool, scope: tuple[str, ...] = ()) -> DataFrame:
    """Rows with a code, no artefacts, no components on the reference's side, one of each (section, code, unit, quantity), with join keys. `scope` columns, such as the offer's number, are part of a section."""
    rows = items.filter((text("cod") != "") & ~is_artefact())
    if reference:
        rows = rows.filter(~F.coalesce("is_component", F.lit(False)))
    section = section_key("deviz", "deviz_denumire")
    section = F.concat_ws("\t", *[F.col(c).cast("string") for c in scope], section) if scope else section
    return dedup_items(rows, ["seq"], scope).withColumns({"section": section, "code": clean_code("cod"), "norm": normalize_code("cod"), "unit": compare_unit("um"), "qty": F.coalesce("cantitate", F.lit(0.0))})


def rest(rows: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    return rows.join(pairs.select(F.col(side).alias("seq")), "seq", "left_anti")


def ordinal_pairs(ref: DataFrame, offer: DataFrame, keys: list, layer: str, order: list[str] | None = None) -> DataFrame:
    """Pairs the n-th reference row of a key with its n-th offer row, both in order of quantity."""
    order = order or ["qty", "seq"]
    number = lambda rows, name: rows.select(*[k.alias(f"__k{i}") for i, k in enumerate(keys)], F.col("seq").alias(name), *order).withColumn("__n", F.row_number().over(Window.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy(*order))).drop(*[o for o in order if o != name])
    on = [*[f"__k{i}" for i in range(len(keys))], "__n"]
    return number(ref, "ref_seq").join(number(offer, "of_seq"), on).select("ref_seq", "of_seq", F.lit(layer).alias("layer"), F.lit(1.0).alias("score"))


def exact_pairs(ref: DataFrame, offer: DataFrame) -> DataFrame:
    """Section and code are equal: each reference row in order of quantity takes the offer row of its unit with the nearest quantity.

    Both sides lie together by key after one shuffle. A key that one side lacks goes no farther, one with one row on either
    side is a pair at once; only the others are read key by key.
    """
    keys = ["section", "code"]
    side = lambda rows, k: rows.select(*keys, "seq", "unit", "qty", F.lit(k).alias("side")).dropna(subset=keys)
    key = Window.partitionBy(*keys)
    n = lambda k: F.count_if(F.col("side") == k).over(key)
    both = side(ref, 0).unionByName(side(offer, 1)).withColumns({"nr": n(0), "no": n(1), "after": F.coalesce(F.lead("seq").over(key.orderBy("side")), F.lit(0))})
    both = both.withColumns({"single": (F.col("nr") == 1) & (F.col("no") == 1), "key": F.min(F.when(F.col("side") == 0, F.col("seq"))).over(key)}).filter("nr > 0 AND no > 0 AND (NOT single OR side = 0)")

    def taken(rows):
        out: list[tuple] = []
        for g in runs([rows], ["key"]):
            side = lambda k: sorted((q, s, u) for q, s, u, x in zip(g["qty"], g["seq"], g["unit"], g["side"]) if x == k)
            out += [(r, o, "exact", 1.0) for r, o in nearest_pairs(side(0), side(1))]
        return pd.DataFrame(out, columns=names)

    def run(frames):
        held = None
        for f in frames:
            one = f["single"].to_numpy(dtype=bool)
            yield pd.DataFrame({"ref_seq": f["seq"][one], "of_seq": f["after"][one], "layer": "exact", "score": 1.0})
            rows = f[~one] if held is None else pd.concat([held, f[~one]])
            if len(rows):
                # the last key may go on in the next frame
                last = rows["key"].to_numpy() == rows["key"].iloc[-1]
                held = rows[last]
                yield taken(rows[~last])
        if held is not None:
            yield taken(held)

    names = [c.split(" ")[0] for c in PAIRS.split(", ")]
    # a key's first reference row stands for it, as its texts are long
    return both.sortWithinPartitions(*keys).select("key", "single", "seq", "after", "unit", "qty", "side").mapInPandas(run, PAIRS)


class Free:
    """Quantities in order, some of them taken: the nearest that are left on either side of one, by links that skip what is taken."""

    def __init__(self, values: list[float]):
        self.values = values
        self.left, self.right = list(range(-1, len(values))), list(range(len(values) + 1))  # of i: where i - 1, and where i, lead

    def _end(self, links: list[int], i: int) -> int:
        end = i
        while links[end] != end:
            end = links[end]
        while links[i] != end:
            links[i], i = end, links[i]
        return end

    def around(self, q: float) -> tuple[int, int]:
        """Places of the last that is left below q and of the first from q on; -1 and the number of all where there is none."""
        at = bisect_left(self.values, q)
        return self._below(at), self._end(self.right, at)

    def _below(self, at: int) -> int:
        i = at
        while self.left[i] != i - 1:
            i = self.left[i] + 1
        end = i - 1
        i = at
        while self.left[i] != end:
            self.left[i], i = end, self.left[i] + 1
        return end

    def take(self, i: int) -> None:
        self.right[i] = i + 1
        self.left[i + 1] = i - 1


def nearest_pairs(refs: list[tuple], offers: list[tuple]) -> list[tuple[int, int]]:
    """Pairs of ordinals of one key's rows, (quantity, ordinal, unit) in order: each reference row takes the nearest offer row of its unit that is left, or else of any unit.

    Of offer rows as near, units that the reference has come first, then lesser quantities and ordinals. Rows of one
    quantity wait in a queue, and look-ups skip quantities that are used up, so a key of n rows takes about n log n steps.
    """
    units = {u for _, _, u in refs}
    first = [u not in units for _, _, u in offers]
    gone = [False] * len(offers)

    def pool(places: list[int]):
        """Distinct quantities of the rows at these places, in order, and the queues of each: rows of a known unit, and others, last first."""
        values, queues = [], []
        for p in places:
            if not values or values[-1] != offers[p][0]:
                values.append(offers[p][0])
                queues.append(([], []))
            queues[-1][first[p]].append(p)
        for known, others in queues:
            known.reverse()
            others.reverse()
        return Free(values), queues

    def head(queues, i: int) -> int | None:
        """The first row left of a quantity, None without one."""
        for queue in queues[i]:
            while queue and gone[queue[-1]]:
                queue.pop()
            if queue:
                return queue[-1]
        return None

    def best(free: Free, queues, q: float) -> int | None:
        """The nearest row left, None if all are gone. Quantities whose rows all went are taken out as they are met."""
        while True:
            heads = [(i, head(queues, i)) for i in free.around(q) if 0 <= i < len(queues)]
            for i, h in heads:
                if h is None:
                    free.take(i)
            if all(h is not None for _, h in heads):
                return min(heads, key=lambda x: (abs(free.values[x[0]] - q), first[x[1]], x[1]))[1] if heads else None

    by_unit: dict = {}
    for p, (_, _, u) in enumerate(offers):
        by_unit.setdefault(u, []).append(p)
    pools = {u: pool(places) for u, places in by_unit.items() if u in units}
    every, out = None, []
    for q, s, u in refs:
        place = best(*pools[u], q) if u in pools else None
        if place is None:
            every = every or pool(list(range(len(offers))))
            place = best(*every, q)
        if place is None:
            break
        gone[place] = True
        out.append((s, offers[place][1]))
    return out


def normalized_pairs(ref: DataFrame, offer: DataFrame) -> DataFrame:
    """Section and normalized code are equal; of offer codes that share one, those of the first serve. Zipped by quantity."""
    first = offer.groupBy("section", "norm").agg(F.min_by("code", "seq").alias("code"))
    return ordinal_pairs(ref, offer.join(first, ["section", "norm", "code"], "left_semi"), [F.col("section"), F.col("norm")], "normalized")


def variant_pairs(ref: DataFrame, offer: DataFrame) -> DataFrame:
    """The offer's code is the reference's with one digit more."""
    longer = offer.filter(F.col("code").rlike(r"^.+\d$")).withColumn("code", F.expr("substring(code, 1, length(code) - 1)"))
    return ordinal_pairs(ref, longer, [F.col("section"), F.col("code")], "variant")


def _sides(ref: DataFrame, offer: DataFrame, on: list[str]) -> DataFrame:
    name = lambda rows, p: rows.select(*on, *[F.col(c).alias(p + c) for c in ("seq", "code", "norm", "unit", "qty", "denumire", "um") if c not in on])
    return name(ref, "r_").join(name(offer, "o_"), on)


def surplus_pairs(ref: DataFrame, offer: DataFrame, persist=staged) -> DataFrame:
    """Left-over offer rows of a section: a variant digit, or an equal normalized code that is not the code itself, at the same quantity."""
    keyed = lambda rows, keys: rows.withColumn("__k", F.explode(keys))
    r = keyed(ref, F.array(F.concat(F.lit("v"), "code"), F.concat(F.lit("n"), "norm")))
    longer = F.when(F.col("code").rlike(r"^.+\d$"), F.concat(F.lit("v"), F.expr("substring(code, 1, length(code) - 1)")))
    o = keyed(offer, F.array_compact(F.array(longer, F.concat(F.lit("n"), "norm"))))
    c = _sides(r, o, ["section", "__k"]).filter(F.col("__k").startswith("v") | ((F.col("r_code") != F.col("r_norm")) & (F.abs(F.col("r_qty") - F.col("o_qty")) < 0.01)))
    return assigned(c.select("section", F.col("r_seq").alias("ref_seq"), F.col("o_seq").alias("of_seq"), F.lit(1.0).alias("score"), F.lit(True).alias("sure")).distinct(), "surplus", persist)


def cross_section_pairs(ref: DataFrame, offer: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Code, quantity and unit are equal, sections are not. The first offer row of a key serves any number of reference rows."""
    key = [*scope, "code", "qty", "unit"]
    first = offer.groupBy(*key).agg(F.min("seq").alias("of_seq"))
    return ref.join(first, key).select(F.col("seq").alias("ref_seq"), "of_seq", F.lit("cross_section").alias("layer"), F.lit(1.0).alias("score"))


def similar_pairs(ref: DataFrame, offer: DataFrame, least_code: float = 0.80, least_text: float = 0.4, persist=staged) -> DataFrame:
    """Within a section: codes of ratio 0.8 or more, best by 0.6 of that and 0.4 of the descriptions' score, which must reach 0.4 for the best.

    A row whose description's score is too low only matters where it comes before one that is taken. None of less than the
    least score that is taken does, so such pairs are no candidates; most are told from their descriptions alone.
    """
    ship(ref.sparkSession)
    taken = 0.6 * least_code + 0.4 * least_text - 1e-9
    lengths, longer = code_lengths(ref, offer, least_code)
    side = lambda rows, p: rows.select("section", "code", "seq", score_tokens("denumire").alias(p + "t")).withColumnsRenamed({"seq": p + "seq"})
    # a bit for each token: without one in common no token is, and such a pair can't be taken
    bits = lambda rows, p: rows.withColumn(p + "bits", F.aggregate(p + "t", F.lit(0).cast("long"), lambda x, t: x.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(t), F.lit(64))))))
    r, o = bits(side(ref, "r_"), "r_"), bits(side(offer, "o_"), "o_")
    some = F.col("r_bits").bitwiseAND(F.col("o_bits")) != 0 if taken > 0.6 and least_text > 0 else F.lit(True)
    met = []
    if lengths:
        post = lambda rows, k, p: by_rests(rows, lengths, k).withColumnRenamed("code", p + "code")
        met.append(post(r, 0, "r_").join(post(o, 1, "o_"), REST).drop("la", "lb", "rest"))  # a pair may meet twice, which changes nothing
    if longer or not met:
        c = long_candidates(ref, offer, least_code, lengths, persist)
        met.append(c.join(r.withColumnRenamed("code", "r_code"), ["section", "r_code"]).join(o.withColumnRenamed("code", "o_code"), ["section", "o_code"]))
    every = []
    for c in met:
        c = c.filter(some).select("section", "r_seq", "o_seq", "r_code", "o_code", tokens_score("r_t", "o_t").alias("t")).filter((F.col("t") >= least_text) | (0.6 + 0.4 * F.col("t") >= taken))
        c = c.withColumn("cr", code_ratio_from(least_code)("r_code", "o_code")).filter(F.col("cr") >= least_code)
        c = c.select("section", F.col("r_seq").alias("ref_seq"), F.col("o_seq").alias("of_seq"), (0.6 * F.col("cr") + 0.4 * F.col("t")).alias("score"), (F.col("t") >= least_text).alias("sure"))
        every.append(c.filter(F.col("sure") | (F.col("score") >= taken)))
    return assigned(every[0].unionByName(every[1]) if len(every) == 2 else every[0], "similar", persist)


def interval_classes(ref: DataFrame, offer: DataFrame, *members: Column) -> DataFrame:
    """interval_candidates() as pairs of classes: section, unit, r_qty and o_qty that are near enough, with r_n and o_n, the rows of each, and any aggregates of them (r_ and o_ columns).

    All rows of a side with one section, unit and quantity meet the same rows, so they are one class: every row of r_qty is
    a candidate for every one of o_qty, and no pair of rows is made.
    """
    key = ["section", "unit", "qty"]
    side = lambda rows: rows.groupBy(*key).agg(F.count("*").alias("n"), *members)
    return _near(side(ref), side(offer), [c for c in side(ref).columns if c not in ("section", "unit")])


def _near(ref: DataFrame, offer: DataFrame, columns: list[str]) -> DataFrame:
    """section, unit, and r_ and o_ columns of pairs whose quantities are near enough; see interval_candidates()."""
    size = F.floor(F.log(F.abs("qty") + 1) / 0.0102)
    r = ref.filter((F.col("qty") != 0) | (F.col("unit") != "")).withColumn("__s", F.explode(F.array(size - 1, size, size + 1)))
    name = lambda rows, p: rows.select("section", "unit", "__s", *[F.col(c).alias(p + c) for c in columns])
    c = name(r, "r_").join(name(offer.withColumn("__s", size), "o_"), ["section", "unit", "__s"]).drop("__s")
    return c.filter(F.abs(F.col("r_qty") - F.col("o_qty")) <= 0.01 * F.greatest(F.abs("r_qty"), F.abs("o_qty")) + 0.01)


def interval_candidates(ref: DataFrame, offer: DataFrame) -> DataFrame:
    """Pairs of one section and unit whose quantities differ by a hundredth of the larger at most (and 0.01).

    Such quantities, one added, differ by a factor of 1/0.99 at most, so they lie in one class of that width or in two
    neighbouring ones: rows meet over these.
    """
    return _near(ref, offer, ["seq", "code", "norm", "qty", "denumire", "um"])


def interval_pairs(ref: DataFrame, offer: DataFrame, least_text: float = 0.4, persist=staged) -> DataFrame:
    """Candidates of interval_candidates() whose descriptions' score reaches 0.4, best first.

    Rows of one section, unit, quantity and set of tokens are alike, so their classes meet, and no pair of rows is made.
    """
    key = ["section", "unit", "qty", "tokens"]
    cls = lambda rows: persist(rows.select("section", "unit", "qty", F.array_sort(score_tokens("denumire")).alias("tokens"), "seq").withColumn("cls", F.min("seq").over(Window.partitionBy(*key))), "interval-rows")
    r, o = cls(ref), cls(offer)
    one = lambda rows: rows.filter("seq = cls").drop("seq")
    pairs = _near(one(r), one(o), ["qty", "tokens", "cls"]).withColumn("score", tokens_score("r_tokens", "o_tokens")).filter(F.col("score") >= least_text)
    return assigned_classes(r.select("section", "cls", "seq"), o.select("section", "cls", "seq"), pairs, "interval", persist)


def lenient_dollar(extra: DataFrame, ref_all: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Surplus `$` rows whose code and section a reference row without a unit has: they differ by unit only."""
    key = [*scope, "cod", "deviz"]
    first = ref_all.filter(F.col("cod").startswith("$")).groupBy(*key).agg(F.min_by(F.struct(F.col("seq").alias("ref_seq"), F.col("um").alias("ref_um")), "seq").alias("f")).select(*key, "f.*")
    hit = extra.filter(F.col("cod").startswith("$")).join(first, key)
    return hit.filter((text("ref_um") == "") & (text("um") != "")).select("ref_seq", F.col("seq").alias("of_seq"), F.lit("lenient").alias("layer"), F.lit(1.0).alias("score"))


def with_sides(pairs: DataFrame, ref: DataFrame, offer: DataFrame) -> DataFrame:
    """Pairs with ref_ and oferta_ columns of both items."""
    side = lambda rows, p, key: rows.select(F.col("seq").alias(key), *[F.col(c).alias(p + c) for c in rows.columns if c not in ("seq", "section", "code", "norm", "unit", "qty")])
    return pairs.join(side(ref, "ref_", "ref_seq"), "ref_seq").join(side(offer, "oferta_", "of_seq"), "of_seq")


def reconcile(ref_items: DataFrame, offer_items: DataFrame, prices: bool = False, mode: str = "strict", fuzzy: bool = True, suppress: bool = True, persist=staged, provider=None, scope: tuple[str, ...] = (), offers: int = 1) -> tuple[DataFrame, DataFrame]:
    """Matches (ref_seq, of_seq, layer, score) and discrepancies of one offer against the reference, through all layers.

    Both sides have FIELDS and `seq` as long. `persist` keeps a layer's result for the next: a table in the shared folder,
    so that plans stay small and lost executors cost no more than their tasks. A provider is asked last, about what no
    layer matched and whose codes are alike. With `scope` columns, rows meet only within them; reconcile_many() uses it.
    """
    ship(ref_items.sparkSession)
    own = lambda items: whole(items).select("seq", *scope, *FIELDS[1:], *PRICES)
    ref_items = persist(own(ref_items), "ref-items")
    # the exact layer takes most rows, and only what it leaves needs the other keys
    ref, offer = persist(prepare(ref_items, True, scope).drop("norm"), "ref"), persist(prepare(own(offer_items), False, scope).drop("norm"), "offer")
    p = persist(exact_pairs(ref, offer), "pairs")
    keyed = lambda rows, side: persist(rest(rows, p, side).withColumn("norm", normalize_code("cod")), "rest")
    r, o, found = keyed(ref, "ref_seq"), keyed(offer, "of_seq"), [p]
    layers = [normalized_pairs, variant_pairs, lambda r, o: surplus_pairs(r, o, persist), lambda r, o: cross_section_pairs(r, o, scope)]
    late = [lambda r, o: similar_pairs(r, o, persist=persist), lambda r, o: interval_pairs(r, o, persist=persist)] if fuzzy else []
    if provider is not None:
        late.append(lambda r, o: provided_pairs(r, o, provider, persist=persist))
    for i, f in enumerate([*layers, *late]):
        p = persist(f(r, o), "pairs")
        r, o = rest(r, p, "ref_seq"), rest(o, p.select("of_seq").distinct(), "of_seq")
        if late and i == len(layers) - 1:
            r, o = persist(r, "rest"), persist(o, "rest")
        found.append(p)
    pairs = found[0]
    for p in found[1:]:
        pairs = pairs.unionByName(p)
    o = persist(o, "offer-rest")
    if fuzzy and suppress:
        gone = suppressed_extras(o, ref, persist=persist)
        gone = persist(gone.withColumn("ref_seq", F.col("ref_seq") - F.pmod("ref_seq", F.lit(offers)) + F.pmod("of_seq", F.lit(offers))), "suppressed")
        pairs = pairs.unionByName(gone.select("ref_seq", "of_seq", F.lit("suppressed").alias("layer"), "score"))
        o = rest(o, gone, "of_seq")
    components = ref_items.filter(F.coalesce("is_component", F.lit(False))).select(normalize_code("cod").alias("norm")).distinct()
    o = o.join(components, "norm", "left_anti")
    dollar = lenient_dollar(o, ref_items, scope)
    pairs = persist(pairs.unionByName(dollar), "pairs")
    o = o.join(pairs.filter("layer = 'lenient'").select(F.col("of_seq").alias("seq")), "seq", "left_anti")
    return pairs, discrepancies(pairs, ref_items, offer, r, o, prices, mode)


def reconcile_many(ref_items: DataFrame, offer_items: DataFrame, persist=staged, **options) -> tuple[DataFrame, DataFrame]:
    """Pairs and discrepancies, with offer_nr, of all offers (offer_items with offer_nr) against one reference, in one plan: what reconcile() gives for each.

    The number of jobs does not depend on the number of offers. Every offer meets a reference of its own, whose ordinals
    are numbered so that ties fall as for one offer alone; ordinals times offers must fit in 63 bits.
    """
    numbers = sorted(r.offer_nr for r in offer_items.select("offer_nr").distinct().collect())  # a number an offer
    n = max(1, len(numbers))
    most = max((x.agg(F.max("seq")).first()[0] or 0) for x in (ref_items, offer_items))
    if most * n >= 1 << 62:
        raise ValueError("renumber the items: ordinals times offers must fit in 63 bits")
    rank = F.array_position(F.array(*[F.lit(x) for x in numbers]) if numbers else F.array(F.lit(0)), F.col("offer_nr")) - 1
    numbered = lambda rows: rows.withColumn("seq", F.col("seq") * n + rank)
    every = ref_items.withColumn("offer_nr", F.explode(F.array(*[F.lit(x) for x in numbers]) if numbers else F.array().cast("array<int>")))
    pairs, rows = reconcile(numbered(every), numbered(offer_items), persist=persist, scope=("offer_nr",), offers=n, **options)
    nr = F.element_at(F.array(*[F.lit(x) for x in numbers]) if numbers else F.array(F.lit(0)), (F.pmod(F.coalesce("ref_seq", "of_seq"), F.lit(n)) + 1).cast("int"))
    back = lambda x: x.withColumn("offer_nr", nr).withColumns({c: F.expr(f"{c} div {n}") for c in ("ref_seq", "of_seq")})
    return back(pairs), back(rows)


def discrepancies(pairs: DataFrame, ref_items: DataFrame, offer_items: DataFrame, missing: DataFrame, surplus: DataFrame, prices: bool = False, mode: str = "strict") -> DataFrame:
    """What is wrong with matched pairs, and the items that one side has alone: CONTEXT, tip, camp, ref, oferta, calculat, declarat.

    Pairs found by their key or a variant of it (EARLY) also have their arithmetic checked where prices count; a code that
    differs is a discrepancy only beside another one. Pairs across sections differ by section, `lenient` ones by unit only.
    """
    both = with_sides(pairs.filter("layer <> 'suppressed'"), ref_items.select(*FIELDS, *PRICES), offer_items.select(*FIELDS, *PRICES))
    both = both.withColumns({"deviz_denumire": F.col("ref_deviz_denumire"), "is_component": F.coalesce("ref_is_component", F.lit(False))})
    d = diffs(prices=prices)
    if mode == "lenient":
        d = lenient(d, F.col("oferta_is_component"), F.col("oferta_cantitate"), F.col("oferta_um"))
    none = F.lit(None).cast("double")
    kind = "array<struct<tip:string,camp:string,ref:double,oferta:double,calculat:double,declarat:double>>"
    plain = F.transform(d, lambda x: F.struct(x["tip"], x["camp"], x["ref"], x["oferta"], none, none)).cast(kind)
    plain = F.when(F.col("layer") == "cross_section", F.array().cast(kind)).when(F.col("layer") == "lenient", F.filter(plain, lambda x: x["tip"] == "UM_DIFERIT")).otherwise(plain)
    if prices:
        wrong = F.transform(arithmetic("oferta_"), lambda x: F.struct(F.lit("EROARE_ARITMETICA"), x["camp"], none, none, x["calculat"], x["declarat"])).cast(kind)
        plain = F.concat(plain, F.when(F.col("layer").isin(*EARLY), wrong).otherwise(F.array().cast(kind)))
    other = lambda tip, camp: F.array(F.struct(F.lit(tip), F.lit(camp), none, none, none, none)).cast(kind)
    coded = (clean_code("ref_cod") != clean_code("oferta_cod")) & (F.size("d") > 0)
    every = F.concat("d", F.when(coded, other("COD_SIMILAR", "cod")).otherwise(F.array().cast(kind)), F.when(F.col("layer") == "cross_section", other("DEVIZ_MISMATCH", "deviz")).otherwise(F.array().cast(kind)))
    fields = both.withColumn("d", plain).withColumn("x", F.explode(every)).select(*CONTEXT, "x.*")
    gap = lambda rows, here, tip: rows.select(*[_side(c, here) for c in CONTEXT], F.lit(tip).alias("tip"), F.lit(None).cast("string").alias("camp"), *[none.alias(c) for c in ("ref", "oferta", "calculat", "declarat")])
    return fields.unionByName(gap(missing, "ref", "ARTICOL_LIPSA")).unionByName(gap(surplus, "oferta", "ARTICOL_EXTRA"))


def arithmetic_of(pairs: DataFrame, offer_items: DataFrame) -> DataFrame:
    """ref_seq, of_seq, tip, camp, calculat and declarat: the arithmetic that discrepancies() finds wrong, of which the offer's items alone tell, so no more of either side is read."""
    wrong = arithmetic_errors(offer_items, ["seq"]).withColumnRenamed("seq", "of_seq")
    return pairs.filter(F.col("layer").isin(*EARLY)).select("ref_seq", "of_seq").join(wrong, "of_seq").select("ref_seq", "of_seq", "tip", "camp", "calculat", "declarat")


def _side(name: str, here: str) -> Column:
    """A context column for a row that only one side has."""
    if name == "layer":
        return F.lit("none").alias(name)
    if name in ("ref_seq", "of_seq"):
        return (F.col("seq") if (name == "ref_seq") == (here == "ref") else F.lit(None).cast("long")).alias(name)
    if name == "deviz_denumire":
        return (F.col(name) if here == "ref" else programme_name(name)).alias(name)
    if name == "is_component":
        return F.coalesce(name, F.lit(False)).alias(name)
    side, _, field = name.partition("_")
    kind = "double" if field == "cantitate" or field in PRICES else "string"
    if side != here:
        return F.lit(None).cast(kind).alias(name)
    return F.col(field).alias(name)


def final_discrepancies(every: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """The discrepancies after the dedup by (ref_cod, oferta_cod)."""
    return dedup_discrepancies(every, [F.coalesce("ref_seq", F.lit(1 << 62)), F.coalesce("of_seq", F.lit(1 << 62)), field_rank()], scope)


def provided_pairs(ref: DataFrame, offer: DataFrame, provider, least: float = 0.75, persist=staged) -> DataFrame:
    """What the provider matches, 50 reference rows a call: each is shown with the offer rows of its section whose code ratio reaches `least`."""
    from .providers import ask

    shown = similar_codes(ref, offer, least, persist).groupBy("section", "r_seq", "r_code", "r_denumire").agg(F.to_json(F.sort_array(F.collect_list(F.struct(F.col("o_seq").alias("of_seq"), F.col("o_code").alias("cod"), F.substring("o_denumire", 1, 40).alias("denumire"))))).alias("candidates"))
    told = ask(shown, "fuzzy_items", provider).filter("answer_of_seq is not null")
    free = offer.select(F.col("seq").alias("answer_of_seq"), "section")
    told = told.join(free, ["answer_of_seq", "section"], "left_semi")
    return assigned(told.select(F.col("r_seq").alias("ref_seq"), F.col("answer_of_seq").alias("of_seq"), F.coalesce("answer_score", F.lit(1.0)).alias("score"), F.lit(True).alias("sure")), "provider", persist)


def code_similarity_candidates(ref: DataFrame, offer: DataFrame, least: float = 0.75) -> DataFrame:
    """ref rows with any offer row of their section whose code ratio reaches `least`: what a provider is asked about."""
    c = similar_codes(ref, offer, least)
    return ref.join(c.select(F.col("r_seq").alias("seq")).distinct(), "seq", "left_semi")
