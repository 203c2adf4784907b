"""Similarity joins: codes by a prefix filter over their character pairs, descriptions by bounds of their ratio."""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import text
from ..functions.similarity import code_ratio_from, main_words, name_ratio_of
from ..session import ship, staged
from .runs import runs

#: Lengths for which the least number of shared pairs is a table; longer codes post all their pairs.
TABLED = 48


def matched(a: int, b: int, least: float) -> int:
    """Characters that two codes of these lengths must match, in order, for a ratio of `least`."""
    return math.ceil(least * (a + b) / 2 - 1e-9)


def shared_grams(a: int, b: int, least: float, size: int) -> int:
    """How many single characters (size 1) or pairs of neighbours (size 2) such codes share at least.

    Of m characters matched in order, m - 1 pairs follow each other, and each of the a - m and b - m characters left out
    parts one of them at most.
    """
    m = matched(a, b, least)
    return m if size == 1 else m - 1 - (a - m) - (b - m)


def reachable(a: int, b: int, least: float) -> bool:
    return matched(a, b, least) <= min(a, b)


def _grams(size: int) -> str:
    """The pairs (or characters) of column b, numbered where one occurs again, so that sets of them share what multisets do."""
    return f"transform(sequence(1, length(b) - {size - 1}), i -> concat(substring(b, i, {size}), ' ', size(filter(sequence(1, i), j -> substring(b, j, {size}) = substring(b, i, {size})))))"


def _least_shared(least: float, size: int) -> str:
    """SQL for shared_grams() of columns la and lb."""
    m = f"cast(ceil({least} * (la + lb) / 2 - 1e-9) as int)"
    return m if size == 1 else f"(3 * {m} - 1 - la - lb)"


#: Where rests of codes meet.
REST = ["section", "la", "lb", "rest"]
#: Rests of one code (what is left without some of its characters) up to which codes of two lengths meet over them.
RESTS = 100


def met_by_rest(a: int, b: int, least: float) -> bool:
    """Whether codes of these lengths meet over what is left of them: m characters matched in order are a rest of both."""
    m = matched(a, b, least)
    return 1 <= m <= min(a, b) and max(math.comb(a, m), math.comb(b, m)) <= RESTS


def _rests(out: int) -> str:
    """The distinct rests of column b without `out` of its characters."""
    rests = "array(b)"
    for _ in range(out):
        rests = f"array_distinct(flatten(transform({rests}, v -> transform(sequence(1, length(v)), i -> concat(substring(v, 1, i - 1), substring(v, i + 1))))))"
    return rests


def code_lengths(ref: DataFrame, offer: DataFrame, least: float) -> tuple[list[tuple[int, int, int]], bool]:
    """Lengths (of the reference's code, the offer's, characters to match) whose codes meet over their rests, and whether others can have a ratio of `least`, too."""
    length = lambda rows, side: rows.select(F.lit(side).alias("side"), F.length(F.translate("code", "#$@ ", "")).alias("n"))
    found = length(ref, 0).union(length(offer, 1)).filter("n > 0").distinct().collect()  # a row a length
    pairs = [(a.n, b.n) for a in found for b in found if a.side == 0 and b.side == 1 and reachable(a.n, b.n, least)]
    short = sorted((a, b, matched(a, b, least)) for a, b in pairs if met_by_rest(a, b, least))
    return short, len(short) < len(pairs)


def by_rests(rows: DataFrame, lengths: list[tuple[int, int, int]], side: int) -> DataFrame:
    """rows (with code), once for each rest that codes of the other side may have, with la, lb and rest.

    Codes of ratio `least` match enough characters in order, so these are a rest of both: an equi-join over section, la, lb
    and rest misses no pair, and makes few that don't have the ratio, however many codes begin alike.
    """
    fits = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("la", "lb", "m"), x)]) for x in lengths])
    own = F.filter(fits, lambda x: x["la" if side == 0 else "lb"] == F.length("b"))
    rows = rows.withColumn("b", F.translate("code", "#$@ ", "")).filter("b <> ''").withColumn("__f", F.explode(own))
    most = max(x[side] - x[2] for x in lengths)
    rests = " ".join(f"WHEN {n} THEN {_rests(n)}" for n in range(most + 1))
    return rows.select("*", "__f.la", "__f.lb", F.explode(F.expr(f"CASE length(b) - __f.m {rests} END")).alias("rest")).drop("b", "__f")


def code_candidates(ref: DataFrame, offer: DataFrame, least: float, persist=staged) -> DataFrame:
    """section, r_code and o_code: distinct codes of one section that may have a ratio of `least`; none that has is missing.

    Codes of few rests meet over these (by_rests), longer ones over their grams (long_candidates).
    """
    lengths, longer = code_lengths(ref, offer, least)
    out = []
    if lengths:
        side = lambda rows, k: by_rests(rows.select("section", "code").distinct(), lengths, k).withColumnRenamed("code", "ro"[k] + "_code")
        out.append(side(ref, 0).join(side(offer, 1), REST).select("section", "r_code", "o_code").distinct())
    if longer or not out:
        out.append(long_candidates(ref, offer, least, lengths, persist))
    return out[0].union(out[1]) if len(out) == 2 else out[0]


def long_candidates(ref: DataFrame, offer: DataFrame, least: float, met: list[tuple[int, int, int]], persist=staged) -> DataFrame:
    """code_candidates() of codes whose lengths are none of `met`.

    A pair must share T grams (shared_grams), so it shares one among the n - T + 1 rarest of each in any common order. Codes
    post these, rarest in the section first, once for each length that the other side has; so signs that all codes have
    in common are hardly ever posted. A pair is taken where its first common gram meets, if enough may follow (position),
    if it shares T grams, and if it shares enough characters. Pairs of neighbours serve where T is at least 1, single
    characters for the shortest codes.
    """
    own = lambda rows, side: rows.select("section", "code", F.translate("code", "#$@ ", "").alias("b")).distinct().filter("b <> ''").select("section", F.lit(side).alias("side"), "code", "b")
    codes = own(ref, 0).union(own(offer, 1)).withColumns({"la": F.length("b"), "chars": F.expr(_grams(1)), "pairs": F.expr(f"CASE WHEN length(b) > 1 THEN {_grams(2)} ELSE array() END")})
    codes = persist(codes, "codes")
    lengths = codes.groupBy("section", "side").agg(F.collect_set("la").alias("others")).select("section", (1 - F.col("side")).alias("side"), "others")
    some = codes.join(F.broadcast(lengths) if lengths.limit(10_001).count() <= 10_000 else lengths, ["section", "side"])
    done = F.lit(False)
    for a, b, _ in met:
        done = done | F.when(F.col("side") == 0, (F.col("la") == a) & (F.col("lb") == b)).otherwise((F.col("la") == b) & (F.col("lb") == a))
    posted = []
    for size, col in ((2, "pairs"), (1, "chars")):
        t = _least_shared(least, size)
        want = f"{t} >= 1" if size == 2 else f"{_least_shared(least, 2)} < 1"
        fits = some.withColumn("lb", F.explode("others")).filter(f"{_least_shared(least, 1)} <= least(la, lb) AND {want}").filter(~done)
        # rare first: how many codes of the section, on either side, have the gram
        rare = codes.select("section", F.explode(col).alias("gram")).groupBy("section", "gram").agg(F.count("*").alias("n"))
        sorted_ = codes.select("section", "side", "code", "la", F.explode(col).alias("gram")).join(rare, ["section", "gram"]).groupBy("section", "side", "code").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "gram"))), lambda x: x["gram"]).alias("grams"))
        post = fits.select("section", "side", "code", "la", "lb", "chars").join(sorted_, ["section", "side", "code"])
        post = post.select("*", F.posexplode(F.expr(f"slice(grams, 1, greatest(0, size(grams) - {t} + 1))")).alias("at", "gram"))
        r = post.filter("side = 0").select("section", F.col("code").alias("r_code"), "la", "lb", "gram", F.col("at").alias("ra"), F.col("grams").alias("rg"), F.col("chars").alias("rc"))
        o = post.filter("side = 1").select("section", F.col("code").alias("o_code"), F.col("la").alias("lb"), F.col("lb").alias("la"), "gram", F.col("at").alias("oa"), F.col("grams").alias("og"), F.col("chars").alias("oc"))
        met = r.join(o, ["section", "la", "lb", "gram"]).filter(f"least(size(rg) - ra, size(og) - oa) >= {t}")
        met = met.withColumn("both", F.array_intersect("rg", "og")).filter(f"element_at(both, 1) = gram AND size(both) >= {t} AND size(array_intersect(rc, oc)) >= {_least_shared(least, 1)}")
        posted.append(met.select("section", "r_code", "o_code"))
    return posted[0].union(posted[1])


def similar_codes(ref: DataFrame, offer: DataFrame, least: float, persist=staged) -> DataFrame:
    """Pairs of a section (r_ and o_ columns) with cr, the ratio of their codes, where it reaches `least`."""
    ship(ref.sparkSession)
    met = code_candidates(ref, offer, least, persist).withColumn("cr", code_ratio_from(least)("r_code", "o_code")).filter(F.col("cr") >= least)
    name = lambda rows, p: rows.select("section", *[F.col(c).alias(p + c) for c in ("seq", "code", "norm", "unit", "qty", "denumire", "um")])
    return met.join(name(ref, "r_"), ["section", "r_code"]).join(name(offer, "o_"), ["section", "o_code"])


#: Descriptions of a block of references and of a chunk of queries, and kinds of characters that a histogram tells apart (others share the last).
BLOCK, CHUNK, KINDS = 20_000, 4_000, 64


def histograms(texts: list[str], kinds: dict[str, int]) -> np.ndarray:
    """How often each kind of character occurs in each text, up to 65,535."""
    out = np.zeros((len(texts), KINDS), np.uint16)
    for i, t in enumerate(texts):
        at = np.fromiter((kinds.get(c, KINDS - 1) for c in t), np.int64, len(t))
        out[i] = np.minimum(np.bincount(at, minlength=KINDS), 65_535)
    return out


def best_of_block(queries: list[str], refs: list[str], seqs: list[int], least: float) -> Iterator[tuple[str, int, float, int]]:
    """(query, seq, ratio, ratios computed) of the reference of highest ratio, `least` at the least, then of least seq.

    The ratio is at most twice the characters in common over both lengths. References are tried in falling order of that
    bound, and those whose bound does not reach the best ratio so far are not compared.
    """
    bounds, seq = Bounds(refs), np.array(seqs, np.int64)
    for q in queries:
        bound = bounds.of(q)
        best, found, asked = least, None, 0
        for i in np.lexsort((seq, -bound)).tolist():
            if bound[i] < best - 1e-12:
                break
            if found is not None and bound[i] <= best + 1e-12 and seq[i] > found:
                continue
            asked += 1
            ratio = SequenceMatcher(None, q, refs[i]).ratio()
            if ratio > best or (ratio == best and (found is None or seq[i] < found)):
                best, found = ratio, int(seq[i])
        if found is not None:
            yield q, found, best, asked


def _frequencies(texts: list[str]) -> dict[str, int]:
    n: dict[str, int] = {}
    for t in texts:
        for c in t:
            n[c] = n.get(c, 0) + 1
    return n


def in_blocks(queries: DataFrame, refs: DataFrame, meet, schema: str) -> DataFrame:
    """What meet(queries, refs) yields as rows of a schema, for blocks of refs and chunks of queries of bounded size, columns as lists.

    Queries are a stated set; every query meets every row of refs once. Rows are dealt by their column d.
    """
    ship(queries.sparkSession)
    blocks, chunks = (max(1, math.ceil(n / size)) for n, size in ((refs.count(), BLOCK), (queries.count(), CHUNK)))
    own = lambda n: F.pmod(F.xxhash64("d"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    r = refs.select(own(blocks).alias("block"), every(chunks).alias("chunk"), F.lit(0).alias("side"), "d", *[c for c in refs.columns if c != "d"])
    q = queries.select(every(blocks).alias("block"), own(chunks).alias("chunk"), F.lit(1).alias("side"), "d", *[c for c in queries.columns if c != "d"])
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(frames):
        for g in runs(frames, ["block", "chunk"]):
            one, two = ({c: [v[i] for i, x in enumerate(g["side"]) if x == k] for c, v in g.items()} for k in (0, 1))
            if one["d"] and two["d"]:
                yield pd.DataFrame(meet(two, one), columns=names)

    both = r.unionByName(q, allowMissingColumns=True)
    return both.repartition("block", "chunk").sortWithinPartitions("block", "chunk", "side", "d").mapInPandas(run, schema)


def best_descriptions(queries: DataFrame, refs: DataFrame, least: float, persist=staged) -> DataFrame:
    """d, ref_seq, score and asked: for each distinct description of queries (d) the one of refs (d, seq) of highest ratio, if `least`; of several the least seq.

    Equal descriptions are an equi-join. The others are compared with all distinct descriptions of refs in blocks; `asked`
    counts the ratios computed for each, which are few beside the descriptions: see best_of_block().
    """
    r = persist(refs.groupBy("d").agg(F.min("seq").alias("seq")), "descriptions")
    q = queries.select("d").distinct()
    equal = q.join(r, "d").select("d", F.col("seq").alias("ref_seq"), F.lit(1.0).alias("score"), F.lit(0).cast("long").alias("asked"))
    rest = persist(q.join(r, "d", "left_anti"), "descriptions-open")
    near = in_blocks(rest, r, lambda q, r: best_of_block(q["d"], r["d"], [int(x) for x in r["seq"]], least), "d string, ref_seq long, score double, asked long")
    best = near.groupBy("d").agg(F.max(F.struct("score", (-F.col("ref_seq")).alias("s"))).alias("b"), F.sum("asked").alias("asked"))
    return equal.union(best.select("d", (-F.col("b.s")).alias("ref_seq"), F.col("b.score").alias("score"), "asked"))


class Bounds:
    """Upper bounds of the ratio of a text with each text of a block, from their characters."""

    def __init__(self, refs: list[str]):
        self.kinds = {c: i for i, (c, _) in enumerate(sorted(_frequencies(refs).items(), key=lambda x: (-x[1], x[0]))[: KINDS - 1])}
        self.h, self.size = histograms(refs, self.kinds), np.array([len(r) for r in refs], np.int64)

    def of(self, text: str) -> np.ndarray:
        own = histograms([text], self.kinds)[0]
        used = np.flatnonzero(own)
        return np.where(len(text) > 65_535, 1.0, 2 * np.minimum(self.h[:, used], own[used]).sum(axis=1, dtype=np.int64) / np.maximum(1, self.size + len(text)))


def names_of_block(texts: list[str], names: list[str], least: float) -> Iterator[tuple[str, str, str, float]]:
    """(text, name, kind, score) of the names that fit each text: equal 1.0, contained in a longer text 0.85 (all names are looked for at once by an automaton), a ratio of `least` or more."""
    from ahocorasick import Automaton

    found = Automaton()
    for i, n in enumerate(names):
        if n:
            found.add_word(n, i)
    if len(found):
        found.make_automaton()
    bounds = Bounds(names)
    for t in texts:
        inside = {i for _, i in found.iter(t)} if len(found) else set()
        for i in sorted(inside):
            yield t, names[i], *(("exact", 1.0) if names[i] == t else ("substring", 0.85))
        for i in np.flatnonzero(bounds.of(t) >= least - 1e-12).tolist():
            if i not in inside:
                ratio = SequenceMatcher(None, t, names[i]).ratio()
                if ratio >= least:
                    yield t, names[i], "fuzzy", ratio


def names_in(texts: DataFrame, names: DataFrame, least: float = 0.65) -> DataFrame:
    """d (a text), t (a name), kind and score for every distinct text (d) and name (d) that fit: see names_of_block()."""
    return in_blocks(texts.distinct(), names.distinct(), lambda q, r: names_of_block(q["d"], r["d"], least), "d string, t string, kind string, score double")


def best_names_of_block(asks: dict, refs: dict) -> Iterator[tuple]:
    """(offer_deviz, ref_deviz, score, first, word_deviz, word_first): the section of best name ratio, and the first whose name holds the word."""
    names, order = refs["d"], sorted(range(len(refs["d"])), key=lambda i: (refs["first"][i], refs["ref_deviz"][i]))
    full, main = Bounds(names), Bounds([main_words(n) for n in names])
    for deviz, name, word in zip(asks["offer_deviz"], asks["d"], asks["word"]):
        bound = np.maximum(main.of(main_words(name)), 0.8 * full.of(name))
        best, at = 0.0, None
        for i in order:
            if bound[i] > best - 1e-12:
                ratio = name_ratio_of(name, names[i])
                if ratio > best:
                    best, at = ratio, i
        holds = next((i for i in order if word and word in names[i]), None)
        yield deviz, None if at is None else refs["ref_deviz"][at], best, None if at is None else int(refs["first"][at]), None if holds is None else refs["ref_deviz"][holds], None if holds is None else int(refs["first"][holds])


def best_names(asks: DataFrame, refs: DataFrame) -> DataFrame:
    """offer_deviz, ref_deviz, score and word_deviz for sections (offer_deviz, d: the name, word) against (ref_deviz, d, first); of equal scores the section that begins first."""
    told = in_blocks(asks, refs, best_names_of_block, "offer_deviz string, ref_deviz string, score double, first long, word_deviz string, word_first long")
    place = F.struct("score", (-F.col("first")).alias("f"))
    return told.groupBy("offer_deviz").agg(F.max_by("ref_deviz", F.when(F.col("ref_deviz").isNotNull(), place)).alias("ref_deviz"), F.max("score").alias("score"), F.min_by("word_deviz", F.when(F.col("word_deviz").isNotNull(), F.struct("word_first", "word_deviz"))).alias("word_deviz"))


def suppressed_extras(extra: DataFrame, ref: DataFrame, least: float = 0.45, persist=staged) -> DataFrame:
    """of_seq, ref_seq and score of surplus rows whose description has a ratio of `least` with any reference description: the best."""
    d = lambda rows: rows.select(F.lower(text("denumire")).alias("d"), "seq").filter("length(d) >= 3")
    rows = d(extra)
    return rows.join(best_descriptions(rows, d(ref), least, persist), "d").select(F.col("seq").alias("of_seq"), "ref_seq", "score")
