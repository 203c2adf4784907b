"""Components of a graph of links, and greedy assignment over candidate pairs by component."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged

PAIRS = "ref_seq long, of_seq long, layer string, score double"
#: Candidate pairs up to which one sorted partition is read; more are split by the components of their graph. Both give the same pairs.
ONE_PARTITION = 2_000_000


def components(edges: DataFrame, persist=staged) -> DataFrame:
    """u and v: each node but the least of its component, and that least. Edges (u, v) may be in any order.

    Large-star steps tie every larger neighbour of a node to its least neighbour, small-star steps every smaller one;
    stars are left when nothing changes. Each step is a table in the shared folder.
    """
    edges = persist(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    before = None
    while True:
        mark = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before or not mark[0]:
            return edges
        before = mark
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = persist(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "components")
        large = persist(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct(), "components")
        low = persist(large.groupBy("u").agg(F.min("v").alias("m")), "components")
        pairs = large.join(low, "u")
        edges = persist(pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), "components")


def in_turn(rows: DataFrame, layer: str) -> DataFrame:
    """PAIRS from candidates (part, ref_seq, of_seq, score, sure) whose partitions are sorted by part, ref_seq, falling score and of_seq.

    Every reference row in its turn takes its best offer row that is left; where that one isn't sure, it takes none.
    Rows are streamed: a task holds the offer rows that one part has used.
    """

    def run(frames):
        part, ref, used = None, None, set()
        for f in frames:
            out = []
            for p, r, o, s, sure in zip(f["part"].tolist(), f["ref_seq"].tolist(), f["of_seq"].tolist(), f["score"].tolist(), f["sure"].tolist()):
                if p != part:
                    part, ref, used = p, None, set()
                if r != ref and o not in used:
                    ref = r
                    if sure:
                        used.add(o)
                        out.append((r, o, layer, s))
            yield pd.DataFrame(out, columns=["ref_seq", "of_seq", "layer", "score"])

    return rows.mapInPandas(run, PAIRS)


def assigned(candidates: DataFrame, layer: str, persist=staged) -> DataFrame:
    """PAIRS that greedy choice makes of candidates (section, ref_seq, of_seq, score, sure), reference rows in order: see in_turn().

    Rows of different sections, or of different components of the candidates' graph, can't take anything from each other.
    So many candidates are dealt out by section, and those of a section that has too many by component. Without a section
    all are of one.
    """
    if "section" not in candidates.columns:
        candidates = candidates.withColumn("section", F.lit(""))
    edges = persist(candidates.select("section", "ref_seq", "of_seq", "score", "sure"), layer + "-candidates")
    order = ["ref_seq", F.desc("score"), "of_seq"]
    if edges.limit(ONE_PARTITION + 1).count() <= ONE_PARTITION:
        return in_turn(edges.withColumn("part", F.lit(0).cast("long")).coalesce(1).sortWithinPartitions(*order), layer)
    # parts whose numbers are equal by chance are read as one, which takes nothing from either
    rows = edges.withColumn("part", F.xxhash64("section"))
    large = persist(edges.groupBy("section").agg(F.count("*").alias("n")).filter(F.col("n") > ONE_PARTITION).select("section"), "large-sections")
    if not large.isEmpty():
        many = edges.join(large, "section", "left_semi")
        # reference rows that share an offer row hang together, so the first of those stands for all of them
        tied = many.join(many.groupBy("of_seq").agg(F.min("ref_seq").alias("v")), "of_seq").select(F.col("ref_seq").alias("u"), "v")
        root = components(tied, persist).select(F.col("u").alias("ref_seq"), F.col("v").alias("root"))
        many = many.join(root, "ref_seq", "left").withColumn("part", F.coalesce("root", "ref_seq")).select(*rows.columns)
        rows = rows.join(large, "section", "left_anti").select(*rows.columns).unionByName(many)
    return in_turn(rows.repartition("part").sortWithinPartitions("part", *order), layer)


def in_turn_by_class(rows: DataFrame, layer: str) -> DataFrame:
    """What in_turn() makes of all pairs of rows, without them: rows (part, side, ref_seq, cls, score, of_seq) are sorted by part, side and ref_seq, then falling of_seq.

    Offer rows (side 0: their class and of_seq) come before reference rows (side 1: once for each class that they may take
    from). Rows of one class are alike to every reference row, so the least that is left serves. A task holds the offer
    rows of one part.
    """
    names = [c.split(" ")[0] for c in PAIRS.split(", ")]

    def run(frames):
        part, ref, best, queues, out = None, None, None, {}, []
        for f in frames:
            for p, side, r, c, s, o in zip(*(f[x].tolist() for x in ("part", "side", "ref_seq", "cls", "score", "of_seq"))):
                if best is not None and (p != part or r != ref):
                    out.append((ref, queues[best[2]].pop(), layer, -best[0]))
                    best = None
                if p != part:
                    part, queues = p, {}
                ref = r
                if side == 0:
                    queues.setdefault(c, []).append(o)
                elif queues.get(c):
                    found = (-s, queues[c][-1], c)
                    best = found if best is None else min(best, found)
            yield pd.DataFrame(out, columns=names)
            out = []
        if best is not None:
            yield pd.DataFrame([(ref, queues[best[2]].pop(), layer, -best[0])], columns=names)

    return rows.mapInPandas(run, PAIRS)


def assigned_classes(ref: DataFrame, offer: DataFrame, pairs: DataFrame, layer: str, persist=staged) -> DataFrame:
    """PAIRS that greedy choice makes of all rows of classes that are paired, reference rows in order: ref and offer have section, cls and seq, pairs section, r_cls, o_cls and score.

    Classes of a side have numbers of their own. As in assigned(), rows are dealt out by section, and those of a section
    with too many candidates by the components of the classes' graph.
    """
    pairs = persist(pairs.select("section", "r_cls", "o_cls", "score"), layer + "-candidates")
    n = ref.groupBy(F.col("cls").alias("r_cls")).agg(F.count("*").alias("n"))
    large = persist(pairs.join(n, "r_cls").groupBy("section").agg(F.sum("n").alias("n")).filter(F.col("n") > ONE_PARTITION).select("section"), "large-sections")
    pairs = pairs.withColumn("part", F.xxhash64("section"))
    if not large.isEmpty():
        many = pairs.join(large, "section", "left_semi")
        tied = many.join(many.groupBy("o_cls").agg(F.min("r_cls").alias("v")), "o_cls").select(F.col("r_cls").alias("u"), "v")
        root = components(tied, persist).select(F.col("u").alias("r_cls"), F.col("v").alias("root"))
        many = many.join(root, "r_cls", "left").withColumn("part", F.coalesce("root", "r_cls")).select(*pairs.columns)
        pairs = persist(pairs.join(large, "section", "left_anti").select(*pairs.columns).unionByName(many), "class-parts")
    zero = F.lit(0).cast("long")
    own = offer.select(F.col("cls").alias("o_cls"), F.col("seq").alias("of_seq")).join(pairs.select("part", "o_cls").distinct(), "o_cls")
    own = own.select("part", F.lit(0).alias("side"), zero.alias("ref_seq"), F.col("o_cls").alias("cls"), F.lit(0.0).alias("score"), "of_seq")
    takers = ref.select(F.col("cls").alias("r_cls"), F.col("seq").alias("ref_seq")).join(pairs, "r_cls")
    takers = takers.select("part", F.lit(1).alias("side"), "ref_seq", F.col("o_cls").alias("cls"), "score", zero.alias("of_seq"))
    return in_turn_by_class(own.unionByName(takers).repartition("part").sortWithinPartitions("part", "side", "ref_seq", F.desc("of_seq")), layer)
