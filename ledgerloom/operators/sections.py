"""Sections: names, mappings between documents, equivalence, orphans, corrections, code patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import clean_code, section_name_key, section_prefix, strip_section_prefix, text
from ..functions.similarity import word_overlap
from .alike import best_names, names_in


def names(items: DataFrame) -> DataFrame:
    """deviz, n and the distinct lower-cased names of each section, sorted."""
    n = F.lower(text("deviz_denumire"))
    return items.filter(text("deviz") != "").groupBy("deviz").agg(F.array_sort(F.collect_set(F.when(n != "", n))).alias("texts"), F.count("*").alias("n"))


def first_names(items: DataFrame, order: str = "seq") -> DataFrame:
    """deviz, its first name that isn't empty, its number of rows, and where it begins."""
    named = F.when(text("deviz_denumire") != "", F.col(order))
    return items.filter(text("deviz") != "").groupBy("deviz").agg(F.min_by("deviz_denumire", named).alias("denumire"), F.count("*").alias("n"), F.min(order).alias("first"))


def last_names(items: DataFrame, order: str = "seq") -> DataFrame:
    return items.filter(text("deviz") != "").groupBy("deviz").agg(F.max_by("deviz_denumire", order).alias("denumire"))


def canonical_names(items: DataFrame, order: str = "seq") -> DataFrame:
    """deviz and its shortest name; of several that short the most frequent, then the first seen."""
    per = items.filter((text("deviz") != "") & (text("deviz_denumire") != "")).groupBy("deviz", F.trim("deviz_denumire").alias("denumire")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    w = Window.partitionBy("deviz").orderBy(F.length("denumire"), F.col("n").desc(), "first")
    return per.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select("deviz", "denumire")


def fill_names(items: DataFrame, order: str = "seq") -> DataFrame:
    """items whose empty section names are filled with the canonical one."""
    c = canonical_names(items, order).withColumnRenamed("denumire", "__name")
    return items.join(c, "deviz", "left").withColumn("deviz_denumire", F.when(text("deviz_denumire") == "", F.coalesce("__name", "deviz_denumire")).otherwise(F.col("deviz_denumire"))).select(*items.columns)


def lookup_text(queries: DataFrame, catalog: DataFrame, least: float = 0.65) -> DataFrame:
    """q, deviz, kind and score of every section whose name fits a text: exact 1.0, contained in a longer text 0.85, else a ratio of 0.65 or more.

    queries has q; catalog is names(). Distinct texts meet distinct names in blocks: see alike.names_in().
    """
    t = catalog.select("deviz", F.explode("texts").alias("t"))
    q = queries.select("q", F.lower(text("q")).alias("low")).filter("low <> ''").distinct()
    c = q.join(names_in(q.select(F.col("low").alias("d")), t.select(F.col("t").alias("d")), least).withColumnRenamed("d", "low"), "low").join(t, "t")
    best = Window.partitionBy("q", "deviz").orderBy(F.col("score").desc(), "kind")
    return c.withColumn("__n", F.row_number().over(best)).filter("__n = 1").select("q", "deviz", "kind", "score")


def disambiguate(candidates: DataFrame, page_codes: DataFrame, ref: DataFrame) -> DataFrame:
    """q and deviz: among exact candidates of a text, the section that shares most item codes with the page; the first without any."""
    codes = ref.filter((text("deviz") != "") & (text("cod") != "")).select("deviz", F.upper(text("cod")).alias("code")).distinct()
    shared = candidates.filter("kind = 'exact'").join(page_codes, "q", "left").join(codes, ["deviz", "code"], "left_semi").groupBy("q", "deviz").agg(F.countDistinct("code").alias("n"))
    w = Window.partitionBy("q").orderBy(F.coalesce("n", F.lit(0)).desc(), "deviz")
    return candidates.filter("kind = 'exact'").join(shared, ["q", "deviz"], "left").withColumn("__n", F.row_number().over(w)).filter("__n = 1").select("q", "deviz")


def map_by_name(ref: DataFrame, offer: DataFrame, least: float = 0.70, sure: float = 0.65) -> DataFrame:
    """offer_deviz, ref_deviz, how and score: equal code, equal name, best name ratio, else a name that holds the first word of the offer's code (0.85).

    Sides are one row a section (deviz, denumire, and `first`, where the reference's begin; without it they come by code). The
    last way is for codes without a hyphen whose best ratio is below `sure`; scores below `least` give nothing. Sections
    resolved by code or name leave before names are compared, and names meet in blocks: see alike.best_names().
    """
    place = F.col("first") if "first" in ref.columns else F.lit(0).cast("long")
    r = ref.select(F.col("deviz").alias("ref_deviz"), F.lower(text("denumire")).alias("rn"), place.alias("first"))
    o = offer.select(F.col("deviz").alias("offer_deviz"), F.lower(text("denumire")).alias("n"))
    code = o.join(r, o.offer_deviz == r.ref_deviz).select("offer_deviz", "ref_deviz", F.lit("code").alias("how"), F.lit(1.0).alias("score"))
    left = o.join(code, "offer_deviz", "left_anti")
    same = left.filter("n <> ''").join(r, left.n == r.rn).groupBy("offer_deviz").agg(F.min(F.struct("first", "ref_deviz")).alias("m")).select("offer_deviz", "m.ref_deviz", F.lit("name").alias("how"), F.lit(1.0).alias("score"))
    left = left.join(same, "offer_deviz", "left_anti").filter("n <> ''")
    asks = left.select("offer_deviz", F.col("n").alias("d"), F.when(~F.col("offer_deviz").contains("-"), section_prefix("offer_deviz")).otherwise("").alias("word"))
    best = best_names(asks, r.filter("rn <> ''").select("ref_deviz", F.col("rn").alias("d"), "first"))
    worded = (F.coalesce("score", F.lit(0.0)) < sure) & F.col("word_deviz").isNotNull()
    told = best.select("offer_deviz", F.when(worded, F.col("word_deviz")).otherwise(F.col("ref_deviz")).alias("ref_deviz"), F.when(worded, "first_word").otherwise("similar").alias("how"), F.when(worded, 0.85).otherwise(F.col("score")).alias("score"))
    return code.unionByName(same).unionByName(told.filter(F.col("score") >= least))


def renamed(ref: DataFrame, offer: DataFrame, provider=None) -> DataFrame:
    """offer's items under the reference's section names, as far as map_names() or the provider knows them; all stay where both sides have the same name keys."""
    side = lambda x: x.select(F.trim("deviz_denumire").alias("denumire")).filter("denumire <> ''").distinct()
    r, o = side(ref), side(offer)
    key = lambda x: x.select(section_name_key("denumire").alias("k")).distinct()
    if r.isEmpty() or (key(o).join(key(r), "k", "left_anti").isEmpty() and key(r).join(key(o), "k", "left_anti").isEmpty()):
        return offer
    m = map_names(r, o).select("offer_name", "ref_name")
    if provider is not None:
        from .providers import section_names

        open_ = o.select(F.col("denumire").alias("offer_name")).join(m, "offer_name", "left_anti")
        m = m.unionByName(section_names(open_, provider).join(r.select(F.col("denumire").alias("ref_name")), "ref_name", "left_semi").select("offer_name", "ref_name"))
    named = offer.withColumn("__name", F.trim("deviz_denumire")).join(m.select(F.col("offer_name").alias("__name"), F.col("ref_name").alias("__to")), "__name", "left")
    return named.withColumn("deviz_denumire", F.coalesce("__to", "deviz_denumire")).select(*offer.columns)


def remap(items: DataFrame, mapping: DataFrame) -> DataFrame:
    """items with mapped sections; the old one stays in deviz_original where it changed."""
    m = mapping.select(F.col("offer_deviz").alias("deviz"), F.col("ref_deviz").alias("__to"))
    moved = F.col("__to").isNotNull() & (F.col("__to") != F.col("deviz"))
    return items.join(m, "deviz", "left").withColumn("deviz_original", F.when(moved, F.col("deviz"))).withColumn("deviz", F.coalesce("__to", "deviz")).drop("__to")


def remap_by_code(items: DataFrame, ref: DataFrame, unresolved: DataFrame, order: str = "seq") -> DataFrame:
    """items of unresolved sections (deviz) take the reference's first section of their code."""
    first = ref.filter(text("cod") != "").groupBy(clean_code("cod").alias("__c")).agg(F.min_by("deviz", order).alias("__to"))
    open_ = items.join(unresolved.select("deviz").distinct().withColumn("__open", F.lit(True)), "deviz", "left")
    return open_.withColumn("__c", clean_code("cod")).join(first, "__c", "left").withColumn("deviz", F.when(F.col("__open"), F.coalesce("__to", "deviz")).otherwise(F.col("deviz"))).select(*items.columns)


def map_names(ref: DataFrame, offer: DataFrame, least: float = 0.6) -> DataFrame:
    """offer_name, ref_name and tier: equal keys, equal keys without prefix, else a word overlap above 0.6, longer names first."""
    side = lambda df, p: df.select(F.trim("denumire").alias(p)).filter(F.col(p) != "").distinct().withColumns({p + "_1": section_name_key(p), p + "_2": section_name_key(strip_section_prefix(p))})
    r, o = side(ref, "ref_name"), side(offer, "offer_name")
    one = o.join(r, F.col("offer_name_1") == F.col("ref_name_1")).groupBy("offer_name").agg(F.min("ref_name").alias("ref_name")).withColumn("tier", F.lit(1))
    left = o.join(one, "offer_name", "left_anti")
    two = left.join(r, F.col("offer_name_2") == F.col("ref_name_2")).groupBy("offer_name").agg(F.min("ref_name").alias("ref_name")).withColumn("tier", F.lit(2))
    left = left.join(two, "offer_name", "left_anti")
    words = lambda df, c: df.withColumn("w", F.explode(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"\w+"), F.lit(0)), lambda x: F.length(x) >= 3))))
    met = words(left, F.col("offer_name")).join(words(r, F.col("ref_name")), "w").select("offer_name", "ref_name").distinct()
    met = met.withColumn("s", word_overlap("offer_name", "ref_name")).filter(F.col("s") > least)
    three = met.groupBy("offer_name").agg(F.max_by("ref_name", F.struct("s", F.length("ref_name"), "ref_name")).alias("ref_name")).withColumn("tier", F.lit(3))
    return one.unionByName(two).unionByName(three)


def code_sets(items: DataFrame) -> DataFrame:
    """deviz and code, distinct."""
    return items.filter((text("deviz") != "") & (text("cod") != "")).select("deviz", F.upper(text("cod")).alias("code")).distinct()


def equivalences(ref: DataFrame, offer: DataFrame, least: float = 0.5) -> DataFrame:
    """oferta_deviz, ref_deviz, overlap_score and both numbers of codes, for offer sections that the reference lacks: the best Jaccard index of codes.

    Sections meet over shared codes, so no section meets one that it shares nothing with.
    """
    r, o = code_sets(ref), code_sets(offer)
    o = o.join(r.select("deviz").distinct(), "deviz", "left_anti")
    nr, no = r.groupBy("deviz").agg(F.count("*").alias("ref_art_count")), o.groupBy("deviz").agg(F.count("*").alias("oferta_art_count"))
    both = o.withColumnRenamed("deviz", "oferta_deviz").join(r.withColumnRenamed("deviz", "ref_deviz"), "code").groupBy("oferta_deviz", "ref_deviz").agg(F.count("*").alias("c"))
    s = both.join(nr.withColumnRenamed("deviz", "ref_deviz"), "ref_deviz").join(no.withColumnRenamed("deviz", "oferta_deviz"), "oferta_deviz")
    s = s.withColumn("overlap_score", F.col("c") / (F.col("ref_art_count") + F.col("oferta_art_count") - F.col("c")))
    w = Window.partitionBy("oferta_deviz").orderBy(F.col("overlap_score").desc(), "ref_deviz")
    return s.withColumn("__n", F.row_number().over(w)).filter((F.col("__n") == 1) & (F.col("overlap_score") >= least)).select("oferta_deviz", "ref_deviz", "overlap_score", "oferta_art_count", "ref_art_count")


def orphans(ref: DataFrame, offer: DataFrame, matched: DataFrame) -> DataFrame:
    """cod, deviz and wrong_deviz: reference keys without a match whose code the offer has in another section that nothing consumed."""
    key = lambda df: df.filter(text("cod") != "").select("deviz", clean_code("cod").alias("cod")).distinct()
    m = key(matched)
    left = key(ref).join(m, ["deviz", "cod"], "left_anti")
    free = key(offer).join(m, ["deviz", "cod"], "left_anti").withColumnRenamed("deviz", "wrong_deviz")
    return left.join(free, "cod").filter("deviz <> wrong_deviz").select("cod", "deviz", "wrong_deviz").distinct()


def corrected(ref: DataFrame, offer: DataFrame) -> DataFrame:
    """offer with section corrections by code: where a code's reference sections do not hold the row's, the least of them; deviz_original keeps the old one."""
    own = ref.filter(text("cod") != "").groupBy(clean_code("cod").alias("__c")).agg(F.collect_set("deviz").alias("__s"), F.min("deviz").alias("__m"))
    j = offer.withColumn("__c", clean_code("cod")).join(own, "__c", "left")
    wrong = F.col("__s").isNotNull() & ~F.array_contains("__s", F.coalesce("deviz", F.lit("")))
    return j.withColumn("deviz_original", F.when(wrong, F.col("deviz"))).withColumn("deviz", F.when(wrong, F.col("__m")).otherwise(F.col("deviz"))).drop("__c", "__s", "__m")


def differences(ref: DataFrame, offer: DataFrame) -> DataFrame:
    """side (extra in the offer, missing from it), deviz, denumire and art_count of sections that one side has alone."""
    s = lambda df: df.filter(text("deviz") != "").groupBy("deviz").agg(F.max_by("deviz_denumire", "seq").alias("denumire"), F.count("*").alias("art_count"))
    r, o = s(ref), s(offer)
    return o.join(r, "deviz", "left_anti").withColumn("side", F.lit("extra")).unionByName(r.join(o, "deviz", "left_anti").withColumn("side", F.lit("missing")))


#: Section codes (fixed values): a chapter before a sub-code, a main code, a sub-code.
PREFIXED, MAIN, SUB = r"^\d{1,3}\s+([0-9]\.[0-9])", r"^\d{1,3}$", r"^[0-9]\.[0-9]"


def code_pattern(ref: DataFrame, offer: DataFrame) -> DataFrame:
    """pattern, n_ref, n_offer and n_both: how an offer's section codes relate to the reference's, by the first that holds.

    IDENTICAL sets; PREFIXED, where codes `NNN X.Y` have their X.Y in the reference, three of them and half at least, or seven
    tenths beside main codes; MAIN_PLUS_SUB, where main codes are the offer's alone and seven tenths of its sub-codes are the
    reference's too; SUBSET; SUPERSET; UNKNOWN.
    """
    codes = lambda x: x.select("deviz").filter(text("deviz") != "").distinct()
    r = codes(ref)
    o = codes(offer).withColumn("sub", F.regexp_extract("deviz", PREFIXED, 1))
    o = o.join(r.withColumn("hit", F.lit(True)), "deviz", "left").join(r.select(F.col("deviz").alias("sub"), F.lit(True).alias("subhit")), "sub", "left")
    main, dotted, hit = F.col("deviz").rlike(MAIN), F.col("deviz").rlike(SUB), F.col("hit").isNotNull()
    n = o.agg(F.count("*").alias("n_offer"), F.count_if(hit).alias("n_both"), F.count_if(F.col("sub") != "").alias("subs"), F.count_if(F.col("subhit").isNotNull()).alias("subhits"), F.count_if(main).alias("mains"), F.count_if(main & hit).alias("mainhits"), F.count_if(dotted).alias("dots"), F.count_if(dotted & hit).alias("dothits"))
    one = n.join(F.broadcast(r.agg(F.count("*").alias("n_ref"))))
    p = (
        F.when(F.expr("n_ref = n_offer AND n_both = n_ref"), "IDENTICAL")
        .when(F.expr("subs > 0 AND (subhits >= greatest(3, subs div 2) OR (subhits > 0 AND mains > 0 AND subhits >= 0.7D * subs))"), "PREFIXED")
        .when(F.expr("mains > 0 AND mainhits = 0 AND dots > 0 AND dothits >= 0.7D * dots"), "MAIN_PLUS_SUB")
        .when(F.expr("n_both = n_offer"), "SUBSET")
        .when(F.expr("n_both = n_ref"), "SUPERSET")
        .otherwise("UNKNOWN")
    )
    return one.select(p.alias("pattern"), "n_ref", "n_offer", "n_both")


def code_mapping(offer: DataFrame, pattern: str) -> DataFrame:
    """offer_deviz and ref_deviz of the codes that a pattern changes: under PREFIXED, `NNN X.Y` is X.Y; no other pattern changes any."""
    sub = F.regexp_extract("deviz", PREFIXED, 1)
    return offer.select(F.col("deviz").alias("offer_deviz"), sub.alias("ref_deviz")).filter((F.col("ref_deviz") != "") & F.lit(pattern == "PREFIXED")).distinct()


def normalized_codes(items: DataFrame, ref: DataFrame) -> DataFrame:
    """items under section codes as the reference has them, by the pattern that both show."""
    pattern = code_pattern(ref, items).first()["pattern"]
    if pattern == "MAIN_PLUS_SUB":
        return to_first_sub(items, ref)
    return remap(items, code_mapping(items, pattern)).select(*items.columns) if pattern == "PREFIXED" else items


def to_first_sub(items: DataFrame, ref: DataFrame) -> DataFrame:
    """items of a main code take the least of the sub-codes under which the reference has their item code."""
    subs = ref.filter((text("cod") != "") & F.col("deviz").rlike(SUB)).groupBy("cod").agg(F.min("deviz").alias("__to"))
    main = F.col("deviz").rlike(MAIN) & F.col("__to").isNotNull()
    return items.join(subs, "cod", "left").withColumn("deviz", F.when(main, F.col("__to")).otherwise(F.col("deviz"))).select(*items.columns)
