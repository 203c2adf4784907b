"""Pages of OCR documents: lines, labels, section keys, propagation, ranges and rescue of missed pages."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.codes import normalize_section, text
from ..functions.texts import has_item_codes
from ..session import ship

# What marks a page as no item page, and as one.
REJECT = (r"(?i)FORMULAR\s+(?!F3\b)[CF][0-9]", r"(?i)CENTRALIZATORUL\s+cheltuielilor", r"(?i)LISTA\s+cuprinzand\s+consumurile", r"(?i)Formularul\s+nr\.")
SUMMARY = r"(?i)\bRecapitulati[ae]?\b"
FORM = r"(?i)Formular(?:ul)?\s+F3|SECTIUNEA\s+TEHNICA\s+SECTIUNEA\s+FINANCIARA.*Capitol\s+de\s+lucrari"
STAGE = r"(?i)STADIU[L]?\s+FIZIC\s*:"
COMPONENT = r">>>\s*componenta"
PAGED = r"(?i)^.{0,149}?\b[A-Z0-9]{6}\s+pag\b"
EXPLICIT = r"(?i)Deviz\s+Oferta\s+([A-Z0-9]{5,8})"
OBJECT = r"(?i)Obiectul\s*:\s*([0-9.]*)\s*(.+?)(?=Categoria|Stadiul|Beneficiar|Nr\.|Lista|$)"
CATEGORY = r"(?i)(?:Categoria\s+de\s+lucrari|Stadiul\s+fizic)\s*:\s*([0-9]{0,4})\s*(.+?)(?=Beneficiar|Nr\.|Lista|OBSE|Executant|Proiectant|Formular|e\s+Devize|$)"
#: What follows the physical-stage label: labels that OCR put between, the word oferta, a chapter number, a code of 5 to 8 signs with three digits in a row.
STAGED = r"(?i)STADIU[L]?\s+FIZIC\s*:\s*(?:(?:Beneficiar|Proiectant|Executant|Ofertant|Obiectul|Obiectiv)\s*:\s*){0,3}(?:oferta\s+)?(?:\d{1,3}\s+)?((?=[A-Z0-9]*\d{3})[A-Z0-9]{5,8})(?![A-Z0-9])\s*(.*?)(?=\s*(?:Beneficiar|Proiectant|Executant|Ofertant|Formular|e\s+Devize|Lista)|\s+Pag\s+\d|\s+0\s+1\s+2|\s+Recapitulati|$)"
PARTIAL = "__partial__"
NAMED = "struct<num:string,text:string>"


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, page_number, line_no and content from documents with pages; missing content is empty, pages without lines have none."""
    p = docs.select("doc_id", F.explode("pages").alias("p"))
    return p.select("doc_id", F.col("p.page_number").alias("page_number"), F.posexplode("p.lines").alias("line_no", "l")).select("doc_id", "page_number", "line_no", F.coalesce("l.content", F.lit("")).alias("content"))


def page_text(rows: DataFrame) -> DataFrame:
    """doc_id, page_number, lines in order, and `full`, the lines joined by a blank."""
    g = rows.groupBy("doc_id", "page_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "content"))), lambda x: x["content"]).alias("lines"))
    return g.withColumn("full", F.concat_ws(" ", "lines"))


def section_of(full: Column) -> Column:
    """method, code and the object's and category's number and text of a page's section, by the first of five ways.

    explicit (the label of a bid's section), compound (two numbers), stage (a code after the physical-stage label), partial
    (texts that wait for a reference), none.
    """
    group = lambda p, i: F.trim(F.regexp_extract(full, p, i))
    explicit = F.upper(F.regexp_extract(full, EXPLICIT, 1))
    on, ot, cn = group(OBJECT, 1), group(OBJECT, 2), group(CATEGORY, 1)
    ct = F.substring(F.trim(F.regexp_extract(group(CATEGORY, 2), r"^(.*?)(?:\s+Pag\s+\d+.*|\s+0\s+1\s+2\s+3.*)?$", 1)), 1, 60)
    stage = group(STAGED, 1)
    pair = F.struct(on.alias("num"), ot.alias("text")), F.struct(cn.alias("num"), ct.alias("text"))
    make = lambda method, code, both: F.struct(F.lit(method).alias("method"), code.alias("code"), (pair[0] if both else F.lit(None).cast(NAMED)).alias("object"), (pair[1] if both else F.lit(None).cast(NAMED)).alias("category"))
    return (
        F.when(explicit != "", make("explicit", explicit, False))
        .when((on != "") & (cn != ""), make("compound", F.concat_ws("-", on, cn), True))
        .when(stage != "", F.struct(F.lit("stage").alias("method"), F.upper(stage).alias("code"), pair[0].alias("object"), F.struct(F.lit("").alias("num"), F.substring(group(STAGED, 2), 1, 60).alias("text")).alias("category")))
        .when((ot != "") | (ct != ""), make("partial", F.concat(F.lit(PARTIAL), F.substring(ot, 1, 40), F.lit(":"), F.substring(ct, 1, 40)), True))
        .otherwise(make("none", F.lit(""), False))
    )


def page_label(full: Column) -> Column:
    """F3, NON_F3 or AMBIGUOUS."""
    codes = has_item_codes(full)
    no = (F.rlike(full, F.lit(SUMMARY)) | F.substring(full, 1, 200).contains("TOTAL GENERAL")) & ~codes
    for p in REJECT:
        no = no | F.rlike(full, F.lit(p))
    yes = F.rlike(full, F.lit(FORM)) | F.rlike(full, F.lit(STAGE)) | (F.rlike(full, F.lit(COMPONENT)) & codes) | F.rlike(full, F.lit(PAGED))
    return F.when(F.trim(full) == "", "AMBIGUOUS").when(no, "NON_F3").when(yes & (section_of(full)["method"] == "none") & ~codes, "NON_F3").when(yes, "F3").otherwise("AMBIGUOUS")


def classify(pages: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """pages (doc_id, page_number, lines, full) with label, deviz_cod, deviz_den and extraction_method.

    matched (q, deviz), such as sections.lookup_text and disambiguate give, turns partial keys into reference sections.
    """
    out = pages.withColumn("label", page_label(F.col("full"))).withColumn("s", section_of(F.col("full")))
    f3 = F.col("label") == "F3"
    out = out.withColumn("deviz_den", F.when(f3, F.coalesce("s.category.text", "s.object.text", F.lit(""))).otherwise("")).withColumn("deviz_cod", F.when(f3, F.col("s.code")).otherwise("")).withColumn("extraction_method", F.when(f3, F.col("s.method")).otherwise("none"))
    if matched is not None:
        m = matched.select(F.col("q").alias("__q"), F.col("deviz").alias("__d"))
        out = out.withColumn("__t", F.when(F.col("extraction_method") == "partial", F.coalesce(F.nullif("s.category.text", F.lit("")), "s.object.text"))).join(m, F.col("__t") == F.col("__q"), "left")
        out = out.withColumn("extraction_method", F.when(F.col("__d").isNotNull(), "reference_matched").otherwise(F.col("extraction_method"))).withColumn("deviz_cod", F.coalesce("__d", "deviz_cod")).drop("__t", "__q", "__d")
    return out.withColumnsRenamed({"s": "section"})


def fill_sections(pages: DataFrame, key: str = "doc_id", order: str = "page_number") -> DataFrame:
    """pages with filled_cod, filled_den and needs_llm: a page of items without a key takes the last one; an ambiguous page shows it and then ends it."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    run = F.coalesce(F.sum(F.when(F.col("label") == "AMBIGUOUS", 1).otherwise(0)).over(before), F.lit(0))
    out = pages.withColumn("__run", run)
    upto = Window.partitionBy(key, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when((F.col("label") == "F3") & (text("deviz_cod") != ""), F.struct("deviz_cod", "deviz_den")), ignorenulls=True).over(upto)
    out = out.withColumn("__last", last)
    shown = F.col("label") != "NON_F3"
    return out.withColumn("filled_cod", F.when(shown, F.coalesce("__last.deviz_cod", F.lit(""))).otherwise("")).withColumn("filled_den", F.when(shown, F.coalesce("__last.deviz_den", F.lit(""))).otherwise("")).withColumn("needs_llm", (F.col("label") == "AMBIGUOUS") | ((F.col("label") == "F3") & F.col("__last").isNull())).drop("__run", "__last")


def inherit_sections(pages: DataFrame, key: str = "doc_id", order: str = "page_number") -> DataFrame:
    """The second fill, before parsing: pages whose section is open take the last resolved one and become item pages. U reads as zero."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    resolved = F.col("is_f3") & (text("deviz_cod") != "") & (F.col("extraction_method") != "partial_fallback")
    state = F.last(F.when(resolved, F.struct(normalize_section("deviz_cod").alias("cod"), F.col("deviz_den").alias("den"))), ignorenulls=True).over(upto)
    out = pages.filter(~F.coalesce("header_only", F.lit(False))).withColumn("__s", state)
    heir = ~resolved & F.col("__s").isNotNull()
    return out.withColumns({"deviz_cod": F.when(heir | resolved, F.col("__s.cod")).otherwise(F.col("deviz_cod")), "deviz_den": F.when(heir, F.col("__s.den")).otherwise(F.col("deviz_den")), "extraction_method": F.when(heir, "inherited").otherwise(F.col("extraction_method")), "is_f3": F.col("is_f3") | heir}).drop("__s")


def page_groups(pages: DataFrame) -> DataFrame:
    """doc_id, deviz_cod, its first method, object and category, and its pages in order."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("page_number")))
    p = pages.filter((F.col("label") == "F3") & (text("deviz_cod") != "")).withColumns({"object": F.col("section.object"), "category": F.col("section.category")})
    return p.groupBy("doc_id", "deviz_cod").agg(first("extraction_method").alias("extraction_method"), first("object").alias("object"), first("category").alias("category"), F.array_sort(F.collect_set("page_number")).alias("pages"), F.lit(0).alias("article_count"))


def partial_fallback(pages: DataFrame) -> DataFrame:
    """Partial keys that nothing resolved become the first word of the category or object, 20 characters at most."""
    word = F.substring(F.split_part(F.trim(F.coalesce(F.nullif("section.category.text", F.lit("")), "section.object.text", F.lit(""))), F.lit(" "), F.lit(1)), 1, 20)
    open_ = F.col("deviz_cod").startswith(PARTIAL)
    return pages.withColumn("extraction_method", F.when(open_, "partial_fallback").otherwise(F.col("extraction_method"))).withColumn("deviz_cod", F.when(open_, word).otherwise(F.col("deviz_cod")))


def opens_section(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, page_number and target where a header line is followed within eight lines (its own included) by the target as a whole word."""
    w = Window.partitionBy("doc_id", "page_number").orderBy("line_no").rowsBetween(-7, 0)
    near = rows.withColumn("open", F.max(F.col("content").rlike(r"(?i)Deviz\s+oferta|STADIU[L]?\s+FIZIC").cast("int")).over(w)).filter("open = 1")
    words = near.select("doc_id", "page_number", F.explode(F.array_distinct(F.split(F.upper("content"), r"[^A-Z0-9.\-]+"))).alias("target"))
    return words.join(targets.select(F.upper("target").alias("target")).distinct(), "target", "left_semi").distinct().select("doc_id", "page_number", "target")


def section_ranges(pages: DataFrame, key: str = "doc_id", order: str = "page_number") -> DataFrame:
    """pages (header code in `opens`, section they already have in `owner`) with `target`: the section whose range they lie in.

    A range opens at a header and lasts until the next header or a page that another section owns.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = pages.withColumn("__g", F.count(F.when(F.col("opens").isNotNull(), 1)).over(w))
    g = Window.partitionBy(key, "__g")
    out = out.withColumn("target", F.max("opens").over(g))
    other = F.max(F.when(F.col("owner").isNotNull() & (F.col("owner") != F.col("target")), 1).otherwise(0)).over(g.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("target", F.when(other == 0, F.col("target"))).drop("__g")


def neighbour_sections(pages: DataFrame, key: str = "doc_id", order: str = "page_number", reach: int = 4) -> DataFrame:
    """pages with inferred: the section of the nearest item page, the one before first at equal distance, up to four pages away."""
    w = Window.partitionBy(key).orderBy(order)
    has = F.when((F.col("label") == "F3") & (text("deviz_cod") != ""), F.col("deviz_cod"))
    out = pages.withColumn("__h", has)
    near = [x for k in range(1, reach + 1) for x in (F.lag("__h", k).over(w), F.lead("__h", k).over(w))]
    return out.withColumn("inferred", F.coalesce(*near)).drop("__h")


# Fixed values of the second look at pages: item codes, a section's mark in a heading, sure signs of items, signs of summaries, units, quantities.
SCORED_CODE = r"\b[A-Z]{2,5}\d{1,4}[A-Z]?\d{0,2}[A-Z]?\b|\b\d{5,8}\s*[-–]"
SECTION_PAGE = r"(?i)\b([A-Z0-9]{5,8})\s+pag\b"
SURE = r"(?is)SECTIUNEA\s+TEHNICA.*SECTIUNEA\s+FINANCIARA|Capitol\s+de\s+lucrari.*U\.?M\.?.*Cantitate"
LETTER_CODE = r"\b[A-Z]{2,5}\d{1,4}[A-Z]?\d{0,2}[A-Z]?\b"
SUMMED = (
    r"(?i)Total\s+cheltuieli\s+directe|TOTAL\s+GENERAL\s+DEVIZ|Cheltuieli\s+indirecte|Centralizatorul\s+cheltuielilor|LISTA\s+cuprinzand\s+consumurile|Recapitulatia\s+lucrarilor|consum\s+de\s+manopera|consum\s+de\s+materiale|consum\s+de\s+utilaje|"
    r"Lista\s+consumurilor\s+de\s+resurse|CONSUMURI\s+DE\s+RESURSE|Detaliere\s+transporturi|Nr\.\s+crt\.\s+Denumirea\s+resurselor"
)
SCORED_UNITS = ("MP", "MC", "BUC", "KG", "TONA", "ML", "M", "KM", "L", "ORE", "ORA", "ZI", "ZILE", "LEI", "RON")
SCORED_QUANTITY = r"^\d{1,10}[.,]\d{1,6}$|^\d{1,10}[.,]\d{3}[.,]\d{1,3}$"
#: How section codes of one customer begin; they count as a section's mark without the word that follows others.
SITES = ("226",)


def content_scores(rows: DataFrame) -> DataFrame:
    """doc_id, page_number and score: lines with an item code that have a unit or a quantity two lines before to four after."""
    w = Window.partitionBy("doc_id", "page_number").orderBy("line_no").rowsBetween(-2, 4)
    line = F.trim("content")
    code = F.rlike(line, F.lit(SCORED_CODE))
    proof = ~code & (F.upper(F.regexp_replace(line, r"[.\s]+", "")).isin(*SCORED_UNITS) | F.rlike(line, F.lit(SCORED_QUANTITY)))
    s = rows.withColumn("c", code).withColumn("e", F.max(proof.cast("int")).over(w))
    return s.groupBy("doc_id", "page_number").agg(F.count_if(F.col("c") & (F.col("e") == 1)).alias("score"))


def rescue_candidates(pages: DataFrame, scores: DataFrame, reach: int = 4, sites: tuple[str, ...] = SITES) -> DataFrame:
    """Pages that are no item pages but look like one, with the section they would have in `candidate` (empty where nothing tells).

    A page with a sure sign takes the section marked in its first ten lines, else that of the nearest item page up to four
    pages away (the one before first at equal distance), else one marked anywhere on it; a page with codes, no sign of a
    summary, a section marked in its first ten lines and a score takes that one. Pages are gone through in order, and those
    taken count as item pages for the pages behind them: a fold over a document's pages.
    """
    ship(pages.sparkSession)
    w = Window.partitionBy("doc_id").orderBy("page_number")
    p = pages if "is_f3" in pages.columns else pages.withColumn("is_f3", F.col("label") == "F3")
    p = p.join(scores, ["doc_id", "page_number"], "left")
    whole, early = F.concat_ws("\n", "lines"), F.concat_ws("\n", F.slice("lines", 1, 10))
    at_site = rf"(?i)\b((?:{'|'.join(sites)})[A-Z0-9]{{3}})\b" if sites else r"(\b\B)"
    mark = lambda c, pattern: F.nullif(F.upper(F.regexp_extract(c, pattern, 1)), F.lit(""))
    own = F.coalesce(mark(early, SECTION_PAGE), mark(early, at_site))
    sure = F.rlike(whole, F.lit(SURE)) | (F.rlike(whole, F.lit("(?i)" + COMPONENT)) & F.rlike(whole, F.lit(LETTER_CODE)))
    likely = F.rlike("full", F.lit(SCORED_CODE)) & ~F.rlike("full", F.lit(SUMMED)) & own.isNotNull() & (F.coalesce("score", F.lit(0)) >= 1)
    kind = F.when(F.col("is_f3"), 0).when(F.size("lines") == 0, 3).when(sure, 1).when(likely, 2).otherwise(3)
    p = p.withColumns({"__kind": kind, "__own": own, "__any": mark(whole, at_site)}).withColumn("__code", F.when((F.col("__kind") == 0) & (text("deviz_cod") != ""), F.col("deviz_cod")))
    p = p.withColumn("__after", F.array(*[F.lead("__code", k).over(w) for k in range(1, reach + 1)]))
    fold = p.select(F.col("doc_id").cast("string").alias("__doc"), "page_number", F.col("__kind").alias("kind"), F.col("__own").alias("own"), F.col("__any").alias("any"), F.col("__code").alias("code"), F.col("__after").alias("after"), F.struct("doc_id", "page_number").alias("at"))
    at = fold.schema["at"].dataType
    told = fold.repartition("__doc").sortWithinPartitions("__doc", "page_number").select("__doc", "kind", "own", "any", "code", "after", "at").mapInPandas(lambda frames: _proposed(frames, reach), StructType([StructField("at", at), StructField("candidate", StringType())]))
    return p.filter("__kind in (1, 2)").drop("__kind", "__own", "__any", "__code", "__after").join(told.select("at.*", "candidate"), ["doc_id", "page_number"])


def _proposed(frames: Iterator[pd.DataFrame], reach: int) -> Iterator[pd.DataFrame]:
    """Place and candidate of pages of the kinds 1 and 2, from pages that come in order, a document after the other. Only the sections of the last `reach` pages are held."""
    doc, seen = None, deque(maxlen=reach)
    for f in frames:
        at, out = [], []
        for i, (d, kind, own, any_, code, after) in enumerate(zip(f["__doc"], f["kind"], f["own"], f["any"], f["code"], f["after"])):
            if d != doc:
                doc = d
                seen.clear()
            found = code if kind == 0 else own if kind == 2 else None
            if kind == 1:
                near = (c for k in range(reach) for c in (seen[-1 - k] if len(seen) > k else None, after[k]))
                found = own if own is not None else next((c for c in near if c is not None), any_)
            if kind in (1, 2):
                at.append(i)
                out.append(found or "")
            seen.append(found or None)
        yield pd.DataFrame({"at": f["at"].iloc[at].reset_index(drop=True), "candidate": pd.Series(out, dtype=object)})


def with_context(rows: DataFrame, before: int = 8, after: int = 8, keys: tuple[str, ...] = ("doc_id", "page_number"), order: str = "line_no") -> DataFrame:
    """rows with `context`: the lines around each, in order."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-before, after)
    return rows.withColumn("context", F.collect_list("content").over(w))


# Labels of a bidder's name, and what ends a name on lines of its own.
BIDDER_LINE, BIDDER, JOINT = r"(?i)^OFERTANT\s*[,.]?\s*$", r"(?i)^Ofertant\s*:\s*(.+)", r"(?i)(?:denumirea\s+)?Asociere\s*:\s*(.+)"
NAME_ENDS = r"(?i)^(Director|Semnatura|Nume|Data\b)"


def bidder_names(rows: DataFrame, pages: int = 10) -> DataFrame:
    """doc_id and bidder of a document's first ten pages, the first hit in the order of pages and lines.

    Behind a line that is the label alone, up to four lines of the page until a blank one or one of a signature; else what
    follows the label on its line (11 characters or more), or the label of an association (9 or more).
    """
    w = Window.partitionBy("doc_id", "page_number").orderBy("line_no")
    r = rows.withColumn("__p", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("page_number"))).filter(F.col("__p") <= pages).withColumn("s", F.trim("content"))
    nexts = F.array(*[F.trim(F.coalesce(F.lead("content", k).over(w), F.lit(""))) for k in range(1, 5)])
    r = r.withColumn("nexts", nexts).withColumn("end", F.array_position(F.transform("nexts", lambda x: (x == "") | x.rlike(NAME_ENDS)), True))
    name = F.trim(F.regexp_replace(F.array_join(F.slice("nexts", F.lit(1), F.when(F.col("end") == 0, 4).otherwise(F.col("end") - 1).cast("int")), " "), r"\s+", " "))
    told = lambda pattern, least: F.when(F.length(F.trim(F.regexp_extract("s", pattern, 1))) >= least, F.trim(F.regexp_extract("s", pattern, 1)))
    r = r.withColumn("v", F.coalesce(F.when(F.col("s").rlike(BIDDER_LINE), F.nullif(name, F.lit(""))), told(BIDDER, 11), told(JOINT, 9)))
    return r.filter("v is not null").groupBy("doc_id").agg(F.min_by("v", F.struct("page_number", "line_no")).alias("bidder"))
