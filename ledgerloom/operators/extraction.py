"""From OCR documents to items: classification with its fills, rescue of pages, parsing, tables, and the rescan of missed sections.

All functions work on many documents at once; `doc_id` is part of every key. Language-model help is a provider and off by
default; without one no page is classified by a guess and no rescued page is confirmed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import generated_section_code, normalize_section, text
from ..functions.texts import plain_description, text_codes
from ..functions.units import line_unit
from ..session import ship, staged
from . import components, dedup, pages, parser, providers, sections, tables
from .aggregates import component_summary

ITEM = ("doc_id", "seq", "cod", "denumire", "um", "cantitate", "deviz", "deviz_denumire", "is_component", "parent_code", *parser.PRICES)
#: What opens a section in running text, by precedence, and what ends the part of a document that holds items (fixed values).
MARKS = (r"(?i)Deviz\s+oferta\s+([A-Z0-9]{4,8})\s+(.+)", r"(?i)STADIUL?\s+FIZIC\s*:\s*()(\S.*)", r"(?i)Categoria\s+de\s+lucrari\s*:\s*()(\S.*)")
FORM = r"(?i)Formular(?:ul)?\s+F3|F3\s*[-–]\s*LISTA\s+cu\s+cantitati"
START = r"(?i)Deviz\s+oferta|STADIU[L]?\s+FIZIC\s*:|Categoria\s+de\s+lucrari"
END = r"(?i)^(?:FORMULAR\s+C[0-9]|Lista\s+consumurilor\s+de\s+resurse|Recapitulatia\s+cheltuielilor|CENTRALIZATOR)"
LOOK_BACK = 20


def pages_of(docs: DataFrame) -> DataFrame:
    """doc_id, page_number, lines and full of every page, those without lines too."""
    p = docs.select("doc_id", F.explode("pages").alias("p"))
    content = F.transform(F.coalesce("p.lines", F.array().cast("array<struct<content:string>>")), lambda x: F.coalesce(x["content"], F.lit("")))
    return p.select("doc_id", F.col("p.page_number").alias("page_number"), content.alias("lines")).withColumn("full", F.concat_ws(" ", "lines"))


def lines_of(p: DataFrame) -> DataFrame:
    return p.select("doc_id", "page_number", F.posexplode("lines").alias("line_no", "content"))


def matched_sections(classes: DataFrame, reference: DataFrame) -> DataFrame:
    """q and deviz: the reference's section for each text of a partial key. One exact name wins; several are told apart by the codes of the text's pages; else the best score, then the least section."""
    part = classes.filter("extraction_method = 'partial'")
    named = lambda c: F.when(text(c) != "", F.col(c))
    texts = part.select(named("section.category.text").alias("category"), named("section.object.text").alias("object"), "full")
    found = sections.lookup_text(texts.select(F.explode(F.array_compact(F.array("category", "object"))).alias("q")).distinct(), sections.names(reference))
    # the category's text, or the object's where there is none or it finds nothing
    known = found.select(F.col("q").alias("category"), F.lit(True).alias("__known")).distinct()
    q = texts.join(known, "category", "left").select(F.when(F.col("__known"), F.col("category")).otherwise(F.coalesce("object", "category")).alias("q"), F.coalesce("category", "object").alias("as"), "full").filter("q is not null")
    asked = q.select("q", "as").distinct()
    exact = found.filter("kind = 'exact'")
    n = exact.groupBy("q").agg(F.count("*").alias("n"), F.min("deviz").alias("deviz"))
    codes = q.select("q", F.explode(text_codes("full")).alias("code")).distinct()
    told = sections.disambiguate(exact.join(n.filter("n > 1").select("q"), "q", "left_semi"), codes, reference)
    best = found.groupBy("q").agg(F.min_by("deviz", F.struct((-F.col("score")).alias("s"), "deviz")).alias("deviz")).join(n.select("q"), "q", "left_anti")
    every = n.filter("n = 1").select("q", "deviz").unionByName(told).unionByName(best)
    return asked.join(every, "q").groupBy(F.col("as").alias("q")).agg(F.min("deviz").alias("deviz"))


def classified(docs: DataFrame, reference: DataFrame | None = None, provider: providers.Provider | None = None) -> DataFrame:
    """Pages with label, is_f3, deviz_cod, deviz_den, extraction_method, section and needs_llm, after the first fill.

    A reference's items turn partial keys into its sections; those that stay are resolved by the provider, or become their
    first word. A provider is asked about pages that no rule decides.
    """
    out = pages.classify(pages_of(docs))
    if reference is not None:
        m = matched_sections(out, reference)
        out = pages.classify(out.select("doc_id", "page_number", "lines", "full"), m)
    out = pages.fill_sections(out).withColumns({"deviz_cod": F.col("filled_cod"), "deviz_den": F.col("filled_den"), "is_f3": F.col("label") == "F3", "header_only": F.lit(False)}).drop("filled_cod", "filled_den")
    out = out.withColumn("needs_llm", F.col("needs_llm") | (F.col("is_f3") & (text("deviz_cod") == "")))
    if provider is not None:
        key = ["doc_id", "page_number"]
        told = providers.ask(out.filter("needs_llm").select(*key, F.concat_ws("\n", F.slice("lines", 1, 20)).alias("text")), "classify_pages", provider).drop("text")
        out = out.join(told, key, "left")
        yes = F.col("answer_label") == "F3"
        given = yes & (text("answer_deviz_cod") != "")
        out = out.withColumns({"is_f3": F.coalesce(yes, "is_f3"), "label": F.coalesce("answer_label", "label"), "deviz_cod": F.when(given, F.col("answer_deviz_cod")).otherwise(F.col("deviz_cod")), "deviz_den": F.when(given, "").otherwise(F.col("deviz_den"))}).drop("answer_label", "answer_deviz_cod")
    if reference is not None:
        out = providers.resolve_partial(out, provider)
    return out


def empty_documents(classes: DataFrame) -> DataFrame:
    """doc_id of documents without any page of items: nothing will be extracted from them."""
    return classes.groupBy("doc_id").agg(F.max(F.col("is_f3").cast("int")).alias("n")).filter("n = 0").select("doc_id")


def component_formats(classes: DataFrame, sample: int = 3) -> DataFrame:
    """The component format of each document, from its first pages of items."""
    w = Window.partitionBy("doc_id").orderBy("page_number")
    some = classes.filter("is_f3").withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= sample)
    return component_summary(some.groupBy("doc_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("page_number", F.concat_ws("\n", "lines").alias("t")))), lambda x: x["t"])).alias("text")))


def rescued(classes: DataFrame, provider: providers.Provider | None = None) -> DataFrame:
    """Pages that rules propose to look at again become pages of items where the provider confirms it, under its section or the proposed one."""
    if provider is None:
        return classes
    key = ["doc_id", "page_number"]
    c = pages.rescue_candidates(classes, pages.content_scores(lines_of(classes))).select(*key, F.concat_ws("\n", F.slice("lines", 1, 20)).alias("text"), "candidate")
    told = providers.ask(c, "classify_pages", provider).filter("answer_label = 'F3'").select(*key, F.coalesce(F.nullif("answer_deviz_cod", F.lit("")), "candidate").alias("__d"))
    out = classes.join(told, key, "left")
    hit = F.col("__d").isNotNull()
    return out.withColumns({"is_f3": F.col("is_f3") | hit, "label": F.when(hit, "F3").otherwise(F.col("label")), "deviz_cod": F.coalesce("__d", "deviz_cod"), "extraction_method": F.when(hit, "rescued").otherwise(F.col("extraction_method"))}).drop("__d")


def _numbered(items: DataFrame, *order: str | Column) -> DataFrame:
    return items.withColumn("seq", (F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1).cast("long"))


def items_of(classes: DataFrame, persist=staged, site: tuple[str, ...] = parser.SITE) -> DataFrame:
    """ITEM of pages: second fill, one parse a section over all its pages, component blocks a page, first of each (code, section, quantity), inheritance, units.

    Sections come in the order of their first pages; seq counts the items of a document. A page stays one row, and a
    document's pages stay in the partition of the fill until their items are read.
    """
    ship(classes.sparkSession)
    p = pages.inherit_sections(classes).filter(F.col("is_f3") & (text("deviz_cod") != ""))
    name = F.when(text("deviz_den") != "", F.when(F.col("page_number").isNotNull(), F.col("deviz_den")))
    p = p.filter(F.size("lines") > 0).select("doc_id", normalize_section("deviz_cod").alias("deviz"), name.alias("deviz_denumire"), "page_number", parser.joined(F.col("lines")).alias("text"))
    # the fill has the pages by document; so are a document's sections
    rows = parser.parse_rows(p.sortWithinPartitions("doc_id", "deviz", "page_number"), site, True)
    rows = rows.withColumn("x", F.explode_outer(components.blocks_in(F.col("near")))).filter("near is null or x is not null")
    block = F.col("near").isNotNull()
    of = lambda a, b: F.when(block, a).otherwise(b)
    both = rows.select(
        "doc_id", "deviz", F.coalesce("deviz_denumire", F.lit("")).alias("deviz_denumire"), "first", of(F.col("x.cod"), F.col("cod")).alias("cod"), of(F.col("x.denumire"), plain_description("denumire")).alias("denumire"), of(F.col("x.um"), F.col("um")).alias("um"),
        of(F.lit(0.0), F.col("cantitate")).alias("cantitate"), block.alias("is_component"), of(F.lit(None).cast("string"), F.col("parent_code")).alias("parent_code"), *[of(F.lit(0.0), F.col(c)).alias(c) for c in parser.PRICES],
        block.cast("int").alias("part"), of(F.col("page_number"), F.lit(0)).alias("page_number"), of(F.col("x.line_no").cast("long"), F.col("seq")).alias("line_no"),
    )
    both = _numbered(both, "first", "deviz", "part", "page_number", "line_no")
    return components.inherit(dedup.dedup_extraction(both, ["seq"], ("doc_id",)), scope=("doc_id",)).withColumn("um", line_unit("um")).select(*ITEM)


def with_tables(items: DataFrame, docs: DataFrame, persist=staged) -> DataFrame:
    """Items of lines merged with those of the documents' layout tables, whose cells are read once."""
    t = tables.table_items(persist(tables.cells(docs), "cells"))
    t = _numbered(t, "table_idx", "row_index").withColumns({"is_component": F.lit(False), "parent_code": F.lit(None).cast("string")} | {c: F.lit(0.0) for c in parser.PRICES}).select(*ITEM)
    kept = tables.merge(items, t, ("doc_id",)).select("doc_id", "seq", "side")
    both = items.withColumn("side", F.lit(0)).unionByName(t.withColumn("side", F.lit(1))).join(kept, ["doc_id", "seq", "side"])
    return _numbered(both, "side", "seq").select(*ITEM)


def section_length(items: DataFrame, least: int = 2, most: int = 20) -> DataFrame:
    """Items whose section's code has 2 to 20 characters; longer ones are noise or keys that nothing resolved."""
    n = F.length(F.coalesce("deviz", F.lit("")))
    return items.filter((n >= least) & (n <= most))


def extract(docs: DataFrame, reference: DataFrame | None = None, provider: providers.Provider | None = None, persist=staged, site: tuple[str, ...] = parser.SITE) -> DataFrame:
    """ITEM of OCR documents, from pages and tables; documents without the column `tables` have none. `site` are the names and project numbers whose lines belong to no item."""
    classes = rescued(classified(docs, reference, provider), provider)
    if provider is not None or "tables" in docs.columns:  # a provider is asked once; a page's text is that of its lines, so it is not written beside them
        classes = persist(classes.drop("full"), "pages").withColumn("full", F.concat_ws(" ", "lines"))
    items = items_of(classes, persist, site)
    if "tables" in docs.columns:
        both = persist(with_tables(persist(dedup.dedup_items(items, ["seq"], ("doc_id",)), "line-items"), docs, persist), "items")
    else:  # nothing to merge with, so no quantity counts as zero, as in the merge
        key = ["doc_id", "deviz", "cod", "um"]
        both = _numbered(dedup.first_by(items, [*key, F.coalesce("cantitate", F.lit(0.0))], ["seq"]), "seq").select(*ITEM)
    return section_length(dedup.drop_code_suffixes(both, scope=("doc_id",)))


def ranges(classes: DataFrame, targets: DataFrame) -> DataFrame:
    """Pages (doc_id, page_number) with target (targets: doc_id, target): from the page whose heading names it on, to the next heading of another section or a page of one."""
    ln = lines_of(classes)
    opens = pages.opens_section(ln, targets).join(targets.select("doc_id", F.upper("target").alias("target")), ["doc_id", "target"], "left_semi").groupBy("doc_id", "page_number").agg(F.min("target").alias("t"))
    own = F.when(F.rlike("full", F.lit(pages.STAGE)) | F.rlike("full", F.lit(pages.EXPLICIT)), F.nullif(F.upper(pages.section_of(F.col("full"))["code"]), F.lit("")))
    p = classes.join(opens, ["doc_id", "page_number"], "left").withColumns({"opens": F.coalesce("t", own), "owner": F.when(F.col("is_f3") & (text("deviz_cod") != ""), F.upper("deviz_cod"))})
    wanted = targets.select("doc_id", F.upper("target").alias("target")).distinct()
    return pages.section_ranges(p).join(wanted, ["doc_id", "target"], "left_semi")


def rescan(classes: DataFrame, items: DataFrame, targets: DataFrame, persist=staged) -> tuple[DataFrame, DataFrame]:
    """items with those of sections (doc_id, target) that were missed, and the targets that no page opens.

    Only pages that another section does not own, or that have none, are parsed again.
    """
    found = persist(ranges(classes, targets), "ranges")
    again = found.filter(~F.col("is_f3") | (F.upper(text("deviz_cod")) != F.col("target"))).withColumns({"is_f3": F.lit(True), "deviz_cod": F.col("target"), "deviz_den": F.lit(""), "extraction_method": F.lit("rescan"), "header_only": F.lit(False)})
    more = items_of(again.drop("target", "opens", "owner", "t"), persist)
    open_ = targets.select("doc_id", F.upper("target").alias("target")).distinct().join(found.select("doc_id", "target").distinct(), ["doc_id", "target"], "left_anti")
    both = items.withColumn("__p", F.lit(0)).unionByName(more.withColumn("__p", F.lit(1)))
    return _numbered(both, "__p", "seq").select(*ITEM), open_


#: The marks above within a text of many lines: blanks that end no line, and a name up to the line's end.
_MARKS, _FORM, _START, _END = [re.compile(p.replace("(?i)", "").replace(r"\s", r"[ \t\x0b\f\r]").replace(".", r"[^\n\r\x85\u2028\u2029]"), re.I | re.A | re.M) for p in MARKS], *[re.compile(p.replace("(?i)", "").replace(r"\s", r"[ \t\x0b\f\r]"), re.I | re.A | re.M) for p in (FORM, START, END)]


def slices(told: str) -> list[tuple[str | None, str | None, int | None, int, int, int]]:
    """The sections of a running text by the first kind of mark that it has: code, name, kind, number, and where they begin and end.

    What stands before the first form, less 20 lines back to a section's mark, is left out; so is what follows the
    heading of another form or a summary. Without marks all is one section.
    """
    at, form = 0, _FORM.search(told)
    begin = lambda g: told.rfind("\n", 0, g.start()) + 1
    if form:
        at, back = begin(form), begin(form)
        for _ in range(LOOK_BACK):
            back = told.rfind("\n", 0, back - 1) + 1 if back else 0
        end = told.find("\n", at)
        opens = [begin(g) for g in _START.finditer(told, back, len(told) if end < 0 else end)]
        at = opens[-1] if opens else at
    for kind, p in enumerate(_MARKS):
        places = {}
        for g in p.finditer(told, at):
            places.setdefault(begin(g), (g[1].upper(), g[2].strip(" ").replace(parser.ESCAPE + "a", parser.ESCAPE)))
        if places:
            marks = [(code, name, kind, n + 1, b) for n, (b, (code, name)) in enumerate(places.items())]
            break
    else:
        marks = [(None, None, None, 0, at)]
    out = []
    for i, (code, name, kind, n, b) in enumerate(marks):
        e = marks[i + 1][4] if i + 1 < len(marks) else len(told) + 1
        # a section's own heading doesn't end it
        body = b if kind is None else told.find("\n", b) + 1 or e
        over = _END.search(told, body, max(body, e - 1))
        stop = over.start() if over else e
        if stop > b:
            out.append((code, name, kind, n, b, stop - 1))
    return out


def extract_text(texts: DataFrame, persist=staged, site: tuple[str, ...] = parser.SITE) -> DataFrame:
    """Items and components of running text (doc_id, text; a document a row) by its sections. Marks without a code get one from their name.

    A document's sections are read where its text lies: neither lines nor sections become rows, and nothing is shuffled or staged.
    """
    ship(texts.sparkSession)

    def run(batches):
        items = parser.Items(site)
        for b in batches:
            for doc, told in zip(*[c.to_pylist() for c in b.columns]):
                found, groups, ruled = slices(told.replace(parser.ESCAPE, parser.ESCAPE + "a")) if told is not None else [], {}, False
                told = (told or "").replace(parser.ESCAPE, parser.ESCAPE + "a")
                for s in found:
                    groups.setdefault(s[0] or s[3], []).append(s)
                for g in groups.values():
                    code, name, kind, n = g[0][:4]
                    ruled |= items.add({"doc_id": doc, "deviz": code or None, "deviz_denumire": name, "kind": kind, "n": n}, "\n".join(told[a:e] for *_, a, e in g))
                if ruled:
                    lines = [(s, i, x) for s in found for i, x in enumerate(parser.unescaped(told[s[4] : s[5]]), told.count("\n", 0, s[4]))]
                    near = [(*lines[i][:2], x) for i, x in parser.near_blocks([x for _, _, x in lines])]
                    if near:
                        items.rows.append({"doc_id": doc, "near": [{"line_no": i, "s": x, "code": s[0] or None, "name": s[1], "kind": s[2], "n": s[3]} for s, i, x in near]})
                if items.full():
                    yield from items.batches()
        yield from items.batches()

    rows = texts.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, f"{parser.COLUMNS}, {parser.MORE}")
    rows = rows.withColumn("x", F.explode_outer(components.blocks_in(F.col("near")))).filter("near is null or x is not null")
    block = F.col("near").isNotNull()
    of = lambda a, b: F.when(block, F.col(a)).otherwise(F.col(b))
    name, kind, n = of("x.name", "deviz_denumire"), of("x.kind", "kind"), of("x.n", "n")
    made = F.when(kind == 1, generated_section_code("SF", name, n)).otherwise(generated_section_code("CAT", name, n))
    deviz = F.when(kind.isNull(), "DOC").otherwise(F.coalesce(of("x.code", "deviz"), made))
    return rows.select("doc_id", deviz.alias("deviz"), F.coalesce(name, F.lit("Document")).alias("deviz_denumire"), of("x.cod", "cod").alias("cod"), of("x.denumire", "denumire").alias("denumire"), of("x.um", "um").alias("um"), F.when(block, 0.0).otherwise(F.col("cantitate")).alias("cantitate"), F.when(block, True).otherwise(F.col("is_component")).alias("is_component"), F.when(block, F.col("x.line_no").cast("long")).otherwise(F.col("seq")).alias("line_no"))
