"""One or many offers against a reference, end to end: cleaning, alignment of sections, reconciliation, alerts and summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import strip_plus, text
from ..session import staged
from . import components, extraction, matching, sections
from .aggregates import suspicious_extras
from .providers import Provider


def with_codes(items: DataFrame) -> DataFrame:
    """Items that have a code, without the plus signs at its end."""
    return items.filter(text("cod") != "").withColumn("cod", strip_plus("cod"))


def described(items: DataFrame) -> DataFrame:
    """Items but for those whose code starts with a dollar sign and that have no description."""
    return items.filter(~(F.col("cod").startswith("$") & (text("denumire") == "")))


def aligned(ref: DataFrame, offer: DataFrame) -> DataFrame:
    """The offer's items under the reference's sections: by code or name, then by their codes where that left a section the reference lacks."""
    side = lambda x: sections.first_names(x).select("deviz", "denumire", "first")
    mapping = sections.map_by_name(side(ref), side(offer))
    moved = sections.remap(offer, mapping.select("offer_deviz", "ref_deviz"))
    open_ = moved.select("deviz").distinct().join(ref.select("deviz").distinct(), "deviz", "left_anti")
    return sections.remap_by_code(moved, ref, open_).drop("deviz_original")


def equalled(ref: DataFrame, offer: DataFrame, least: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """The offer's items with sections renamed whose codes nearly all stand in one of the reference's, and every equivalence found."""
    found = sections.equivalences(ref, offer)
    sure = found.filter(F.col("overlap_score") >= least).select(F.col("oferta_deviz").alias("offer_deviz"), "ref_deviz")
    return sections.remap(offer, sure).drop("deviz_original"), found


@dataclass
class Comparison:
    """What a comparison gives: matches, discrepancies, equivalent sections, sections that one side has alone, component anomalies."""

    pairs: DataFrame
    discrepancies: DataFrame
    mismatches: DataFrame
    sections: DataFrame
    anomalies: DataFrame


def compare(ref: DataFrame, offer: DataFrame, ref_lines: DataFrame | None = None, provider: Provider | None = None, prices: bool = False, mode: str = "strict", fmt: str = "UNKNOWN", confidence: float = 0.0, persist=staged) -> Comparison:
    """One offer's items against the reference's: ITEM on both sides. ref_lines (content) flag surplus codes that the reference's text holds.

    Sections are aligned by code, name and items, their names then are the reference's where they mean the same, and
    sections of nearly the same codes count as equal. Component codes that the reference lacks come as discrepancies too.
    """
    clean = persist(described(aligned(ref, with_codes(offer))), "offer-aligned")
    clean = persist(sections.renamed(ref, sections.fill_names(clean), provider), "offer-renamed")
    named, mismatches = equalled(ref, clean)
    named = persist(named, "offer-equalled")
    pairs, every = matching.reconcile(ref, named, prices=prices, mode=mode, persist=persist, provider=provider)
    found = matching.final_discrepancies(every)
    if ref_lines is not None:
        found = suspicious_extras(found, ref_lines, ref)
        found = found.withColumn("posibil_omis_din_extractie", F.col("posibil_omis_din_extractie") & (F.col("tip") == "ARTICOL_EXTRA"))
    strange = persist(components.anomalies(ref, named, fmt, confidence), "anomalies")
    found = found.unionByName(components.anomaly_rows(strange), allowMissingColumns=True)
    return Comparison(pairs, persist(found, "discrepancies"), mismatches, sections.differences(ref, named), strange)


def offer_summary(rows: DataFrame, checks: DataFrame | None = None, most: float = 0.3) -> DataFrame:
    """offer_nr, total, missing, surplus, others and, where checks (offer_nr, suspect of checked items) reach a part of 0.3, a systemic alert."""
    n = rows.groupBy("offer_nr").agg(F.count("*").alias("total"), F.count_if(F.col("tip") == "ARTICOL_LIPSA").alias("missing"), F.count_if(F.col("tip") == "ARTICOL_EXTRA").alias("surplus")).withColumn("others", F.col("total") - F.col("missing") - F.col("surplus"))
    if checks is None:
        return n.withColumn("suspect_part", F.lit(None).cast("double")).withColumn("systemic", F.lit(False))
    c = checks.groupBy("offer_nr").agg(F.avg(F.col("suspect").cast("double")).alias("suspect_part"))
    return n.join(c, "offer_nr", "left").withColumn("systemic", F.coalesce(F.col("suspect_part") >= most, F.lit(False)))


def sections_in_order(rows: DataFrame, section: str = "deviz") -> DataFrame:
    """rows by section, those without one last."""
    return rows.orderBy(F.when(text(section) == "", 1).otherwise(0), text(section))


def reconcile_documents(docs: DataFrame, provider: Provider | None = None, prices: bool = False, mode: str = "strict", persist=staged) -> dict[int, Comparison]:
    """OCR documents in, a comparison for each offer number out.

    Offers are taken in the order of their names. Sections that only one side has are looked for again in the other's
    pages; what the reference gains so stays for the next offers.
    """
    from ..sources import ocr

    ref_docs = ocr.reference(docs)
    ref_pages = persist(extraction.rescued(extraction.classified(ref_docs, provider=provider), provider), "reference-pages")
    ref = persist(sections.fill_names(with_codes(extraction.extract(ref_docs, provider=provider, persist=persist))), "reference-items")
    ref_lines = extraction.lines_of(ref_pages)
    fmt = extraction.component_formats(ref_pages).select("format", "confidence").first()
    out: dict[int, Comparison] = {}
    names = [(r.doc_id, r.offer_nr) for r in ocr.offers(docs).select("doc_id", "offer_nr").collect()]  # one row an offer
    for doc_id, nr in names:
        own = docs.filter(F.col("doc_id") == doc_id)
        own_pages = persist(extraction.rescued(extraction.classified(own, ref, provider), provider), "offer-pages")
        offer = persist(sections.fill_names(extraction.extract(own, ref, provider, persist)), "offer-items")
        codes = lambda x: x.select("deviz").filter(text("deviz") != "").distinct()
        extra = codes(offer).join(codes(ref), "deviz", "left_anti").select(F.lit("di_referinta").alias("doc_id"), F.col("deviz").alias("target"))
        lost = codes(ref).join(codes(offer), "deviz", "left_anti").select(F.lit(doc_id).alias("doc_id"), F.col("deviz").alias("target"))
        ref = persist(sections.fill_names(extraction.rescan(ref_pages, ref, extra, persist)[0]), "reference-items")
        offer = persist(sections.fill_names(extraction.rescan(own_pages, offer, lost, persist)[0]), "offer-items")
        out[nr] = compare(ref, offer, ref_lines, provider, prices, mode, fmt["format"] if fmt else "UNKNOWN", fmt["confidence"] if fmt else 0.0, persist)
    return out
