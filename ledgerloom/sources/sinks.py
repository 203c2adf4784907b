"""Sinks: item and discrepancy files, reports by section, checkpoints, and HTML, Markdown or CSV reports."""

from __future__ import annotations

import hashlib
import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.texts import observation, shortened
from ..operators.aggregates import by_type, grouped_discrepancies, section_report


def items_json(items: DataFrame, path: str) -> None:
    items.write.mode("overwrite").json(path)


def comparison_json(rows: DataFrame, path: str) -> None:
    """Discrepancies by offer_nr."""
    rows.write.mode("overwrite").partitionBy("offer_nr").json(path)


def section_json(rows: DataFrame, ref: DataFrame, offer: DataFrame) -> DataFrame:
    """One JSON document a section: totals and discrepancies, sections in numeric order."""
    r = section_report(rows, ref, offer).join(grouped_discrepancies(rows).select("deviz", "rows"), "deviz")
    return r.orderBy(F.col("sort_key").asc_nulls_last(), "deviz").select("deviz", F.to_json(F.struct(*[c for c in r.columns if c != "sort_key"])).alias("json"))


def checkpoint_path(path: str, rules: str) -> str:
    """A path that changes with the text of the rules."""
    return f"{path}-{hashlib.md5(rules.encode()).hexdigest()[:12]}"


def write_checkpoint(df: DataFrame, path: str, rules: str) -> str:
    df.write.mode("overwrite").parquet(checkpoint_path(path, rules))
    return checkpoint_path(path, rules)


def report_rows(rows: DataFrame, width: int = 50, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of a written report in its order: by section as text, surplus rows after the others, with the text of each."""
    r = rows.withColumn("deviz", F.coalesce("ref_deviz", "oferta_deviz")).withColumn("part", F.when(F.col("tip") == "ARTICOL_EXTRA", 1).otherwise(0))
    return r.select(*keep, "deviz", "part", "tip", F.coalesce("ref_cod", "oferta_cod").alias("cod"), shortened(F.coalesce("ref_denumire", "oferta_denumire"), width).alias("denumire"), "ref_um", "oferta_um", "ref_cantitate", "oferta_cantitate", observation().alias("observatie")).orderBy("deviz", "part", "tip", "cod")


def report_html(rows: DataFrame, title: str, most: int = 100_000) -> str:
    """A page of one offer's report. Reports are read by people; one of more rows than `most` is refused rather than collected."""
    data = report_rows(rows).limit(most + 1).collect()
    if len(data) > most:
        raise ValueError(f"more than {most} rows; write report_rows() as files instead")
    head = data[0].asDict() if data else {}
    cell = lambda v: html.escape("" if v is None else str(v))
    count: dict = {}
    for r in data:
        n = count.setdefault(r.deviz, [0, 0])
        n[0] += r.tip == "ARTICOL_LIPSA"
        n[1] += r.tip == "ARTICOL_EXTRA"
    out, last = [f"<h1>{html.escape(title)}</h1>"], object()
    for r in data:
        if r.deviz != last:
            lost, more = count[r.deviz]
            out.append(("</table>" if len(out) > 1 else "") + f"<h2>{cell(r.deviz)}</h2><p>missing {lost}, surplus {more}, difference {more - lost}</p><table><tr>" + "".join(f"<th>{cell(k)}</th>" for k in head) + "</tr>")
            last = r.deviz
        out.append("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>")
    return "\n".join(out) + ("</table>" if data else "<p>no discrepancies</p>")


def report_sheets(rows: DataFrame, path: str) -> None:
    """CSV for reports of any size: a folder for each offer (offer_nr), and one with the total of each."""
    r = report_rows(rows) if "offer_nr" not in rows.columns else report_rows(rows, keep=("offer_nr",))
    w = r.write.mode("overwrite").option("header", True)
    (w.partitionBy("offer_nr") if "offer_nr" in rows.columns else w).csv(f"{path}/rows")
    by_type(rows, *[c for c in ("offer_nr",) if c in rows.columns]).write.mode("overwrite").option("header", True).csv(f"{path}/summary")
