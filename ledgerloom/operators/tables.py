"""Item rows from layout tables, their sections by the nearest table before, and the merge with rows from lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import clean_table_code, normalize_section, text
from ..functions.texts import dollared, item_cell, plain_description
from ..functions.units import table_quantity, table_unit
from ..session import ship


def cells(docs: DataFrame) -> DataFrame:
    """doc_id, table_idx, row_index, column_index and content."""
    t = docs.select("doc_id", F.posexplode("tables").alias("table_idx", "t"))
    return t.select("doc_id", "table_idx", F.explode("t.cells").alias("c")).select("doc_id", "table_idx", "c.row_index", "c.column_index", text("c.content").alias("content"))


# A section in a metadata table, in a bid's cell, and in a table's own head; codes of a column of their own.
META, BID, HEADED = r"^([A-Z0-9]{5,8})\s+(.+)$", r"(?i)oferta\s+([A-Z0-9]{5,8})\s+(.+)", r"(?i)^STADIUL\s+FIZIC\s*:\s*([A-Z0-9.]+)\s+(.+)"
CODE_CELL = r"^(\$?\d{4,8}|[A-Z]{1,3}\d{1,4}[A-Z]?\d{0,2})\b"


def table_sections(c: DataFrame) -> DataFrame:
    """doc_id, table_idx, code and name of each data table: the section in its own head, else the nearest metadata table's before it; tables without either are left out.

    Metadata are the sixth row's cells `STADIUL ...` and `CODE NAME`, or a cell `oferta CODE NAME` anywhere. A data table has
    the technical section, the chapter or the quantity in its first row, or a physical stage with code and name; the first of
    these in the order of its columns tells.
    """
    key = ["doc_id", "table_idx"]
    at = lambda r, k: F.max(F.when((F.col("row_index") == r) & (F.col("column_index") == k), F.col("content")))
    up = F.upper("content")
    place = F.struct("row_index", "column_index")
    bid = F.min_by(up, F.when(up.rlike(BID), place))
    sign = F.when(up.contains("SECTIUNEA") | up.contains("CAPITOLUL") | up.contains("CANTITATE"), F.struct(F.lit("").alias("code"), F.lit("").alias("name"))).when(F.col("content").rlike(HEADED), F.struct(F.regexp_extract("content", HEADED, 1).alias("code"), F.trim(F.regexp_extract("content", HEADED, 2)).alias("name")))
    t = c.withColumn("sign", F.when(F.col("row_index") == 0, sign))
    t = t.groupBy(*key).agg(at(5, 0).alias("a"), at(5, 1).alias("b"), bid.alias("o"), F.min_by("sign", F.when(F.col("sign").isNotNull(), F.col("column_index"))).alias("sign"))
    told = lambda col, pattern: F.struct(normalize_section(F.upper(F.regexp_extract(col, pattern, 1))).alias("code"), F.trim(F.regexp_extract(col, pattern, 2)).alias("name"))
    meta = F.when(F.upper("a").contains("STADIUL") & F.col("b").rlike(META), told("b", META)).when(F.col("o").isNotNull(), told("o", BID))
    before = Window.partitionBy("doc_id").orderBy("table_idx").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("m", meta).withColumn("s", F.coalesce(F.when(F.col("sign.code") != "", F.col("sign")), F.last("m", ignorenulls=True).over(before)))
    return t.filter("sign is not null and s is not null").select(*key, "s.code", "s.name")


def table_roles(c: DataFrame) -> DataFrame:
    """doc_id, table_idx, den, um, qty (columns), code (the column of codes) and apart (whether descriptions stand in the next column).

    Row 1 names the columns. Where it has no column of descriptions, they are 1, 4 and 3 if the first row of items has a code
    and a number there; a table whose columns stay open has no items. An empty head before that of the descriptions is the
    column of codes. Codes stand apart if the first row of items has a text behind them, under that head or under none.
    """
    key = ["doc_id", "table_idx"]
    h = F.upper("content")
    role = F.when(h.contains("NR") | (h == "0"), "nr").when(h.contains("CAPITOL") | h.contains("DENUMIRE"), "den").when(h.contains("U.M") | h.contains("UM"), "um").when(h.contains("CANTITAT") | (h == "3"), "qty")
    of = lambda name: F.max(F.when(F.col("role") == name, F.col("column_index")))
    row = lambda cells: F.map_from_entries(F.array_sort(F.collect_list(cells)))
    heads = c.filter("row_index = 1").withColumn("role", role).groupBy(*key).agg(of("den").alias("den"), of("um").alias("um"), of("qty").alias("qty"), row(F.struct("column_index", "content")).alias("heads"))
    firsts = c.filter("row_index > 2").groupBy(*key, "row_index").agg(row(F.struct("column_index", "content")).alias("r")).groupBy(*key).agg(F.min_by("r", "row_index").alias("r"))
    t = heads.join(firsts, key)
    cell = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(""))
    loose = F.col("den").isNull() & F.upper(cell("r", F.lit(1))).rlike("^[A-Z0-9]") & cell("r", F.lit(3)).rlike(r"\d")
    t = t.withColumn("loose", loose).withColumns({c: F.when(F.col("loose"), F.lit(k)).otherwise(F.col(c)) for c, k in (("den", 1), ("um", 4), ("qty", 3))}).filter("den is not null and um is not null and qty is not null")
    bare = (F.col("den") > 0) & (cell("heads", F.col("den") - 1) == "")
    t = t.withColumn("bare", bare).withColumn("code", F.when(F.col("bare"), F.col("den") - 1).otherwise(F.col("den")))
    headless = ~F.map_contains_key("heads", F.col("code") + 1)
    return t.select(*key, "den", "um", "qty", "code", ((cell("r", F.col("code") + 1) != "") & (F.col("bare") | headless)).alias("apart"))


def table_items(c: DataFrame) -> DataFrame:
    """Items of data tables, rows from 3 on: code and description in one cell, or in columns of their own (table_roles)."""
    key = ["doc_id", "table_idx"]
    rows = c.filter("row_index > 2").groupBy(*key, "row_index").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("column_index", "content")))).alias("r"))
    j = rows.join(table_roles(c), key).join(table_sections(c).withColumnsRenamed({"code": "section"}), key)
    cell = lambda k: text(F.try_element_at("r", k))
    j = j.withColumns({"one": cell(F.col("den")), "coded": F.upper(cell(F.col("code"))), "told": cell(F.col("code") + 1), "unit": cell(F.col("um")), "amount": cell(F.col("qty"))})
    both, own = item_cell("one"), F.regexp_extract("coded", CODE_CELL, 1)
    code = F.when(F.col("apart"), dollared(F.when(own != "", own).otherwise(clean_table_code("coded")))).otherwise(clean_table_code(both["code"]))
    den = F.when(F.col("apart"), F.col("told")).otherwise(both["description"])
    out = j.select(*key, "row_index", code.alias("cod"), plain_description(den).alias("denumire"), F.lower(table_unit("amount", "unit")).alias("um"), table_quantity("amount").alias("cantitate"), F.col("section").alias("deviz"), F.col("name").alias("deviz_denumire"))
    return out.filter("cod <> ''")


def upserted(rows: list[dict]) -> list[dict]:
    """The rows of one key, those of lines first, after the merge: see merge(). One look-up a row, whatever the key's size."""
    out: list[dict] = []
    seen: set[tuple] = set()
    place: dict = {}
    empty = None
    for r in rows:
        q, mark = r["cantitate"] or 0.0, (r["um"], r["cantitate"] or 0.0)
        if mark in seen:
            continue
        seen.add(mark)
        if r["side"] == 1 and q in place:
            out[place[q]] = r
        elif r["side"] == 1 and q and empty is not None:
            out[empty] = r
            place[q] = empty
            place.pop(0.0, None)
            empty = None
        else:
            place[q] = len(out)
            if r["side"] == 0 and not q:
                empty = len(out)
            out.append(r)
    return out


def merge(line_items: DataFrame, table_rows: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Items of lines and tables: an equal (section, code, unit, quantity) is skipped, a table row replaces the last row of its quantity, or once the last line without one, and others are added.

    `scope` adds columns to the key. Keys whose lines all have quantities follow a closed form: of the first rows of each
    unit and quantity, the last table row stands for all others and for the last line. Only keys with a line without
    quantity are grouped in Python.
    """
    ship(line_items.sparkSession)
    key = [*scope, "deviz", "cod"]
    cols = [*key, "um", "cantitate", "denumire", "seq"]
    both = line_items.select(*cols, F.lit(0).alias("side")).unionByName(table_rows.select(*cols, F.lit(1).alias("side")))
    zero = both.filter("side = 0 and coalesce(cantitate, 0) = 0").select(*key).distinct()
    plain = both.join(zero, key, "left_anti")
    w = Window.partitionBy(*key, "cantitate", "um").orderBy("side", "seq")
    firsts = plain.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    same = Window.partitionBy(*key, "cantitate")
    last = Window.partitionBy(*key, "cantitate", "side").orderBy(F.col("seq").desc())
    closed = firsts.withColumn("__n", F.row_number().over(last)).withColumn("__t", F.max("side").over(same))
    closed = closed.filter("__t = 0 OR (side = 1) = (__n = 1)").drop("__n", "__t")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(upserted(g.sort_values(["side", "seq"]).to_dict("records")), columns=[*cols, "side"])

    hard = both.join(zero, key, "left_semi").groupBy(*key).applyInPandas(run, both.schema)
    return closed.unionByName(hard)


def nearest_before(rows: DataFrame, is_mark, value, key: str, order: list[str]) -> DataFrame:
    """rows with `linked`: the value of the nearest mark before each."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("linked", F.last(F.when(is_mark, value), ignorenulls=True).over(w))
