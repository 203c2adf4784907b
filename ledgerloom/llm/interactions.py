"""Filter interaction audit: what filters remove in every order, from histograms of failure masks by a matrix product.

1. One pass over the texts gives each document a mask of the filters it fails and a 128-bit fingerprint of its text.
2. Sums by part and mask of all documents, of good ones and of toxic ones are the rows of a histogram: 32 numbers each.
3. For every order and step, integer matrices of 32 by 600 hold which masks are kept, removed, redundant or unique.
   Histogram times matrix gives all outcomes of all orders at once; texts are never read again for another order.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, raw, slices, staged, table

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
#: The bit of a text that a smaller id holds too.
COPY = 1 << FILTERS.index("E")
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
#: Parts whose outcomes are held at once, and bytes of a text whose words are.
PARTS_HELD, WORD_BYTES = 200, 4 << 20
_UPPER, _SIGNS, _LATER, _BLANK = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0)), b" \t\n\x0b\f\r"


def outcome_matrices() -> dict[str, np.ndarray]:
    """kept, removed, redundant and unique: 1 where a document of that mask (row) has that outcome at that order and step (column)."""
    out = {k: np.zeros((MASKS, len(ORDERS) * len(FILTERS)), np.int64) for k in ("kept", "removed", "redundant", "unique")}
    masks = np.arange(MASKS)
    for o, order in enumerate(ORDERS):
        gone = np.zeros(MASKS, bool)
        for s, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            fails, c = masks & bit > 0, o * len(FILTERS) + s
            out["removed"][:, c] = fails & ~gone
            out["redundant"][:, c] = fails & gone
            out["unique"][:, c] = masks == bit
            gone |= fails
            out["kept"][:, c] = ~gone
    return out


def word_counts(t: bytes) -> tuple[int, int]:
    """Words and distinct words; a long text is split a piece at a time."""
    if len(t) <= WORD_BYTES:
        w = t.split()
        return len(w), len(set(w))
    total, seen, at = 0, set(), 0
    while at < len(t):
        end = at + WORD_BYTES
        while end < len(t) and t[end] not in _BLANK:
            end += 1
        w = t[at:end].split()
        total += len(w)
        seen.update(w)
        at = end
    return total, len(seen)


def text_mask(t: bytes) -> int:
    """The bits of filters A to D that the text fails."""
    n, distinct = word_counts(t)
    upper, signs, chars = (len(t) - len(t.translate(None, x)) for x in (_UPPER, _SIGNS, _LATER))
    return (n < 50) | (100 * distinct < 65 * n) << 1 | (100 * upper > 5 * (len(t) - chars)) << 2 | (signs > 0) << 3


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """id, part, mask (bits of A to D), h1 and h2 (fingerprint of the text) and size of every document."""
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))

    def run(batches):
        import xxhash

        for b in slices(batches, "text", give_back=False):
            texts = raw(col(b, "text"))
            h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t) for t in texts), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([col(b, "id"), col(b, "part"), pa.array([text_mask(t) for t in texts], pa.int32()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array([len(t) for t in texts], pa.int64())], ["id", "part", "mask", "h1", "h2", "size"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, part string, mask int, h1 long, h2 long, size long")


def with_labels(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """rows with good and toxic, true where any label of the id says so. Rows without id have no label and take no part in the join."""
    of = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    named = rows.filter("id is not null").join(of, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    return named.unionByName(rows.filter("id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)}))


def histogram(rows: DataFrame) -> DataFrame:
    """part, mask with the bit of E, n, good and toxic: how many documents of a part have the mask.

    All documents of one text fail E but those of its least id. So the documents of every text are counted as failing,
    and what the least id of each text holds is moved: no row is joined with its copies, however many they are.
    """
    keys = ["part", "mask", "good", "toxic"]
    # rows of an id that repeats with one text: a count for each part, as a list no longer than the parts of that id
    own = staged(rows.groupBy("id", "h1", "h2", "size", *keys).agg(F.count("*").alias("n")), "interactions-rows")
    every = own.groupBy(*keys).agg(F.sum("n").alias("n"))
    held = own.groupBy("id", "h1", "h2", "size").agg(F.collect_list(F.struct(*keys, "n")).alias("rows"))
    first = held.groupBy("h1", "h2", "size").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "rows")).alias("f")).select(F.inline("f.rows")).groupBy(*keys).agg(F.sum("n").alias("n"))
    moved = every.select("part", F.col("mask").bitwiseOR(F.lit(COPY)).alias("mask"), "good", "toxic", "n")
    moved = moved.union(first.select("part", F.col("mask").bitwiseOR(F.lit(COPY)).alias("mask"), "good", "toxic", -F.col("n"))).union(first.select("part", "mask", "good", "toxic", "n"))
    at = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))
    return moved.groupBy("part", "mask").agg(F.sum("n").alias("n"), at("good").alias("good"), at("toxic").alias("toxic"))


def outcomes(hist: DataFrame) -> DataFrame:
    """part, filter_order, step and COUNTS for every part, order and step, from a histogram (part, mask, n, good, toxic)."""
    rows = hist.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("h"))

    def run(batches):
        m = outcome_matrices()
        orders, steps = np.repeat(ORDERS, len(FILTERS)), np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))
        letter = np.array([FILTERS.index(x) for o in ORDERS for x in o])
        of_letter = (letter[:, None] == np.arange(len(FILTERS))).astype(np.int64)
        for whole in batches:
            for a in range(0, whole.num_rows, PARTS_HELD):
                b = whole.slice(a, PARTS_HELD)
                h = np.zeros((3, b.num_rows, MASKS), np.int64)
                for i, row in enumerate(col(b, "h").to_pylist()):
                    for x in row:
                        h[:, i, x["mask"]] += (x["n"], x["good"], x["toxic"])
                removed = h @ m["removed"]
                counts = [h[0] @ m["kept"], removed[0], h[0] @ m["redundant"], h[0] @ m["unique"], removed[1], removed[2], (removed[0] @ of_letter)[:, letter]]
                part = col(b, "part").take(pa.array(np.repeat(np.arange(b.num_rows), len(orders))))
                yield pa.RecordBatch.from_arrays([part, pa.array(np.tile(orders, b.num_rows)), pa.array(np.tile(steps, b.num_rows)), *[pa.array(c.ravel()) for c in counts]], ["part", "filter_order", "step", *COUNTS])

    return rows.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The outcomes of filters A to E over docs, by part_col, in all orders.

    Null texts count as empty, null parts as the empty string. Of equal texts, those of the least id pass E, all rows of
    that id alike; rows without id come after any id and are equal to one another. An id has a label if any row of
    `labels` gives it one. No documents give no rows. Other columns are not read.
    """
    return outcomes(histogram(with_labels(masked(docs, id_col, text_col, part_col), labels)))


def op12(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM t),
l AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
              regexp_matches(t, '[#$%&*|]'), w.doc_id > min(w.doc_id) OVER (PARTITION BY t)] AS f FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
h AS (SELECT part, f, count(*) AS n, sum(good) AS g, sum(toxic) AS x FROM m GROUP BY part, f),
k AS (SELECT unnest(range(1, 6)) AS k),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT o, step, o[step] AS own, o[1:step - 1] AS before, array_to_string(list_transform(o, lambda i: substr('ABCDE', i::INT, 1)), '') AS filter_order FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, own,
             sum(n) FILTER (NOT f[own] AND NOT list_bool_or(list_transform(before, lambda i: f[i]) || [false])) AS kept,
             sum(n) FILTER (f[own] AND NOT list_bool_or(list_transform(before, lambda i: f[i]) || [false])) AS removed,
             sum(n) FILTER (f[own] AND list_bool_or(list_transform(before, lambda i: f[i]) || [false])) AS redundant,
             sum(n) FILTER (f[own] AND len(list_filter(f, lambda y: y)) = 1) AS unique_fails,
             sum(g) FILTER (f[own] AND NOT list_bool_or(list_transform(before, lambda i: f[i]) || [false])) AS good_lost,
             sum(x) FILTER (f[own] AND NOT list_bool_or(list_transform(before, lambda i: f[i]) || [false])) AS toxic_lost
      FROM h, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley FROM r
"""
