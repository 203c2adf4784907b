"""Vector code compression: product codebooks of integers, trained and applied by broadcast and exact integer products.

Vectors become integers, are cut into equal parts, and each part position has a codebook. A round broadcasts the
codebooks; Arrow batches expand squared distances into norms and an integer matrix product, take the first least entry
and add up the parts of each entry; the sums of all tasks merge by a grouped shuffle. Nothing on the driver is larger
than the codebooks, whose size is set by the length of a vector.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, joined, staged, starts_of, table

#: Parts of a vector, entries of a codebook, rounds, and integers that stand for one.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integers of distances that are held at once.
HELD = 1 << 20


def most_component(width: int) -> int:
    """The largest integer component: squared distances of parts of this width stay below 2^62, so int64 holds them."""
    return min(math.isqrt((1 << 60) // max(1, width)), (1 << 31) - 1)


def flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values (float64, null as NaN) of a list column, where each row's start, and whether a row is no list or holds what is not finite."""
    null = column.is_null().to_numpy(zero_copy_only=False)
    size = np.where(null, 0, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    at = starts_of(size)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    return flat, at, null | (bad[at[1:]] > bad[at[:-1]])


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, length: int) -> DataFrame:
    """id, label and x (int32 components as bytes) of the rows whose vector is whole, staged; shorter vectors end in zeros."""
    src = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    most = most_component(length // PARTS)

    def run(batches):
        for b in batches:
            flat, at, bad = flat_lists(col(b, "v"))
            good = np.flatnonzero(~bad)
            n = (at[1:] - at[:-1])[good]
            x = np.zeros((len(good), length), np.int32)
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.clip(np.floor(flat * SCALE), -most, most)
            if len(good):
                row, first = np.repeat(np.arange(len(good)), n), starts_of(n)
                x[row, np.arange(first[-1]) - first[row]] = whole[np.arange(first[-1]) - first[row] + at[good][row]]
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([col(b, "id").take(keep), col(b, "label").take(keep), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "label", "x"])

    kind = lambda c: src.schema[c].dataType.simpleString()
    return staged(src.mapInArrow(run, f"id {kind('id')}, label {kind('label')}, x binary"), "code-integers")


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """The vectors of a column, (rows, PARTS, width) in int64."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).astype(np.int64).reshape(-1, PARTS, length // PARTS)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the first nearest entry of the book, and the squared distance to it."""
    own = (book * book).sum(axis=1)
    entry, least = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    step = max(1, HELD // len(book))
    for a in range(0, len(x), step):
        d = own - 2 * (x[a : a + step] @ book.T)
        e = d.argmin(axis=1)
        entry[a : a + step], least[a : a + step] = e, d[np.arange(len(e)), e]
    return entry, least + (x * x).sum(axis=1)


def merged_sums(rows: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component sums and counts of what each entry of the books (parts, entries, width) is nearest to, over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    parts, entries, width = books.shape

    def run(batches):
        books = shared.value
        sums, counts = np.zeros_like(books), np.zeros((parts, entries), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(col(b, "x"), parts * width)
            for p in range(parts):
                entry, _ = nearest(x[:, p], books[p])
                order = np.argsort(entry, kind="stable")
                n = np.bincount(entry, minlength=entries)
                used = np.flatnonzero(n)
                sums[p, used] += np.add.reduceat(x[order, p], starts_of(n[used])[:-1], axis=0)
                counts[p] += n
        p, e = np.nonzero(counts)
        at = np.concatenate([((p * entries + e)[:, None] * (width + 1) + np.arange(width)).ravel(), (p * entries + e) * (width + 1) + width])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate([sums[p, e].ravel(), counts[p, e]]))], ["slot", "s"])

    got = rows.select("x").mapInArrow(run, "slot long, s long").groupBy("slot").agg(F.sum("s").alias("s")).toArrow()
    every = np.zeros(parts * entries * (width + 1), np.int64)
    every[got["slot"].to_numpy()] = got["s"].to_numpy()
    shared.unpersist()
    every = every.reshape(parts, entries, width + 1)
    return every[:, :, :width], every[:, :, width]


def train(rows: DataFrame, length: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (parts, entries, width): they start as the parts of the smallest ids and move to floored means; unused entries stay."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    books = np.ascontiguousarray(matrix(pa.array([bytes(r.x) for r in first], pa.binary()), length).transpose(1, 0, 2))
    for _ in range(rounds if len(first) else 0):
        sums, counts = merged_sums(rows, books)
        books = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, code (a byte a part, in hex) and error of every row, staged."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    parts, entries, width = books.shape
    kind = lambda c: rows.schema[c].dataType.simpleString()

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = matrix(col(b, "x"), parts * width)
                found = [nearest(x[:, p], shared.value[p]) for p in range(parts)]
                codes = np.stack([e for e, _ in found], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([col(b, "id"), col(b, "label"), pa.array([c.tobytes().hex() for c in codes]), pa.array(sum(d for _, d in found))], ["id", "label", "code", "error"])

    return staged(rows.mapInArrow(run, f"id {kind('id')}, label {kind('label')}, code string, error long"), "codes")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error) of every whole vector, and the codebooks.

    Null vectors and those that hold null or non-finite components are left out; an empty table gives no rows. The
    longest vector, rounded up to a multiple of PARTS, is the length of all: shorter ones, empty ones too, end in zeros.
    Components beyond most_component() count as that. Repeated rows are rows of their own; equal ids start the codebooks
    in the order of their vectors, null ids come last. Other columns are not read.
    """
    whole = vectors.select(F.col(id_col).alias("i"), F.col(label_col).alias("l"), F.col(vector_col).alias("v"))
    length = max(1, whole.agg(F.max(F.size("v"))).first()[0] or 0)
    length = -(-length // PARTS) * PARTS
    rows = integers(whole, "i", "v", "l", length)
    books = train(rows, length)
    if not books.shape[1]:
        return rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books
    return encoded(rows, books), books


def label_errors(codes: DataFrame) -> DataFrame:
    """codes with label_error, the errors of all rows of one label, nulls together."""
    sums = staged(codes.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"), F.count("*").alias("copies")), "code-label-errors")
    return joined(codes, sums, lambda a, b: a["label"].eqNullSafe(b["of_label"]), "left").drop("of_label", "copies")


def op11(spark, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    return label_errors(codes).select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _round(k: int) -> str:
    """Assignment by the codebooks b{k} and the codebooks b{k + 1} that follow, in SQL."""
    return f"""
a{k} AS (SELECT p, vec_id, any_value(x) AS x, min(struct_pack(d := xx - 2 * list_dot_product(x::DOUBLE[], c::DOUBLE[]) + cc, e := e)) AS m
         FROM p JOIN (SELECT p, e, c, list_dot_product(c::DOUBLE[], c::DOUBLE[]) AS cc FROM b{k}) USING (p) GROUP BY p, vec_id),
n{k} AS (SELECT p, e, list(floor(s / n)::BIGINT ORDER BY i) AS c FROM (SELECT p, m.e AS e, i, sum(x[i])::DOUBLE AS s, count(*) AS n FROM a{k}, (SELECT unnest(range(1, 1 + (SELECT any_value(w) FROM v))) AS i) GROUP BY ALL) GROUP BY p, e),
b{k + 1} AS (SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM b{k} b LEFT JOIN n{k} n ON n.p = b.p AND n.e = b.e)"""


OP11_SQL = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x, len(embedding) // 4 AS w
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, k AS p, x[k * w + 1 : (k + 1) * w] AS x, list_dot_product(x[k * w + 1 : (k + 1) * w]::DOUBLE[], x[k * w + 1 : (k + 1) * w]::DOUBLE[]) AS xx FROM v, range(4) t(k)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM p QUALIFY e < 256),
{",".join(_round(k) for k in range(5))},
r AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a4 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b4)
SELECT r.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r JOIN v ON v.vec_id = r.vec_id, h
"""
