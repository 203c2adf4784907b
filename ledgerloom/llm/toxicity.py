"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, of neighbouring words, and of words with one between them.
FTRL-proximal gives every coordinate its own rate and sets weights to exactly zero where their evidence stays within
the L1 bound, so the model is a few weights in a table of fixed size that is broadcast. Training streams a bounded
sample of labelled rows, in a fixed order, through one task that holds only that table; scoring covers all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import ascending, col, mix64, plain_names, raw, remainder, slices, staged, table, without

#: Bits of a feature's hash; the table of weights has so many rows, the bias aside.
BITS = 20
_TO_BLANK = bytes(32 if not (48 <= b < 58 or 97 <= b < 123 or b >= 128) else b for b in range(256))
PLAIN = bytes(_TO_BLANK[b + 32] if 65 <= b < 91 else _TO_BLANK[b] for b in range(256))


@dataclass(frozen=True)
class Model:
    """Weights by feature and the bias."""

    weights: np.ndarray
    bias: float


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Document and feature of every word, pair and skip-gram of the texts (not distinct)."""
    import zlib

    words = [t.translate(PLAIN).split() for t in texts]
    lens = np.array([len(w) for w in words], np.int64)
    n = int(lens.sum())
    h = np.fromiter((zlib.crc32(x) for w in words for x in w), np.uint64, n)
    doc = np.repeat(np.arange(len(texts)), lens)
    mask = np.uint64((1 << BITS) - 1)
    feats, docs = [mix64(h) & mask], [doc]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if n > gap:
            same = np.flatnonzero(doc[gap:] == doc[:-gap])
            feats.append(mix64(h[same] * np.uint64(salt) + (h[same + gap] << np.uint64(17))) & mask)
            docs.append(doc[same])
    return np.concatenate(docs), np.concatenate(feats).astype(np.int64)


def scores(model: Model, texts: list[bytes]) -> np.ndarray:
    doc, f = features(texts)
    hot = np.flatnonzero(model.weights[f])
    key = ascending(doc[hot] << BITS | f[hot])
    total = np.bincount(key >> BITS, model.weights[key & ((1 << BITS) - 1)], len(texts)) + model.bias
    return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", alpha: float = 1.0, beta: float = 1.0, l1: float = 3.0, l2: float = 1.0, passes: int = 3) -> Model:
    """Fits on about `rows` labelled documents at most, those of the least hashes of their ids, each read `passes` times.

    labels may repeat an id (the larger label holds); null labels and ids without a document are left out. Without any
    labelled document every score is the bias's, 0.5.
    """
    lab = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    lab = staged(lab, "toxicity-labels")
    n_labels = max(1, lab.count())
    share = min(1.0, rows / n_labels)
    lab = lab.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(lab), "id")

    def extract(batches):
        for b in slices(batches, "text"):
            doc, f = features(raw(col(b, "text")))
            key = ascending(doc << BITS | f)
            at = np.searchsorted(key >> BITS, np.arange(b.num_rows + 1))
            own = (key & ((1 << BITS) - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([col(b, "h"), col(b, "y"), pa.array([own[x:y].tobytes() for x, y in zip(at, at[1:])], pa.binary())], ["h", "y", "f"])

    found = src.withColumn("h", F.xxhash64("id")).select("h", "y", "text").mapInArrow(extract, "h long, y int, f binary")
    found = found.withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(passes))))

    def fit(batches):
        z, n, bz, bn = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0
        for b in batches:
            for y, x in zip(col(b, "y").to_pylist(), col(b, "f").to_pylist()):
                i = np.frombuffer(x, np.int32)
                zi, root = z[i], np.sqrt(n[i])
                w = np.where(np.abs(zi) > l1, (np.sign(zi) * l1 - zi) / ((beta + root) / alpha + l2), 0.0)
                bias = -bz / ((beta + bn**0.5) / alpha)
                p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
                g = p - y
                z[i] = zi + g - (np.sqrt(n[i] + g * g) - root) / alpha * w
                n[i] += g * g
                bz += g - ((bn + g * g) ** 0.5 - bn**0.5) / alpha * bias
                bn += g * g
        w = np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w[at], -bz / ((beta + bn**0.5) / alpha)))], ["i", "w"])

    got = found.repartitionByRange(1, "h").sortWithinPartitions("pass", "h", "y", "f").mapInArrow(fit, "i long, w double").toArrow()
    i, w = got["i"].to_numpy(), got["w"].to_numpy()
    weights = np.zeros(1 << BITS)
    weights[i[i >= 0]] = w[i >= 0]
    return Model(weights, float(w[i < 0].sum()))


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with the score of each whole text, 0 to 1 (a column of that name is replaced); null and empty texts have the bias's."""
    src, named = plain_names(without(docs, out_col))
    shared = src.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in slices(batches, text_col):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores(shared.value, raw(col(b, text_col))))], [*b.schema.names, out_col])

    return named(src.mapInArrow(run, StructType([*src.schema.fields]).add(out_col, DoubleType())))


def op2(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(remainder("doc_id", 4) != 2))
    out = score(docs, model)
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
