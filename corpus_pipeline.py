"""A training-data pipeline over `documents`: reject toxic texts, keep one of each group of near copies, cut repeated
passages, mix sources to target weights, and encode.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame that is
written and read again before the next. All but the last return the columns of documents. Null and empty texts pass
every stage; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, common, minhash, mixing, substrings, toxicity

#: Scores from which a text counts as toxic.
TOXIC = 0.3


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a score of TOXIC or more, under a model of the labels of documents still here."""
    common.ship(spark)
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    kept = toxicity.score(_carried(docs, "text"), model).filter(F.col("score") < TOXIC)
    return _restored(kept, docs, text=F.col("text"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id in every group of near copies (five words, similarity 0.8 or more)."""
    common.ship(spark)
    return minhash.keep_one(docs)


def _carried(docs: DataFrame, *used: str) -> DataFrame:
    """docs as the columns that an operator reads and all others in one struct, so that none clashes with what it adds."""
    rest = [c for c in docs.columns if c not in used]
    return docs.select(*used, F.struct(F.lit(0).alias("_"), *[common.quoted([c])[0].alias(f"c{i}") for i, c in enumerate(rest)]).alias("__row"))


def _restored(out: DataFrame, docs: DataFrame, **new) -> DataFrame:
    """The columns of docs again, in their order; `new` gives those that are not as they were carried."""
    place = {c: i for i, c in enumerate(c for c in docs.columns if c not in new)}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"__row.c{place[c]}").alias(c) for c in docs.columns])


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that stand elsewhere too; a document of nothing else goes, others keep the rest.

    n_chars, where there is such a column, follows the text.
    """
    common.ship(spark)
    cut = substrings.dedup(_carried(docs, *[c for c in ("text", "n_chars") if c in docs.columns]), window=50)
    cut = cut.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return _restored(cut, docs, **new)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or twice."""
    common.ship(spark)
    mixed = mixing.mix(_carried(docs, "doc_id", "text", "source"))
    taken = mixed.withColumn("__copy", F.explode(F.expr("CASE WHEN copies > 0 THEN sequence(1, copies) END")))
    return _restored(taken, docs, doc_id=F.col("doc_id"), text=F.col("text"), source=F.col("source"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids, and whether decoding them gives the text again."""
    common.ship(spark)
    out = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"))
    return out.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "exact")


STAGES = [("toxicity", reject_toxic), ("near copies", drop_near_copies), ("repeated passages", cut_passages), ("source mix", mix_sources), ("BPE", encode)]

#: SQL can't express the trained classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
