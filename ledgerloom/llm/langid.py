"""Language identification by multilingual mixture inference.

Every word has a likelihood under each language, from hashed byte trigrams counted over all training texts. For a whole
text, expectation-maximisation estimates the proportions of languages among its words; then the sets of its one, two,
three ... most likely languages are compared by likelihood less half a logarithm of the number of words for each
language, for as long as a larger set can still win, and the best set's proportions are the answer. A language's table
is a file of fixed size in the shared folder, so any number of them may be learned.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

from .common import col, get, mix64, plain_names, put, raw, remainder, scratch, slices, staged, starts_of, table, without

#: Slots of trigrams, and weight of a slot's prior count.
SLOTS, PRIOR = 1 << 16, 0.5
#: Steps of expectation-maximisation over all languages and over each set.
STEPS, SET_STEPS = 8, 6
#: Words times languages that are held at once, and languages that a process keeps open.
CELLS, OPEN = 1 << 21, 256


@dataclass(frozen=True)
class Model:
    """Languages in order of their names, and the file of each: the logarithm of every slot's probability."""

    langs: list[str]
    paths: list[str]


@lru_cache(maxsize=OPEN)
def _log_p(path: str) -> np.ndarray:
    """The logarithms of a language, and a zero for blanks behind them."""
    return np.append(np.frombuffer(get(path), np.float32), np.float32(0))


def _trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slot of the trigram around every byte (-1 at blanks), where each word starts, and words by text."""
    words = [t.lower().split() for t in texts]
    flat = [x for w in words for x in w]
    joined = np.frombuffer(b" " + b" ".join(flat) + b" ", np.uint8).astype(np.uint64)
    key = joined[:-2] | (joined[1:-1] << np.uint64(8)) | (joined[2:] << np.uint64(16))
    slot = (mix64(key) & np.uint64(SLOTS - 1)).astype(np.int64)
    slot[joined[1:-1] == 32] = -1
    lens = np.fromiter(map(len, flat), np.int64, len(flat))
    return slot, starts_of(lens + 1)[:-1], np.array([len(w) for w in words], np.int64)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts the trigrams of all texts by language. Null texts and null languages teach nothing."""
    src = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for b in slices(batches, "text"):
            langs, texts = np.array(col(b, "lang").to_pylist(), object), raw(col(b, "text"))
            for lang in sorted(set(langs)):
                slot, _, _ = _trigrams([texts[i] for i in np.flatnonzero(langs == lang)])
                c = seen.setdefault(lang, np.zeros(SLOTS, np.int64))
                c += np.bincount(slot[slot >= 0], minlength=SLOTS)
        for lang, c in seen.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "slot", "n"])

    rows = src.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    packed = rows.groupBy("lang").agg(F.collect_list(F.struct("slot", "n")).alias("a"))
    folder = scratch(docs.sparkSession, "language-model")

    def write(batches):
        for b in batches:
            paths = []
            for lang, a in zip(col(b, "lang").to_pylist(), col(b, "a")):
                c = np.full(SLOTS, PRIOR)
                c[a.values.field("slot").to_numpy()] += a.values.field("n").to_numpy()
                paths.append(f"{folder}/{hashlib.sha256(lang.encode()).hexdigest()}")
                put(paths[-1], np.log(c / c.sum()).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([col(b, "lang"), pa.array(paths, pa.string())], ["lang", "path"])

    found = sorted(tuple(r) for r in staged(packed.mapInArrow(write, "lang string, path string"), "language-files").collect())
    return Model([x for x, _ in found], [p for _, p in found])


def _infer(parts, n: np.ndarray, n_langs: int) -> np.ndarray:
    """Proportions of texts of n words. parts(active) gives, block by block, the words' likelihoods, the place of each word's
    text among the active ones, and where each of these starts."""

    def steps(active, pi, k):
        for _ in range(k):
            total = np.zeros_like(pi)
            for like, doc, start in parts(active):
                r = like * pi[doc]
                r /= r.sum(1, keepdims=True)
                total += np.add.reduceat(r, start, axis=0)
            pi = total / n[active][:, None]
        return pi

    def value(active, pi):
        return sum(np.add.reduceat(np.log((like * pi[doc]).sum(1)), start) for like, doc, start in parts(active))

    active = np.arange(len(n))
    every = steps(active, np.full((len(n), n_langs), 1 / n_langs), STEPS)
    order = np.argsort(-every, axis=1, kind="stable")
    gain = sum(np.add.reduceat(like / (like * every[doc]).sum(1)[:, None], start, axis=0) for like, doc, start in parts(active))
    # by concavity no proportions reach more than this, and no log-likelihood is above zero
    most = np.minimum(value(active, every) + n * np.log((gain / n[:, None]).max(1)), 0)
    best, best_value = np.zeros_like(every), np.full(len(n), -np.inf)
    for k in range(1, n_langs + 1):
        active = np.flatnonzero(best_value < most - 0.5 * k * np.log(n + 1))
        if not len(active):
            break
        pi = np.zeros((len(active), n_langs))
        top = order[active, :k]
        np.put_along_axis(pi, top, np.take_along_axis(every[active], top, 1) + 1e-6, axis=1)
        pi /= pi.sum(1, keepdims=True)
        if k > 1:
            pi = steps(active, pi, SET_STEPS)
        now = value(active, pi) - 0.5 * k * np.log(n[active] + 1)
        better = now > best_value[active]
        best[active[better]], best_value[active[better]] = pi[better], now[better]
    return best


def infer(model: Model, texts: list[bytes]) -> np.ndarray:
    """Proportions of the languages in each text; zero for all where a text has no words.

    Texts are taken together up to CELLS words times languages; a longer text is read again in blocks of that size.
    """
    out = np.zeros((len(texts), len(model.langs)))
    slot, at, per_doc = _trigrams(texts)
    full = np.flatnonzero(per_doc)
    if not len(full) or not model.langs:
        return out
    ends, first = np.append(at, len(slot)), starts_of(per_doc[full])
    most = max(1, CELLS // len(model.langs))

    def likelihoods(x: int, y: int) -> np.ndarray:
        s, a = slot[ends[x] : ends[y]], at[x:y] - at[x]
        log_like = np.empty((y - x, len(model.langs)))
        for k, path in enumerate(model.paths):
            log_like[:, k] = np.add.reduceat(_log_p(path)[s], a)
        return np.exp(np.maximum(log_like - log_like.max(1, keepdims=True), -60))

    a = 0
    while a < len(full):
        e = max(a + 1, int(np.searchsorted(first, first[a] + most, side="right")) - 1)
        n, low, high = per_doc[full[a:e]], int(first[a]), int(first[e])
        if high - low > most:  # one long text

            def parts(active, low=low, high=high):
                for x in range(low, high, most):
                    y = min(x + most, high)
                    yield likelihoods(x, y), np.zeros(y - x, np.int64), np.zeros(1, np.int64)
        else:
            like, doc = likelihoods(low, high), np.repeat(np.arange(e - a), n)
            held: dict[int, tuple] = {}

            def parts(active, like=like, doc=doc, n=n, held=held):
                if len(active) not in held:  # active texts only ever get fewer
                    held.clear()
                    some = np.isin(doc, active)
                    held[len(active)] = (like if some.all() else like[some], np.repeat(np.arange(len(active)), n[active]), starts_of(n[active])[:-1])
                yield held[len(active)]

        out[full[a:e]] = _infer(parts, n, len(model.langs))
        a = e
    return out


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (its proportion) and languages (all of the chosen set); columns of these names are replaced.

    A null text, or one without letters, is `und` with score 0 and no languages.
    """
    src, named = plain_names(without(docs, "lang_pred", "score", "languages"))
    shared = src.sparkSession.sparkContext.broadcast(model)
    pair = StructType().add("lang", StringType()).add("share", DoubleType())
    schema = StructType([*src.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType()).add("languages", ArrayType(pair))

    def run(batches):
        m = shared.value
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        for b in slices(batches, text_col, 1 << 20):
            texts = raw(col(b, text_col))
            pi = infer(m, texts)
            pred, score, every = [], [], []
            for t, p in zip(texts, pi):
                i = int(p.argmax()) if len(p) else 0
                if len(p) and p[i] > 0 and any(map(str.isalpha, t.decode())):
                    pred.append(m.langs[i])
                    score.append(min(1.0, float(p[i])))
                    every.append([{"lang": m.langs[j], "share": float(p[j])} for j in np.argsort(-p, kind="stable") if p[j] > 0])
                else:
                    pred.append("und")
                    score.append(0.0)
                    every.append([])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(every, kind)], schema.names)

    return named(src.mapInArrow(run, schema))


def op9(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    model = train(docs.filter(remainder("doc_id", 4) != 2))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
