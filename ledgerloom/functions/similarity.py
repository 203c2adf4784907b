"""Similarities: token overlaps as column expressions, sequence-matcher ratios as Arrow-batched functions."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .codes import text


def _tokens(c, pattern: str, least: int = 1) -> Column:
    found = F.regexp_extract_all(F.lower(text(c)), F.lit(pattern), F.lit(0))
    return F.array_distinct(F.filter(found, lambda x: F.length(x) >= least))


def word_overlap(a, b) -> Column:
    """Shared words of three letters or more, as a part of the shorter name's."""
    x, y = _tokens(a, r"\w+", 3), _tokens(b, r"\w+", 3)
    n = F.least(F.size(x), F.size(y))
    return F.when(n > 0, F.size(F.array_intersect(x, y)) / n).otherwise(F.lit(0.0))


def score_tokens(c) -> Column:
    """A description's distinct tokens, as token_score() compares them; digits around a separator are one token."""
    return _tokens(F.regexp_replace(F.lower(text(c)), r"(\d)[,x.\-](\d)", "$1$2"), "[a-z0-9]+")


def token_score(ref, offer) -> Column:
    """The larger of the Jaccard index and of the part of the reference's tokens found."""
    return tokens_score(score_tokens(ref), score_tokens(offer))


def tokens_score(x, y) -> Column:
    """token_score() of two columns of score_tokens()."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = F.size(F.array_intersect(x, y))
    either = F.size(x) + F.size(y) - both
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.greatest(both / either, both / F.size(x))).otherwise(F.lit(0.0))


def positional_ratio(a, b) -> Column:
    """Equal characters at equal places, as a part of the longer text."""
    x, y = F.lower(text(a)), F.lower(text(b))
    n = F.greatest(F.length(x), F.length(y))
    same = F.aggregate(F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: F.when(p == q, 1).otherwise(0)), F.lit(0), lambda s, v: s + v)
    return F.when(n > 0, F.when((F.length(x) > 0) & (F.length(y) > 0), same / n).otherwise(F.lit(0.0))).otherwise(F.lit(1.0))


def ratio(a: str | None, b: str | None) -> float:
    """Sequence-matcher ratio; its arguments' order matters."""
    return SequenceMatcher(None, a or "", b or "").ratio()


_BARE = str.maketrans("", "", "#$@ ")


def code_ratio_of(a: str | None, b: str | None) -> float:
    x, y = ((s or "").upper().translate(_BARE) for s in (a, b))
    return ratio(x, y) if x and y else 0.0


#: Patterns of equal characters and their ratios, and how many of them a worker holds.
_PATTERNS: dict[bytes, float] = {}
HELD = 500_000


def ratios(a: list[str], b: list[str]) -> list[float]:
    """ratio() of each pair of texts. It depends only on which characters are equal, so each such pattern is compared once."""
    wa, wb = max(map(len, a), default=0), max(map(len, b), default=0)
    if not 0 < wa + wb <= 64:
        return [ratio(x, y) for x, y in zip(a, b)]
    x, y = (np.array(t, f"U{max(1, w)}").view(np.uint32).reshape(len(t), max(1, w)) for t, w in ((a, wa), (b, wb)))
    every = np.hstack([x, y])
    first = np.stack([(every == every[:, [p]]).argmax(axis=1) for p in range(every.shape[1])], axis=1)
    raw, width = np.where(every == 0, 255, first).astype(np.uint8).tobytes(), every.shape[1]
    sides, out = bytes([x.shape[1]]), []
    for i, (s, t) in enumerate(zip(a, b)):
        key = sides + raw[i * width : (i + 1) * width]
        r = _PATTERNS.get(key)
        if r is None:
            if len(_PATTERNS) >= HELD:
                _PATTERNS.clear()
            r = _PATTERNS[key] = ratio(s, t)
        out.append(r)
    return out


def can_match(a: list[str], b: list[str], least: float) -> np.ndarray:
    """Whether the ratio of each pair of texts may reach `least`.

    A ratio asks for m characters matched in order, so no matched character of a is farther from its place in b than the
    characters that either leaves out. Those that have an equal one as near are counted, in all pairs at once.
    """
    la, lb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    m = np.ceil(least * (la + lb) / 2 - 1e-9).astype(np.int64)
    out = (la > 0) & (lb > 0) & (m <= np.minimum(la, lb))
    at = np.flatnonzero(out)
    if not len(at):
        return out
    width = int(max(la[at].max(), lb[at].max()))
    x, y = (np.array([t[i] for i in at], f"U{width}").view(np.uint32).reshape(len(at), width) for t in (a, b))
    da, db = (la - m)[at], (lb - m)[at]
    near = np.zeros(x.shape, bool), np.zeros(x.shape, bool)
    for shift in range(-int(db.max()), int(da.max()) + 1):  # x[i] beside y[i - shift]
        i, j = slice(max(0, shift), width + min(0, shift)), slice(max(0, -shift), width + min(0, -shift))
        same = (x[:, i] == y[:, j]) & (x[:, i] != 0) & ((shift <= da) & (-shift <= db))[:, None]
        near[0][:, i] |= same
        near[1][:, j] |= same
    out[at] = np.minimum(near[0].sum(axis=1), near[1].sum(axis=1)) >= m[at]
    return out


def code_ratio_from(least: float):
    """code_ratio() where it reaches `least`, else 0: only codes that can match are compared."""

    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = ([(s or "").upper().translate(_BARE) for s in side] for side in (a, b))
        out = np.zeros(len(x))
        at = np.flatnonzero(can_match(x, y, least))
        found = np.array(ratios([x[i] for i in at], [y[i] for i in at]))
        out[at] = np.where(found >= least, found, 0.0)
        return pd.Series(out)

    return run


def text_ratio_of(a: str | None, b: str | None) -> float:
    return ratio((a or "").lower(), (b or "").lower())


def description_ratio_of(a: str | None, b: str | None) -> float:
    x, y = (a or "").lower().strip(), (b or "").lower().strip()
    return ratio(x, y) if len(x) >= 3 and len(y) >= 3 else 0.0


def main_words(name: str) -> str:
    """The leading words of a name, up to a number, a sign of a product or the end; else its first word."""
    m = re.match(r"([a-z\s\-]+?)(?:\s+[0-9]|\s*[=×]|$)", name)
    return m[1].strip() if m else name.split()[0] if name.split() else name


def name_ratio_of(a: str | None, b: str | None) -> float:
    """The larger of the ratio of the names' main words, and 0.8 of the whole names' ratio."""
    x, y = (a or "").lower().strip(), (b or "").lower().strip()
    return max(ratio(main_words(x), main_words(y)), 0.8 * ratio(x, y)) if x and y else 0.0


def _udf(f):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) for x, y in zip(a, b)])

    return run


#: Arrow functions of two text columns, reference first.
code_ratio, text_ratio, description_ratio, name_ratio = map(_udf, (code_ratio_of, text_ratio_of, description_ratio_of, name_ratio_of))


def register(spark) -> None:
    """The ratios, and the token score, as SQL functions."""
    for name, f in (("code_ratio", code_ratio), ("text_ratio", text_ratio), ("description_ratio", description_ratio), ("name_ratio", name_ratio)):
        spark.udf.register(name, f)
    tokens = "array_distinct(regexp_extract_all(regexp_replace(lower(trim(coalesce({0}, ''))), '([0-9])[,x.-]([0-9])', '$1$2'), '[a-z0-9]+', 0))"
    both, either, first = (f"size(array_{f}({tokens.format('ref')}, {tokens.format('offer')}))" for f in ("intersect", "union", "intersect"))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION token_score(ref STRING, offer STRING) RETURNS DOUBLE RETURN CASE WHEN size({tokens.format('ref')}) > 0 AND size({tokens.format('offer')}) > 0 THEN greatest({both} / {either}, {first} / size({tokens.format('ref')})) ELSE 0D END")
