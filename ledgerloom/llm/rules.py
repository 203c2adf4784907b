"""Quality rules as a bitmask ledger, in DataFrame expressions only.

Every rule is measured once per document; the measurements and one failure bit a rule are stored. Policies are masks
over those bits with a version, applied and compared later without reading a text again, and ablations are sums over
the stored bits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, staged, table, without

#: White space, for translate().
BLANK = " \t\n\x0b\f\r"
#: Characters counted as symbols (fixed value).
SYMBOLS = "#*$%&|<>"
#: Words of a window.
SPAN = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "max_word")
ADDED = (*MEASURES, "fail_bits", "base_failed")


@dataclass(frozen=True)
class Rule:
    """A rule fails where `fails`, SQL over the measurements, is true. Its place in RULES is its bit."""

    name: str
    fails: str


RULES = (
    Rule("too_few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > word_chars"),
    Rule("duplicate_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    Rule("few_letters", "2 * n_letters < word_chars"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("giant_word", "max_word > 1000"),
)
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}
#: Failing any of these rejects, whatever the policy.
BASE = BIT["too_few_words"] | BIT["repeated_windows"]


@dataclass(frozen=True)
class Policy:
    """Rejects a document that fails a rule of `fatal`, or more than `allowed` rules of `counted`."""

    version: str
    fatal: int
    counted: int = 0
    allowed: int = 0

    def keeps(self, bits: str | Column = "fail_bits") -> Column:
        b = F.col(bits) if isinstance(bits, str) else bits
        return (b.bitwiseAND(F.lit(self.fatal)) == 0) & (F.bit_count(b.bitwiseAND(F.lit(self.counted))) <= self.allowed)


POLICIES = {
    "v1": Policy("v1", BASE | BIT["symbols"] | BIT["duplicate_lines"] | BIT["giant_word"], BIT["few_letters"] | BIT["short_words"] | BIT["long_words"], 1),
    "v0": Policy("v0", BASE),
    "strict": Policy("strict", sum(BIT.values())),
}


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the measurements (columns of these names are replaced).

    Null texts measure 0 everywhere. A window is five consecutive words; one that occurs again in its text counts with
    all its words, and only texts that hold such a window pay for finding its places: windows and their places are
    sorted, so the work is n log n in the words of a text. Windows are compared by 64-bit hashes of word hashes.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    out = without(docs, *ADDED)
    given, mark = out.columns, "__"
    while any(c.lower().startswith(mark) for c in given):  # names of its own, whatever columns there are
        mark += "_"
    out = out.withColumn(f"{mark}w", F.array_remove(F.split(F.translate(t, BLANK, " " * len(BLANK)), " "), ""))
    out = out.withColumn(f"{mark}l", F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, BLANK, "")) > 0))
    plain = F.translate(t, BLANK, "")
    out = out.withColumns({
        "n_words": F.size(f"{mark}w").cast("long"),
        "word_chars": F.length(plain).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(f"{mark}l").cast("long"),
        "n_dup_lines": (F.size(f"{mark}l") - F.size(F.array_distinct(f"{mark}l"))).cast("long"),
        "n_letters": F.length(F.regexp_replace(t, r"\P{L}+", "")).cast("long"),
        "max_word": F.coalesce(F.array_max(F.transform(f"{mark}w", F.length)), F.lit(0)).cast("long"),
        f"{mark}h": F.transform(f"{mark}w", lambda x: F.xxhash64(x)),
    })
    args = ", ".join(f"element_at({mark}h, i + {k})" for k in range(SPAN))
    out = out.withColumn(f"{mark}g", F.expr(f"CASE WHEN size({mark}h) >= {SPAN} THEN transform(sequence(1, size({mark}h) - {SPAN - 1}), i -> xxhash64({args})) ELSE array() END"))
    again = f"size(array_distinct({mark}g)) < size({mark}g)"
    out = out.withColumn(f"{mark}s", F.expr(f"CASE WHEN {again} THEN array_sort(transform({mark}g, (x, i) -> struct(x AS h, i AS i))) ELSE array() END"))
    twice = f"(k > 0 AND {mark}s[k - 1].h = x.h) OR (k < size({mark}s) - 1 AND {mark}s[k + 1].h = x.h)"
    out = out.withColumn(f"{mark}p", F.expr(f"CASE WHEN size({mark}s) > 0 THEN sort_array(transform(filter({mark}s, (x, k) -> {twice}), x -> x.i)) ELSE array() END"))
    covered = f"aggregate(transform({mark}p, (p, k) -> CASE WHEN k < size({mark}p) - 1 THEN least({SPAN}, {mark}p[k + 1] - p) ELSE {SPAN} END), 0L, (a, x) -> a + x)"
    return out.withColumn("n_repeat_words", F.expr(covered)).select(*quoted(given), *MEASURES)


def evaluated(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with measurements and fail_bits (bit i: rule i fails). Every rule is evaluated once."""
    bits = " + ".join(f"CASE WHEN {r.fails} THEN {1 << i}L ELSE 0L END" for i, r in enumerate(rules))
    return measured(docs, text_col).withColumn("fail_bits", F.expr(bits))


def ledger(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """evaluated() without the texts, written and read again: whatever is asked of it later reads no text."""
    return staged(evaluated(docs, text_col, rules).drop(text_col), "quality-ledger")


def judged(book: DataFrame, policy: Policy = POLICIES["v1"]) -> DataFrame:
    """A ledger's rows with base_failed and kept under one policy, from the bits alone (a column named kept is replaced)."""
    failed = F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0
    return without(book, "kept").withColumn("base_failed", failed).withColumn("kept", ~failed & policy.keeps())


def ablations(book: DataFrame, policies: dict[str, Policy] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """policy, rule, n_fail, n_only (documents that the policy would keep without that rule) from a stored ledger: one pass, one row a policy and rule."""
    sums = []
    for v, p in (policies or POLICIES).items():
        for i, r in enumerate(rules):
            less = Policy(v, p.fatal & ~(1 << i), p.counted & ~(1 << i), p.allowed)
            sums.append(F.struct(F.lit(v).alias("policy"), F.lit(r.name).alias("rule"), F.count_if(F.col("fail_bits").bitwiseAND(F.lit(1 << i)) != 0).alias("n_fail"), F.count_if(~p.keeps() & less.keeps()).alias("n_only")))
    return book.agg(F.array(*sums).alias("a")).select(F.inline("a"))


def op10(spark, sf_dir: str) -> DataFrame:
    return judged(ledger(table(spark, sf_dir).select("doc_id", "text"))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def rule_ablations(spark, sf_dir: str) -> DataFrame:
    """What each rule does under each policy, from a stored ledger of all documents."""
    return ablations(ledger(table(spark, sf_dir).select("doc_id", "text")))


_OP10_BITS = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g),
n AS (SELECT r, count(DISTINCT j)::BIGINT AS n FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM h WHERE c > 1) GROUP BY r),
m AS (SELECT w.r, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
             length(regexp_replace(t, '\P{L}+', '', 'g'))::BIGINT AS n_letters,
             coalesce(list_max(list_transform(w, lambda x: length(x))), 0)::BIGINT AS max_word
      FROM w LEFT JOIN n ON w.r = n.r),
b AS (SELECT *, CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 10 * n_symbols > word_chars THEN 4 ELSE 0 END + CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
             + CASE WHEN 2 * n_letters < word_chars THEN 16 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END
             + CASE WHEN word_chars > 20 * n_words THEN 64 ELSE 0 END + CASE WHEN max_word > 1000 THEN 128 ELSE 0 END AS f FROM m)
"""

OP10_SQL = (
    _OP10_BITS
    + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (f & 3) <> 0 AS base_failed,
       (f & 3) = 0 AND (f & 140) = 0 AND bit_count((f & 112)::BIGINT) <= 1 AS kept, f::BIGINT AS fail_bits FROM b
"""
)

#: By policy: fatal bits, counted bits and how many of those may fail.
ABLATIONS_SQL = (
    _OP10_BITS
    + f"""
, p AS (SELECT * FROM (VALUES {", ".join(f"('{v}', {p.fatal}, {p.counted}, {p.allowed})" for v, p in POLICIES.items())}) p(policy, fatal, counted, allowed)),
q AS (SELECT * FROM (VALUES {", ".join(f"('{r.name}', {BIT[r.name]})" for r in RULES)}) q(rule, bit)),
k AS (SELECT policy, rule, (f & bit) <> 0 AS fails, (f & fatal) = 0 AND bit_count((f & counted)::BIGINT) <= allowed AS kept,
             (f & fatal & ~bit) = 0 AND bit_count((f & counted & ~bit)::BIGINT) <= allowed AS kept_without FROM b, p, q)
SELECT policy, rule, count(*) FILTER (fails)::BIGINT AS n_fail, count(*) FILTER (NOT kept AND kept_without)::BIGINT AS n_only FROM k GROUP BY policy, rule
"""
)
