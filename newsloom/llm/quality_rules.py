"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Words are runs of characters other than space and \\x09-\\x0D; lines are split at \\n. Every metric is a built-in
expression over the whole text, and the table's verdict is a conjunction of comparisons over those metrics.

Defined cases: a null, empty or blank text has no words, so every count is 0 and it fails; other columns, repeated rows
and null ids pass through untouched; an empty table gives no rows. Window equality is equality of 64-bit hashes of the
eight words, compared within one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
# Common function words of English, French, German and Spanish.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "of", "on", "or",
    "that", "the", "this", "to", "was", "with",
    "au", "aux", "avec", "ce", "dans", "de", "des", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "par",
    "pas", "pour", "qui", "que", "sur", "un", "une",
    "auf", "das", "dem", "den", "der", "die", "ein", "eine", "für", "im", "ist", "mit", "nicht", "sich", "und", "von",
    "zu",
    "al", "como", "con", "del", "el", "las", "lo", "los", "no", "para", "por", "se", "su", "una", "y",
)


@dataclass(frozen=True)
class Rule:
    """Keep a document only if ``low * per <= metric`` and ``metric <= high * per`` (a missing bound never fails)."""
    metric: str
    per: str | None = None
    low: float | None = None
    high: float | None = None


# The threshold table. Ratios are compared as products, so a zero denominator is no special case.
RULES = (
    Rule("n_words", low=20, high=5_000_000),
    Rule("n_repeat_words", per="n_words", high=0.30),
    Rule("word_chars", per="n_words", low=2.0, high=14.0),
    Rule("n_symbols", per="n_words", high=0.25),
    Rule("n_stop_words", per="n_words", low=0.02),
    Rule("n_dup_lines", per="n_lines", high=0.40),
    Rule("n_bullet_lines", per="n_lines", high=0.90),
    Rule("n_ellipsis_lines", per="n_lines", high=0.40),
)


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean expression over the metric columns."""
    verdict = F.lit(True)
    for r in rules:
        per = F.col(r.per) if r.per else F.lit(1)
        if r.low is not None:
            verdict = verdict & (F.col(r.metric) >= F.lit(r.low) * per)
        if r.high is not None:
            verdict = verdict & (F.col(r.metric) <= F.lit(r.high) * per)
    return verdict


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once wherever the optimiser moves the expression."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _repeat_words() -> str:
    """Words inside 8-word windows that occur twice or more.

    A text without a repeated 4-word window has none. Otherwise the 8-word hashes (pairs of 4-word ones) are sorted with
    their positions, the positions whose neighbour has the same hash are kept, and the words that these windows cover are
    added up.
    """
    covered = "aggregate(transform(q, (x, k) -> least(8, coalesce(get(q, k + 1) - x, 8))), 0L, (a, x) -> a + x)"
    twice = ("sort_array(filter(transform(s, (e, k) -> IF(e.h = get(s, k - 1).h OR e.h = get(s, k + 1).h, e.i, NULL)), "
             "p -> p IS NOT NULL))")
    by_hash = "sort_array(transform(w, (x, i) -> struct(x AS h, i AS i)))"
    eights = "transform(slice(f, 1, greatest(size(f) - 4, 0)), (x, i) -> xxhash64(x, get(f, i + 4)))"
    fours = ("transform(slice(h, 1, greatest(size(h) - 3, 0)), (x, i) -> "
             "xxhash64(x, get(h, i + 1), get(h, i + 2), get(h, i + 3)))")
    some = lambda v, then: f"CASE WHEN size({v}) = size(array_distinct({v})) THEN 0L ELSE {then} END"
    inner = _let(eights, "w", some("w", _let(by_hash, "s", _let(twice, "q", covered))))
    return _let("transform(_words, x -> xxhash64(x))", "h", _let(fours, "f", some("f", inner)))


def metrics(docs: DataFrame, text: Column, carry: list[Column]) -> DataFrame:
    """``carry`` columns plus every metric of the table, all counts as longs."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    trimmed = F.btrim(whole, F.lit(BLANK))
    base = docs.select(*carry,
                       F.when(trimmed == "", F.array().cast("array<string>"))
                       .otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")).alias("_words"),
                       # no blanks, and every symbol as "#": its length and the number of "#" are two of the counts
                       F.translate(whole, SYMBOLS + BLANK, "#" * len(SYMBOLS)).alias("_packed"),
                       F.filter(F.split(whole, "\n", -1), lambda x: F.btrim(x, F.lit(BLANK)) != "").alias("_lines"))
    names = [c for c in base.columns if c not in ("_packed", "_words", "_lines")]
    count = lambda c: F.size(c).cast("long")                                        # noqa: E731
    return base.select(
        *names,
        count("_words").alias("n_words"),
        F.length("_packed").cast("long").alias("word_chars"),
        (F.length("_packed") - F.length(F.replace("_packed", F.lit("#"), F.lit("")))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_repeat_words()).cast("long").alias("n_repeat_words"),
        count(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))).alias("n_stop_words"),
        count("_lines").alias("n_lines"),
        count(F.filter("_lines", lambda x: F.ltrim(x).rlike("^[-*•]"))).alias("n_bullet_lines"),
        count(F.filter("_lines", lambda x: F.rtrim(x).rlike("(\\.\\.\\.|…)$"))).alias("n_ellipsis_lines"))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id``, the metrics, ``base_failed`` and ``kept`` per row of ``docs``."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (metrics(docs, F.col("text"), [F.col("doc_id")]).withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & compile_rules(rules)))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    whole_row = F.struct("*").alias("_row")
    # the partition id keeps the filter above the projection; pushed below, it would compute every metric per rule
    judged = metrics(docs, F.col("text"), [whole_row]).withColumn("_above", F.spark_partition_id())
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.where((F.col("_above") >= 0) & ~failed & compile_rules(rules)).select("_row.*")
