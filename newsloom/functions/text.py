"""Scalar text functions as Spark Column expressions (JVM side, no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------
# The code points Python's ``str.split()`` treats as whitespace: \t \n \v \f \r,
# U+001C..U+001F, space, U+0085, and every Unicode separator (Zs, Zl, Zp).
WHITESPACE_CLASS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
WHITESPACE = ("\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
              "\u2028\u2029\u202f\u205f\u3000")
# Characters kept by the batch-id normaliser.
BATCH_ID_KEEP = r"[^A-Za-z0-9_-]+"
# Markdown code fence and the language tag that may follow it.
FENCE = "```"
FENCE_LANG = "json"
# Role names that count as the assistant side of a conversation.
ASSISTANT_ROLES = ("ai", "assistant")
# Status synonyms mapped onto the three canonical run/experiment states (our table).
STATUS_SYNONYMS = {
    "active": "active", "running": "active", "in_progress": "active", "in progress": "active",
    "started": "active", "completed": "completed", "complete": "completed", "done": "completed",
    "finished": "completed", "succeeded": "completed", "success": "completed",
    "failed": "failed", "failure": "failed", "error": "failed", "errored": "failed", "crashed": "failed",
}
# --------------------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_text(x) -> Column:
    """NULL -> ''; every run of Unicode whitespace -> one space; strip both ends."""
    return F.trim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), WHITESPACE_CLASS + "+", " "))


def clean_or_null(x) -> Column:
    """``clean(x) or None``."""
    return F.nullif(clean_text(x), F.lit(""))


def clean_or_default(x, default: str) -> Column:
    """``clean(x) or default``."""
    return F.coalesce(clean_or_null(x), F.lit(default))


def unicode_trim(x) -> Column:
    """Warehouse ``TRIM(x)``: strip Unicode whitespace at both ends (only the ends are read), NULL stays NULL."""
    return F.btrim(_c(x), F.lit(WHITESPACE))


def trim_or_null(x) -> Column:
    """``NULLIF(TRIM(x), '')``."""
    return F.nullif(unicode_trim(x), F.lit(""))


def normalize_batch_id(x, fallback=None) -> Column:
    """Runs outside ``[A-Za-z0-9_-]`` -> '_', collapse '_', strip '_'; empty -> fallback."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(_c(x), F.lit("")), BATCH_ID_KEEP, "_"), "_+", "_")
    s = F.btrim(s, F.lit("_"))
    if fallback is None:
        fallback = F.date_format(F.current_timestamp(), "yyyyMMdd'T'HHmmss'Z'")
    return F.coalesce(F.nullif(s, F.lit("")), _c(fallback) if not isinstance(fallback, str) else F.lit(fallback))


def strip_fence(x) -> Column:
    """Strip; a fenced reply loses the backticks on both ends and a leading language tag."""
    t = unicode_trim(_c(x))
    unfenced = F.btrim(t, F.lit("`"))
    no_tag = F.when(unfenced.startswith(FENCE_LANG),
                    unicode_trim(F.substring(unfenced, len(FENCE_LANG) + 1, 1 << 30))).otherwise(unfenced)
    return F.when(t.startswith(FENCE), no_tag).otherwise(t)


def contains_ci(x, term: str) -> Column:
    return F.contains(F.lower(_c(x)), F.lit(term.lower()))


def split_list(x, sep: str = ",") -> Column:
    """``"a, b,,c"`` -> ``["a","b","c"]``."""
    parts = F.transform(F.split(_c(x), sep), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != F.lit(""))


def chat_role(x) -> Column:
    role = F.lower(_c(x))
    return F.when(role.isin(*ASSISTANT_ROLES) | role.startswith("ai"), F.lit("assistant")).otherwise(F.lit("user"))


def slugify(x) -> Column:
    return F.btrim(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", "_"), F.lit("_"))


def canonical_status(x) -> Column:
    keys = F.lower(F.trim(_c(x)))
    lookup = F.create_map(*[F.lit(v) for kv in STATUS_SYNONYMS.items() for v in kv])
    return F.coalesce(F.element_at(lookup, keys), _c(x))


def label_regex_match(x, pattern: str) -> Column:
    """Label matcher semantics: the regular expression is anchored at both ends."""
    return _c(x).cast("string").rlike(f"^(?:{pattern})$")


def tokens(x) -> Column:
    """Distinct lower-case word tokens (Unicode letters and digits)."""
    parts = F.split(F.lower(_c(x)), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(parts, lambda p: p != F.lit("")))
