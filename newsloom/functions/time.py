"""Timestamp parsing and formatting as Column expressions. Session zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import _c

# ---- fixed values: output formats -----------------------------------------------------
ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ssxxx"
ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"
VERSION_FORMAT = "'v'yyyyMMddHHmmss"
RUN_STAMP_FORMAT = "yyyyMMdd'T'HHmmss'Z'"
# ---------------------------------------------------------------------------------------


def parse_instant(x) -> Column:
    """ISO-8601 text -> TIMESTAMP (UTC); '' and NULL -> NULL; malformed -> NULL (quarantine).

    The text must start with a whole date: a time alone or a bare year, which a cast would complete, is malformed.
    """
    s = F.nullif(F.trim(_c(x)), F.lit(""))
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(s))


def iso_format(ts) -> Column:
    """Python ``datetime.isoformat()`` of a UTC instant: fraction only when non-zero."""
    t = _c(ts)
    return (F.when(t.isNull(), F.lit(None).cast("string"))
            .when(F.unix_micros(t) % 1000000 == 0, F.date_format(t, ISO_SECONDS))
            .otherwise(F.date_format(t, ISO_MICROS)))


def utc_date(ts) -> Column:
    return F.to_date(_c(ts))


def version_string(ts) -> Column:
    return F.date_format(_c(ts), VERSION_FORMAT)


def as_timestamp(value) -> Column:
    """A parameter (python datetime/str/Column) as a TIMESTAMP column; None -> now."""
    if value is None:
        return F.current_timestamp()
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp")
