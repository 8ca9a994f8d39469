"""DuckDB spellings of the scalar functions, used only to write the oracle SQL texts."""

from newsloom.functions.text import WHITESPACE_CLASS

WS = WHITESPACE_CLASS


def clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g'))"


def clean_null(x: str) -> str:
    return f"NULLIF({clean(x)}, '')"


def clean_default(x: str, d: str) -> str:
    return f"coalesce({clean_null(x)}, '{d}')"


def utrim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def trim_null(x: str) -> str:
    return f"NULLIF({utrim(x)}, '')"


def iso(ts: str) -> str:
    return (f"CASE WHEN {ts} IS NULL THEN NULL WHEN epoch_us({ts}) % 1000000 = 0 "
            f"THEN strftime({ts}, '%Y-%m-%dT%H:%M:%S') || '+00:00' "
            f"ELSE strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' END")


def norm_batch(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '[^A-Za-z0-9_-]+', '_', 'g'), "
            f"'_+', '_', 'g'), '_')")


def ts(text: str) -> str:
    return f"TIMESTAMP '{text}'"
