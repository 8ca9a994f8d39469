"""Map and JSON helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import _c


def merge_properties(old, new) -> Column:
    """``old += new``: keys of ``new`` overwrite, other keys stay, a NULL value removes the key.

    ``map_concat`` raises on duplicate keys, so the old map is first filtered to the keys that
    ``new`` does not mention. NULL maps count as empty.
    """
    o = F.coalesce(_c(old), F.create_map().cast("map<string,string>"))
    n = F.coalesce(_c(new), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(o, lambda k, v: ~F.array_contains(F.map_keys(n), k))
    merged = F.map_concat(kept, n)
    return F.map_filter(merged, lambda k, v: v.isNotNull())


def canonical_map_json(m) -> Column:
    """Key-sorted JSON text of a string map, for comparisons across engines."""
    entries = F.array_sort(F.map_entries(_c(m)))
    return F.to_json(entries)
