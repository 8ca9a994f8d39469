from newsloom.functions.maps import canonical_map_json, merge_properties
from newsloom.functions.text import (
    canonical_status, chat_role, clean_or_default, clean_or_null, clean_text, contains_ci,
    label_regex_match, normalize_batch_id, slugify, split_list, strip_fence, tokens,
    trim_or_null, unicode_trim,
)
from newsloom.functions.time import as_timestamp, iso_format, parse_instant, utc_date, version_string

__all__ = [
    "canonical_map_json", "merge_properties", "canonical_status", "chat_role", "clean_or_default",
    "clean_or_null", "clean_text", "contains_ci", "label_regex_match", "normalize_batch_id", "slugify",
    "split_list", "strip_fence", "tokens", "trim_or_null", "unicode_trim", "as_timestamp", "iso_format",
    "parse_instant", "utc_date", "version_string",
]
