"""Scalar functions against small pure-Python models of the same rules."""

import datetime as dt
import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.functions import (
    canonical_status, chat_role, clean_text, iso_format, label_regex_match, merge_properties, normalize_batch_id,
    slugify, split_list, strip_fence, unicode_trim,
)
from newsloom.operators.ingest import article_fingerprint

WS = ["\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", " ", "\x85", "\xa0", " ",
      " ", " ", " ", " ", " ", " ", " ", "　"]
alphabet = st.sampled_from(WS + list("ab|_-:é漢"))


def py_clean(s):
    return " ".join(s.split()).strip() if s else ""


def py_batch(s):
    n = re.sub(r"[^A-Za-z0-9_-]+", "_", s)
    n = re.sub(r"_+", "_", n)
    return n.strip("_")


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet=alphabet, max_size=12), min_size=200, max_size=200))
def test_clean_text_matches_python_split(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(len(values), None)], "i int, s string")
    got = {r.i: r.c for r in df.select("i", clean_text("s").alias("c")).collect()}
    for i, v in enumerate(values):
        assert got[i] == py_clean(v), repr(v)
    assert got[len(values)] == ""


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab_-:+ /.T0")), max_size=14), min_size=100, max_size=100))
def test_normalize_batch_id_matches_python(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    got = {r.i: r.c for r in df.select("i", normalize_batch_id("s", fallback="FALLBACK").alias("c")).collect()}
    for i, v in enumerate(values):
        assert got[i] == (py_batch(v) or "FALLBACK")


def test_batch_id_of_scheduled_run(spark):
    df = spark.createDataFrame([("scheduled__2026-04-02T00:00:00+00:00",)], "s string")
    assert df.select(normalize_batch_id("s")).first()[0] == "scheduled_2026-04-02T00_00_00_00_00"


def test_iso_format_and_fingerprint(spark):
    rows = [("2026-04-01T01:00:00Z",), ("2026-04-01T02:00:00.120Z",), ("2026-04-01T02:00:00.000001+02:00",)]
    df = spark.createDataFrame(rows, "t string").select(F.try_to_timestamp("t").alias("ts"))
    out = df.select(iso_format("ts").alias("iso"),
                    article_fingerprint(F.lit("src"), F.lit("T"), F.lit("u"), F.col("ts")).alias("id")).collect()
    expect = []
    for (t,) in rows:
        d = dt.datetime.fromisoformat(t.replace("Z", "+00:00")).astimezone(dt.timezone.utc)
        expect.append((d.isoformat(), hashlib.sha256(f"src|T|u|{d.isoformat()}".encode()).hexdigest()))
    assert [(r.iso, r.id) for r in out] == expect


def test_unicode_trim_and_fence(spark):
    rows = [("　 a b\xa0",), (None,), ("```json\n{\"a\": 1}\n```",), ("  {}  ",), ("```{\"x\":2}```",)]
    df = spark.createDataFrame(rows, "s string")
    got = [tuple(r) for r in df.select(unicode_trim("s"), strip_fence("s")).collect()]
    assert got[0][0] == "a b"
    assert got[1] == (None, None)
    assert got[2][1] == '{"a": 1}'
    assert got[3][1] == "{}"
    assert got[4][1] == '{"x":2}'


def test_small_helpers(spark):
    df = spark.createDataFrame([("ResNet 50 -- v2!", "Running", "ai", "500")], "n string, st string, r string, c string")
    r = df.select(slugify("n"), canonical_status("st"), chat_role("r"), chat_role(F.lit("system")),
                  label_regex_match("c", "5.."), label_regex_match(F.lit("1500"), "5..")).first()
    assert tuple(r) == ("resnet_50_v2", "active", "assistant", "user", True, False)
    assert df.select(split_list(F.lit("a, b,,c "))).first()[0] == ["a", "b", "c"]


def test_merge_properties(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": None, "c": "3"}), (None, {"x": "1"}), ({"k": "v"}, None)],
                               "o map<string,string>, n map<string,string>")
    got = [r[0] for r in df.select(merge_properties("o", "n")).collect()]
    assert got == [{"a": "1", "c": "3"}, {"x": "1"}, {"k": "v"}]
