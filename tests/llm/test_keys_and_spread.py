"""The pseudonym key, copies in the dictionary, equal rows in packing."""

import inspect

from pyspark.sql import functions as F

from newsloom.llm import packing, pii, secrets
from newsloom.llm.arrow import written


def test_a_key_is_required_and_read_from_the_session(spark):
    for f in (pii.replace_all, pii.pseudonymise, pii.rewrite):
        assert inspect.signature(f).parameters["key"].default is inspect.Parameter.empty
    assert pii.session_key(spark) == pii.session_key(spark) and len(pii.session_key(spark)) == 32
    spark.conf.set(pii.KEY_SETTING, "ab" * 16)
    try:
        assert pii.session_key(spark) == bytes.fromhex("ab" * 16)
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_copies_make_no_dictionary_word(spark):
    texts = ["common words here"] * 3 + ["common other words"] + ["only copies hold zzyzx"] * 500 + [None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.term: r.n for r in secrets.dictionary(docs).collect()}
    assert got == {"common": 2, "words": 2}
    assert secrets.dictionary(docs.limit(0)).collect() == []


def test_equal_rows_spread_over_shards_and_fill_batches(spark):
    docs = spark.createDataFrame([(7, "one two three")], "doc_id long, text string").crossJoin(spark.range(20_000)).drop("id")
    rows = written(packing.lengths(docs), "t-lengths")
    shards = rows.groupBy(F.pmod("spread", F.lit(8))).count().collect()
    assert len(shards) == 8 and max(r["count"] for r in shards) < 2 * 20_000 / 8
    got = packing.pack(docs)
    assert got.count() == got.select("bucket", "batch", "slot").distinct().count() == 20_000
