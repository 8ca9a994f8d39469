"""Secret scans: candidates by shape, false positives removed by a random forest. DataFrame functions only.

A candidate is any of a word's runs of at least ``MIN_LENGTH`` characters of ``[A-Za-z0-9+/=_-]`` that holds a digit or a
change from lower to upper case; of a run with ``=`` inside, its parts of such length and kind stand instead, if there are
any. Its features are its length and class shares, character transitions (changes of class, and
the mean log-probability of its letter pairs under the corpus dictionary), dictionary coverage (the share of its
characters inside runs of letters that are dictionary words), path signs (``/``, ``.``, ``@``, ``:`` in the word) and
whether the word itself or a neighbouring word names a credential. The dictionary is every word of the corpus that at least
``MIN_SHARE`` of the distinct texts hold (``LEAST_TEXTS`` of them at least); the letter pairs are counted over it.

The forest is Spark ML's, fitted on at most ``MAX_FINDINGS`` labelled findings (those of smallest hash).

Defined cases: null, empty and blank texts have no candidates; repeated rows yield their findings each; a null doc_id
is kept; with no labelled finding or only one class, every candidate's score is that class's (0 without any); empty
tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.arrow import written
from newsloom.llm.quality_rules import BLANK
from newsloom.operators.late import drop_rows, keep_rows

MIN_LENGTH = 16
MIN_SHARE = 0.0005                              # of the distinct texts, so the dictionary is alike at every size
LEAST_TEXTS = 2
MAX_FINDINGS = 50_000
MIN_SCORE = 0.5
# Words that name a credential.
CREDENTIAL_WORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key",
                    "auth", "credential", "private_key")
FEATURES = ["length", "digit_share", "upper_share", "hex_share", "class_changes", "pair_logp", "dictionary_share",
            "path_signs", "named_here", "named_near", "quoted"]
_CORE = rf"[A-Za-z0-9+/=_-]{{{MIN_LENGTH},}}"
_CHUNK = "(?:[^A-Za-z0-9+/=_-]*+[A-Za-z0-9+/=_-]++){1,200}+[^A-Za-z0-9+/=_-]*+"


def _words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(BLANK))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, word_no, value, offset, word, before, after``: every candidate with its place in its word, the word
    and its neighbouring words. A word with several candidates is divided among them at their ends, and its neighbours go
    to the first and the last one."""
    held = docs.select("doc_id", _words(F.col("text")).alias("_w"))
    # a cheap test per word first: long enough, and a digit or a lower-to-upper change
    near = lambda i, d: F.coalesce(F.get("_w", i + d), F.lit(""))                   # noqa: E731
    likely = lambda w: (F.octet_length(w) >= MIN_LENGTH) & w.rlike(r"[0-9]|[a-z][A-Z]")     # noqa: E731
    cut = F.filter(F.transform("_w", lambda w, i: F.when(likely(w), F.struct(
        i.alias("word_no"), w.alias("word"), F.concat_ws(" ", near(i, -2), near(i, -1)).alias("before"),
        near(i, 1).alias("after")))), lambda s: s.isNotNull())
    found = held.select("doc_id", F.explode(cut).alias("c")).select("doc_id", "c.*")
    # long words in chunks of whole runs, so that no step is quadratic in a word's length
    chunks = F.regexp_extract_all("word", F.lit(_CHUNK), F.lit(0))
    starts = lambda k: F.aggregate(k, F.array(F.lit(0)), lambda a, c: F.concat(         # noqa: E731
        a, F.array(F.get(a, F.size(a) - 1) + F.length(c))))
    placed = _let(chunks, lambda k: _let(starts(k), lambda at: F.flatten(F.transform(k, lambda c, i: F.transform(
        _placed(c), lambda s: s.withField("offset", s["offset"] + F.get(at, i)))))))
    own = _let(placed, lambda p: F.transform(p, lambda s, i: F.struct(
        s["value"].alias("value"), s["offset"].alias("offset"), s["word"].alias("word"),
        F.when(i == 0, F.col("before")).otherwise("").alias("before"),
        F.when(i == F.size(p) - 1, F.col("after")).otherwise("").alias("after"))))
    return found.select("doc_id", "word_no", F.explode(own).alias("_c")).select("doc_id", "word_no", "_c.*")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _placed(text: Column) -> Column:
    """The candidates of a piece of a word in order: value, offset, and the piece's text from the end of the candidate
    before to their own end (the last one's to the end of the piece)."""
    good = lambda v: (F.length(v) >= MIN_LENGTH) & v.rlike(r"[0-9]|[a-z][A-Z]")     # noqa: E731
    # "=" assigns inside a run and pads at its end
    parts = lambda r: F.filter(F.regexp_extract_all(r, F.lit("[^=]+(?:=+$)?"), F.lit(0)), good)     # noqa: E731
    values = F.flatten(F.transform(F.filter(F.regexp_extract_all(text, F.lit(_CORE), F.lit(0)), good), lambda r: _let(
        parts(r), lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(r)))))

    def place(done: Column, v: Column) -> Column:
        end = _let(F.get(done, F.size(done) - 1), lambda o: F.coalesce(o["offset"] + F.length(o["value"]), F.lit(0)))
        # a value's text can't occur between the candidate before and itself: it would be a candidate there
        return _let(end, lambda e: _let(F.call_function("locate", v, text, e + 1) - 1, lambda at: F.concat(
            done, F.array(F.struct(v.alias("value"), at.alias("offset"),
                                   F.substring(text, e + 1, at - e + F.length(v)).alias("word"))))))

    found = F.aggregate(values, F.array().cast("array<struct<value:string,offset:int,word:string>>"), place)
    return _let(found, lambda f: F.transform(f, lambda s, i: F.when(i < F.size(f) - 1, s).otherwise(
        s.withField("word", F.concat(s["word"], F.substring(text, s["offset"] + F.length(s["value"]) + 1, F.length(text)))))))


def dictionary(docs: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """``term, n``: lower-cased words of letters (ASCII) that at least ``min_share`` of the distinct texts hold; ``n`` counts
    texts, each once however many copies it has."""
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("digest", F.xxhash64("text"))
    copies = written(texts.groupBy("digest").count(), "secret-texts")
    total, repeated = copies.count(), copies.where("count > 1")
    term = F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("term")
    # texts that occur once need no digest in the shuffle; only the terms of repeated ones are told apart by it
    single = drop_rows(texts, repeated, ["digest"]).select(term).where(F.length("term") >= 3).groupBy("term").agg(F.count("*").alias("n"))
    shared = (keep_rows(texts, repeated, ["digest"]).select("digest", term).where(F.length("term") >= 3).distinct()
              .groupBy("term").agg(F.count("*").alias("n")))
    return (single.unionAll(shared).groupBy("term").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= max(LEAST_TEXTS, min_share * total)))


def letter_pairs(words: DataFrame) -> DataFrame:
    """``pair, logp``: log-probability of the second letter after the first, over the dictionary; at most 26 * 26 rows."""
    pairs = words.select("n", F.explode(F.sequence(F.lit(1), F.length("term") - 1)).alias("i"), "term").select(
        F.substring("term", F.col("i"), F.lit(2)).alias("pair"), "n")
    counted = pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    firsts = counted.groupBy(F.substring("pair", 1, 1).alias("first")).agg(F.sum("n").alias("total"))
    return counted.join(firsts, F.substring("pair", 1, 1) == F.col("first")).select(
        "pair", F.log((F.col("n") + 1) / (F.col("total") + 26)).alias("logp"))


def features(found: DataFrame, words: DataFrame, pairs: DataFrame) -> DataFrame:
    """The candidates with one column per feature."""
    value, n = F.col("value"), F.length("value")
    share = lambda c: F.regexp_count(value, F.lit(c)) / n                           # noqa: E731
    names = "(?i)(" + "|".join(CREDENTIAL_WORDS) + ")"
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "0"), "[A-Z]", "A"), "[a-z]", "a")
    runs = F.regexp_replace(shape, r"(.)\1+", "$1")
    distinct = found.select("value").distinct()
    lower = F.lower("value")
    # per distinct value: letter runs against the dictionary, letter pairs against the 676-row table
    run_of = distinct.select("value", F.explode(F.split(lower, "[^a-z]+")).alias("term")).where(F.length("term") >= 3)
    covered = (run_of.join(words.select("term"), "term").groupBy("value")
               .agg(F.sum(F.length("term")).alias("covered")))
    pair_of = distinct.select("value", F.explode(F.sequence(F.lit(1), n - 1)).alias("i"), lower.alias("low")).select(
        "value", F.substring("low", F.col("i"), F.lit(2)).alias("pair"))
    likely = (pair_of.join(F.broadcast(pairs), "pair", "left").groupBy("value")
              .agg(F.avg(F.coalesce("logp", F.lit(-8.0))).alias("pair_logp")))
    return (found.join(covered, "value", "left").join(likely, "value", "left").select(
        "doc_id", "word_no", "value", "offset", "word", "before", "after", n.cast("double").alias("length"),
        share("[0-9]").alias("digit_share"), share("[A-Z]").alias("upper_share"),
        share("[0-9a-fA-F]").alias("hex_share"), (F.length(runs) / n).alias("class_changes"),
        F.coalesce("pair_logp", F.lit(-8.0)).alias("pair_logp"),
        (F.coalesce("covered", F.lit(0)) / n).alias("dictionary_share"),
        F.regexp_count("word", F.lit("[/.@:\\\\]")).cast("double").alias("path_signs"),
        F.col("word").rlike(names).cast("double").alias("named_here"),
        F.concat_ws(" ", "before", "after").rlike(names).cast("double").alias("named_near"),
        F.col("word").rlike("[\"'`]").cast("double").alias("quoted")))


def weak_labels(rows: DataFrame) -> DataFrame:
    """Labels for a corpus without reviewed findings: 1 for known key formats and values assigned to a credential name,
    (passwords of connection strings included), 0 for numbers, mail addresses and urls; other candidates have no label."""
    known = F.col("value").rlike("^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,})$")
    names = "(?i)(" + "|".join(CREDENTIAL_WORDS) + ")"
    assigned = F.col("word").rlike(names + "[\"']?[=:]") | F.col("before").rlike(names + "\\S* [=:]+$")
    password = F.col("word").contains(F.concat(F.lit(":"), "value", F.lit("@")))      # of a connection string
    harmless = F.col("value").rlike("^[0-9-]+$") | F.col("word").rlike("@|://")
    assigned = assigned | password & F.col("word").contains("://")
    return rows.withColumn("label", F.when(known | assigned, 1.0).when(harmless & ~password, 0.0)).where("label is not null")


def train(labelled: DataFrame, max_findings: int = MAX_FINDINGS, trees: int = 30, depth: int = 6):
    """A forest over ``FEATURES`` fitted on labelled findings (column ``label``: 1.0 secret, 0.0 not), or the single
    class that occurs (0.0 without any)."""
    sample = written(labelled.where("label in (0.0, 1.0)").orderBy(
        F.xxhash64("value", "word"), "doc_id", "word_no", "offset").limit(max_findings).select("label", *FEATURES), "secret-sample")
    low, high = sample.agg(F.min("label"), F.max("label")).first()
    if low is None or low == high:
        return low or 0.0
    rows = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(sample)
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=7,
                                  subsamplingRate=0.8).fit(rows)


def score(rows: DataFrame, model, min_score: float = MIN_SCORE) -> DataFrame:
    """``doc_id, word_no, value, score, is_secret, offset`` per candidate with features."""
    if isinstance(model, float):
        scored = rows.withColumn("score", F.lit(model))
    else:
        x = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rows)
        scored = model.transform(x).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select("doc_id", "word_no", "value", "score", (F.col("score") >= min_score).alias("is_secret"),
                         "offset")


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Scores every candidate of the whole texts. ``labelled``: ``doc_id, word_no, label`` of reviewed findings, and
    ``offset`` where a word's candidates have labels of their own (else the label holds for each of them); without it
    ``weak_labels`` is used."""
    found = written(candidates(docs), "secret-candidates")
    words = written(dictionary(docs), "secret-words")
    rows = written(features(found, words, written(letter_pairs(words), "secret-pairs")), "secret-features")
    if labelled is None:
        return score(rows, train(weak_labels(rows)))
    keys = ["doc_id", "word_no", *(["offset"] if "offset" in labelled.columns else [])]
    known = rows.join(labelled.select(*keys, "label").distinct(), keys)
    return score(rows, train(known))
