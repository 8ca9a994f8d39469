"""Full-text lookup over whole documents.

``search`` is a narrow scan: one regex pass per document finds the (literal, bounded) query
terms as whole tokens inside the projection, then a distributed top-k
(``TakeOrderedAndProject``) ranks by matched terms, then id. ``postings`` builds the
inverted index as a table for repeated lookups (explode + write partitioned by term).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import tokens


def term_matcher(terms) -> str:
    """A regex matching any of ``terms`` as a whole token (maximal run of letters/digits)."""
    alts = "|".join("\\Q" + t.lower().replace("\\E", "\\E\\\\E\\Q") + "\\E" for t in dict.fromkeys(terms))
    return f"(?<![\\p{{L}}\\p{{N}}])({alts})(?![\\p{{L}}\\p{{N}}])"


def search(docs: DataFrame, terms, k: int | None = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents ranked by the number of distinct query terms they contain as tokens.

    One regex pass per document extracts only the whole-token occurrences of the query terms
    (equivalent to intersecting the document's token set with the terms, without building the
    token array of the whole text).
    """
    found = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(term_matcher(terms)), 1)
    hits = docs.select(id_col, F.size(F.array_distinct(found)).cast("bigint").alias("matched_terms"))
    hits = hits.filter(F.col("matched_terms") > 0)
    if k is None:
        return hits
    return hits.orderBy(F.col("matched_terms").desc(), F.col(id_col).asc()).limit(k)


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Inverted index rows ``(term, doc_id)``, one per distinct token of a document."""
    return docs.select(id_col, F.explode(tokens(text_col)).alias("term"))


def search_postings(index: DataFrame, terms, k: int | None = 20, id_col: str = "doc_id") -> DataFrame:
    """Lookup against a postings table: filter on the term column (pushed into the scan)."""
    hits = (index.filter(F.col("term").isin(*[t.lower() for t in terms]))
            .groupBy(id_col).agg(F.count(F.lit(1)).alias("matched_terms")))
    if k is None:
        return hits
    return hits.orderBy(F.col("matched_terms").desc(), F.col(id_col).asc()).limit(k)


def write_postings(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                   files: int | None = None) -> str:
    """Persist the inverted index range-partitioned and sorted by (term, id), so a lookup of a
    few terms reads only the row groups whose min/max term range covers them, and a frequent term spans many files."""
    p = postings(docs, id_col, text_col)
    p = p.repartitionByRange(files, "term", id_col) if files else p.repartitionByRange("term", id_col)
    p.sortWithinPartitions("term", id_col).write.parquet(path)
    return path


# ---- ranked search: BM25 over several fields ------------------------------------------------------

# ---- fixed values: the usual saturation and length weights of BM25
K1, B = 1.2, 0.75
# ---------------------------------------------------------------------------------------------------


def field_words(docs: DataFrame, fields: dict[str, Column], id_col: str = "doc_id") -> DataFrame:
    """``(id, field, words, length)``: the tokens of each field in order, and their number."""
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")         # noqa: E731
    each = F.array(*[F.struct(F.lit(name).alias("field"), words(c).alias("words")) for name, c in fields.items()])
    return (docs.select(id_col, F.inline(each)).where("words is not null")
            .select(id_col, "field", "words", F.size("words").cast("bigint").alias("length")))


def scored_postings(docs: DataFrame, fields: dict[str, Column], id_col: str = "doc_id") -> DataFrame:
    """``(term, field, id, tf, length)``: how often a token occurs in a field of a document, and how many tokens the field has.

    Occurrences of one document are counted in the task that reads it (partial aggregation), so the shuffle carries one
    row per distinct token.
    """
    rows = field_words(docs, fields, id_col).select(id_col, "field", "length", F.explode("words").alias("term"))
    return rows.groupBy("term", "field", id_col, "length").agg(F.count(F.lit(1)).alias("tf"))


def write_scored_index(docs: DataFrame, fields: dict[str, Column], path: str, id_col: str = "doc_id") -> str:
    """The scored postings, range-partitioned and sorted by (term, id) as in :func:`write_postings`, and the field totals."""
    p = scored_postings(docs, fields, id_col)
    p.repartitionByRange("term", id_col).sortWithinPartitions("term", id_col).write.parquet(f"{path}/postings")
    # from the documents: every part of the postings holds nearly every document, so a distinct over them grows with both
    lengths = field_words(docs, fields, id_col).where("length > 0").select("field", id_col, "length").distinct()
    lengths.groupBy("field").agg(F.count(F.lit(1)).alias("documents"), F.avg("length").alias("mean_length")).write.parquet(f"{path}/fields")
    return path


def ranked(postings_: DataFrame, totals: DataFrame, terms, k: int = 20, weights: dict[str, float] | None = None,
           id_col: str = "doc_id") -> DataFrame:
    """The ``k`` documents of the highest BM25 score over all fields (ties: smaller id), ``(id, score)``.

    A field's score is its weight times the sum over the query's terms of
    ``ln(1 + (N - n + 0.5) / (n + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean length))``, with N the documents
    that have the field and n those in which the term occurs there. Only the terms' postings are read; the totals have a row per field.
    """
    hits = postings_.where(F.col("term").isin(*[t.lower() for t in dict.fromkeys(terms)]))
    rarity = (hits.groupBy("term", "field").agg(F.count(F.lit(1)).alias("n")).join(totals, "field")
              .select("term", "field", "mean_length", F.log(1 + (F.col("documents") - F.col("n") + 0.5) / (F.col("n") + 0.5)).alias("idf")))
    weight = F.lit(1.0)
    for field, w in (weights or {}).items():
        weight = F.when(F.col("field") == field, F.lit(float(w))).otherwise(weight)
    tf = F.col("tf").cast("double")
    gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    scored = hits.join(rarity, ["term", "field"]).groupBy(id_col).agg(F.sum(weight * F.col("idf") * gain).alias("score"))
    return scored.orderBy(F.col("score").desc(), id_col).limit(k)
