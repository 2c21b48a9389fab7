"""How distinctive a term is for a record, against the whole collection.

Method: adjusted residuals of correspondence analysis. With n the count of a term in a
record, r and c the totals of record and term and N the grand total, the expected count
is e = r c / N and the score is (n - e) / sqrt(e (1 - r/N) (1 - c/N)).

All counts are exact and cover the whole collection. Records are exchanged once, by
their key; (record, term) counts and record totals need no further exchange and are written once, as a table. Term
totals are pre-aggregated on the map side. The most frequent terms (``HOT_TERMS``, a fixed
bound on what is broadcast) meet their rows without a shuffle, so no frequent term
gathers its rows in one task; all other terms are joined by hash.

Results for odd inputs: of several deliveries of a record the earliest arrival counts;
a null word list falls back to the words of the text; null and empty words are no terms;
an empty word list gives no row; case is folded; a term of fewer than ``min_records``
records counts in the totals but gives no row; equal scores rank by the term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semspan.runtime import written_table

#: The function words that the word lists leave out.
FUNCTION_WORDS = (
    "the in as of for and no was at is that it to or with which not if by from on when you be an them this were are "
    "but who your some will have then we its my they her has had he so she his him their our us"
).split()

#: Terms whose totals are broadcast; the only thing that is, and it does not grow with the data.
HOT_TERMS = 20_000


def words_of(text: Column) -> Column:
    """Runs of two or more letters in lower case, function words left out."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{2,}"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(FUNCTION_WORDS))


def term_counts(records: DataFrame, id_col: str, words_col: str, text_col: str, arrival_col: str) -> DataFrame:
    """(id, term, n, r, has_text): exact counts, and the total of each record; written once, since they are read four times."""
    words = F.coalesce(F.col(f"`{words_col}`"), words_of(F.col(f"`{text_col}`")))
    rows = records.select(
        F.col(f"`{id_col}`").alias("id"),
        F.filter(words, lambda w: F.length(F.trim(w)) > 0).alias("words"),
        (F.coalesce(F.length(F.col(f"`{text_col}`")), F.lit(0)) > 0).alias("has_text"),
        F.col(f"`{arrival_col}`").alias("t"),
    ).filter("id is not null and words is not null")
    one = rows.groupBy("id").agg(F.min_by(F.struct("words", "has_text"), F.struct("t", F.xxhash64("words"))).alias("r"))
    counted = (
        one.select("id", "r.has_text", F.size("r.words").alias("r"), F.explode("r.words").alias("term"))
        .groupBy("id", "has_text", "r", F.lower("term").alias("term"))
        .agg(F.count("*").alias("n"))
    )
    return written_table(counted)


def _scored(counts: DataFrame, min_records: int, hot_terms: int, finish) -> DataFrame:
    """Joins counts with term totals (hot terms by broadcast, the rest by hash) and applies ``finish`` to either part."""
    totals = counts.groupBy("term").agg(F.sum("n").alias("c"), F.count("*").alias("records"))
    grand = totals.agg(F.sum("c").cast("double")).scalar()
    hot = F.broadcast(totals.orderBy(F.desc("c"), "term").limit(hot_terms))

    def residual(df: DataFrame) -> DataFrame:
        r, c = F.col("r") / F.col("total"), F.col("c") / F.col("total")
        e = F.col("r") * c
        variance = e * (1 - r) * (1 - c)
        score = F.when(variance > 0, (F.col("n") - e) / F.sqrt(variance)).otherwise(0.0)
        return df.filter(F.col("records") >= min_records).withColumn("total", grand).withColumn("residual", score)

    near = finish(residual(counts.join(hot, "term")))
    far = finish(residual(counts.join(hot.select("term"), "term", "left_anti").join(totals, "term")))
    return near.unionByName(far)


def term_residuals(
    records: DataFrame,
    id_col: str = "item_id",
    words_col: str = "lexical_vectors",
    text_col: str = "documents",
    arrival_col: str = "loaded_at",
    min_records: int = 2,
    hot_terms: int = HOT_TERMS,
) -> DataFrame:
    """One row per record and term: ``id_col``, ``term``, ``n``, ``residual``."""
    counts = term_counts(records, id_col, words_col, text_col, arrival_col)
    scored = _scored(counts, min_records, hot_terms, lambda df: df.select("id", "term", "n", "residual"))
    return scored.withColumnRenamed("id", id_col)


def most_distinctive(
    records: DataFrame,
    id_col: str = "item_id",
    words_col: str = "lexical_vectors",
    text_col: str = "documents",
    arrival_col: str = "loaded_at",
    min_records: int = 2,
    hot_terms: int = HOT_TERMS,
) -> DataFrame:
    """The term of largest residual of every record that has a text: ``id_col``, ``term``, ``residual``."""

    def best(df: DataFrame) -> DataFrame:
        return df.groupBy("id").agg(F.min(F.struct((-F.round("residual", 9)).alias("rank"), "term")).alias("b"))

    counts = term_counts(records, id_col, words_col, text_col, arrival_col)
    ranked = _scored(counts, min_records, hot_terms, lambda df: best(df.filter("has_text")))
    top = ranked.groupBy("id").agg(F.min("b").alias("b"))
    return top.select(F.col("id").alias(id_col), F.col("b.term").alias("term"), (-F.col("b.rank")).alias("residual"))
