"""Column functions the operators share; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English stop words of the lexical index.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to "
    "was will with"
).split()


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where either is all zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def light_stem(word: Column) -> Column:
    """Plural and -ing, -ed endings off, for words that stay at least three letters long."""
    return F.regexp_replace(word, r"(?<=[a-z]{3})(?:ies|ing|ed|es|s)$", "")


def lexical_tokens(text: Column, stem: bool = True) -> Column:
    """Lower-case words without stop words, stemmed if asked."""
    words = F.filter(
        F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: ~w.isin(STOP_WORDS)
    )
    return F.transform(words, light_stem) if stem else words


def merge_segments(segments: Column, max_length: int = 4096, separator: str = " || ", truncate: bool = False) -> Column:
    """Segments joined by a separator; with ``truncate`` it stops before the segment that would exceed ``max_length``."""
    if not truncate:
        return F.array_join(segments, separator)
    gap = len(separator)
    kept = F.aggregate(
        segments,
        F.struct(F.lit("").alias("text"), F.lit(True).alias("open"), F.lit(True).alias("first")),
        lambda s, x: F.when(
            s["open"] & (F.length(s["text"]) + F.when(s["first"], 0).otherwise(gap) + F.length(x) <= max_length),
            F.struct(
                F.concat(s["text"], F.when(s["first"], "").otherwise(separator), x).alias("text"),
                F.lit(True).alias("open"),
                F.lit(False).alias("first"),
            ),
        ).otherwise(F.struct(s["text"].alias("text"), F.lit(False).alias("open"), s["first"].alias("first"))),
    )
    return kept["text"]
