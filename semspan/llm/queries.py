"""Queries over the training-data operators, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semspan.llm import distinctive, fusion, mixing, neighbors, quality, splitting, tokenizer, truncation
from semspan.runtime import read_table

QueryFn = Callable[[SparkSession, str], DataFrame]


def limited_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(item_id, field, kind, text) of every text that ``size_limits`` speaks of; deliveries count once each."""
    documents = read_table(spark, sf, "vectorize_outputs").select(
        "item_id",
        F.lit("documents").alias("field"),
        F.upper(F.regexp_extract(F.trim("doc_ids"), "_([A-Za-z]+)$", 1)).alias("kind"),
        F.col("documents").alias("text"),
    )
    outputs = read_table(spark, sf, "reduce_outputs").select(
        F.col("reduce_id").alias("item_id"),
        F.lit("output").alias("field"),
        F.col("dtype").alias("kind"),
        F.col("output").alias("text"),
    )
    return documents.unionByName(outputs)


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    pieces = splitting.split_oversized(limited_texts(spark, sf), read_table(spark, sf, "size_limits"))
    return pieces.filter("n_pieces > 1").distinct()


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    pieces = splitting.split_oversized(limited_texts(spark, sf), read_table(spark, sf, "size_limits"))
    return pieces.filter("n_pieces > 1").select("field", F.col("item_id").cast("long").alias("item_id")).distinct()


def _truncated(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncated_values(
        read_table(spark, sf, "summarize_outputs"), read_table(spark, sf, "lake_tables")
    )


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _truncated(spark, sf).filter("cut").select("summary_id", "field").distinct()


def p2_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncation_rates(_truncated(spark, sf))


def p2_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Which evidence decides: the method's own (trie and lengths) and its extension."""
    return truncation.truncation_evidence(_truncated(spark, sf))


def p3_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.nearest(read_table(spark, sf, "vectorize_outputs"), k=3)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.neighbor_pairs(p3_neighbors(spark, sf))


def p4_ranking(spark: SparkSession, sf: str) -> DataFrame:
    fused = fusion.fuse_scores(read_table(spark, sf, "discover_outputs"), read_table(spark, sf, "scorers"))
    return fused.withColumn("fused", F.round("fused", 6))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    fused = fusion.fuse_scores(read_table(spark, sf, "discover_outputs"), read_table(spark, sf, "scorers"))
    return fusion.top_ranked(fused, 3).select("query_id", "table_ids")


def p5_scores(spark: SparkSession, sf: str) -> DataFrame:
    scores = distinctive.term_residuals(read_table(spark, sf, "vectorize_outputs"))
    return scores.withColumn("residual", F.round("residual", 5))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return distinctive.most_distinctive(read_table(spark, sf, "vectorize_outputs")).select("item_id", "term")


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenizer.encode(read_table(spark, sf, "documents"))


def p6_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Encoding and decoding of every text; equals the text, null as ''."""
    return tokenizer.decode(p6_ids(spark, sf))


def _mix_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    targets = read_table(spark, sf, "mix_targets")
    return mixing.sized_records(read_table(spark, sf, "documents"), targets), targets


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(*_mix_inputs(spark, sf))


def p7_mix_full(spark: SparkSession, sf: str) -> DataFrame:
    """The mix of full size, in which sources out of reach are short."""
    return mixing.mix(*_mix_inputs(spark, sf), keep_shares=False)


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    sized, targets = _mix_inputs(spark, sf)
    return mixing.mix_report(sized, targets, mixing.mix(sized, targets))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.short_sources(*_mix_inputs(spark, sf))


def p8_stats(spark: SparkSession, sf: str) -> DataFrame:
    found = quality.classify(read_table(spark, sf, "documents"), read_table(spark, sf, "doc_labels"))
    return found.drop("certainty")


def p8_measures(spark: SparkSession, sf: str) -> DataFrame:
    """The five statistics alone, which SQL can check."""
    found = quality.text_statistics(read_table(spark, sf, "documents"))
    return found.select(F.col("id").alias("doc_id"), *quality.REPORTED)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_stats(spark, sf).filter("kind <> 'prose'").select("doc_id", "kind").distinct()


QUERIES: dict[str, QueryFn] = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p2_found": p2_found,
    "p2_rates": p2_rates,
    "p2_evidence": p2_evidence,
    "p3_found": p3_found,
    "p3_neighbors": p3_neighbors,
    "p4_found": p4_found,
    "p4_ranking": p4_ranking,
    "p5_found": p5_found,
    "p5_scores": p5_scores,
    "p6_ids": p6_ids,
    "p6_decoded": p6_decoded,
    "p7_found": p7_found,
    "p7_mix": p7_mix,
    "p7_mix_full": p7_mix_full,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_measures": p8_measures,
    "p8_stats": p8_stats,
}

_FUSED = """
WITH cur AS (
  SELECT query_id, table_ids, scorer, scores FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, table_ids, scorer ORDER BY loaded_at DESC, scores DESC NULLS LAST) AS rn
    FROM discover_outputs WHERE query_id IS NOT NULL AND table_ids IS NOT NULL AND scorer IS NOT NULL)
  WHERE rn = 1 AND scores IS NOT NULL AND NOT isnan(scores)),
x AS (
  SELECT query_id, table_ids, c.scorer, scores * CASE WHEN better = 'low' THEN -1.0 ELSE 1.0 END AS x
  FROM cur c JOIN scorers s ON c.scorer = s.scorer),
d AS (SELECT *, x - median(x) OVER (PARTITION BY query_id, scorer) AS d FROM x),
m AS (SELECT *, median(abs(d)) OVER (PARTITION BY query_id, scorer) AS mad FROM d),
z AS (SELECT *, CASE WHEN mad > 0 THEN d / (mad * 1.4826) ELSE sign(d) END AS z FROM m),
f AS (
  SELECT query_id, table_ids, exp(avg(-(greatest(-z, 0) + ln(1 + exp(-abs(z)))))) AS fused, count(*) AS n_scores
  FROM z GROUP BY 1, 2)
"""

_RESIDUALS = """
WITH one AS (
  SELECT item_id, any_value(lexical_vectors) AS lexical_vectors, any_value(documents) AS documents
  FROM vectorize_outputs WHERE item_id IS NOT NULL GROUP BY item_id),
w AS (
  SELECT item_id, coalesce(length(documents), 0) > 0 AS has_text, unnest(coalesce(lexical_vectors,
    list_filter(regexp_extract_all(lower(documents), '\\p{{L}}{{2,}}'), lambda t: NOT list_contains([{words}], t)))) AS term
  FROM one),
n AS (SELECT item_id, has_text, lower(term) AS term, count(*) AS n FROM w WHERE length(trim(term)) > 0 GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY item_id) AS r, sum(n) OVER (PARTITION BY term) AS c,
             count(*) OVER (PARTITION BY term) AS records, sum(n) OVER () AS total FROM n),
s AS (
  SELECT item_id, has_text, term, n,
         (n - r * c / total) / sqrt(r * c / total * (1 - r / total) * (1 - c / total)) AS residual
  FROM t WHERE records >= 2)
""".format(words=", ".join(f"'{w}'" for w in distinctive.FUNCTION_WORDS))

_MEASURES = r"""
WITH c AS (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\x{200B}-\x{200F}\x{2060}\x{FEFF}\x{AD}]', '', 'g'),
      '[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]', ' ', 'g'), '\r\n?|[\x{85}\x{2028}\x{2029}\x0B\f]', chr(10), 'g') AS t
  FROM documents),
p AS (
  SELECT doc_id, t,
    length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{N}]', '', 'g')) AS numbers,
    length(regexp_replace(t, '\s', '', 'g')) AS visible, length(regexp_replace(t, '[^\p{Hiragana}]', '', 'g')) AS kana,
    length(regexp_replace(t, '[^\p{Hiragana}\p{Katakana}\p{Han}]', '', 'g')) AS cjk,
    length(regexp_replace(t, '[^.,!?''’。、\p{M}]', '', 'g')) AS light,
    regexp_extract_all(lower(t), '[\p{L}\p{M}\p{N}]+(?:[''’-][\p{L}\p{M}\p{N}]+)*') AS w,
    list_filter(string_split_regex(t, '\n| \|\| '), lambda x: regexp_matches(x, '\S')) AS l
  FROM c)
SELECT doc_id, CAST(round_even(len(w) + cjk / 2, 0) AS bigint) AS word_count,
  CASE WHEN len(w) + cjk / 2 > 0 THEN round((letters + numbers) / (len(w) + cjk / 2), 6) ELSE 0 END AS mean_word_length,
  CASE WHEN visible > 0 THEN round((visible - letters - numbers - light) / visible, 6) ELSE 0 END AS symbol_ratio,
  CASE WHEN len(l) > 0 THEN round(len(list_filter(l, lambda x: regexp_matches(x, '[.!?…:;。！？]["”’»'')\]]*\s*$'))) / len(l), 6) ELSE 0 END AS punctuated_lines,
  CASE WHEN cjk > letters * 0.3 THEN round(kana / cjk, 6)
       WHEN len(w) > 0 THEN round(len(list_filter(w, lambda x: list_contains([WORDS], x))) / len(w), 6) ELSE 0 END AS common_words
FROM p
""".replace("WORDS", ", ".join(f"'{w}'" for w in quality.COMMON_WORDS))

ORACLES: dict[str, str] = {
    "p1_found": """
        SELECT DISTINCT 'documents' AS field, item_id FROM vectorize_outputs v JOIN size_limits l
          ON l.field = 'documents' AND l.kind = upper(regexp_extract(trim(doc_ids), '_([A-Za-z]+)$', 1))
        WHERE CASE WHEN unit = 'bytes' THEN strlen(documents) ELSE length(documents) END > max_size
        UNION
        SELECT DISTINCT 'output', reduce_id FROM reduce_outputs r JOIN size_limits l
          ON l.field = 'output' AND upper(l.kind) = upper(trim(dtype))
        WHERE CASE WHEN unit = 'bytes' THEN strlen(output) ELSE length(output) END > max_size""",
    "p4_found": _FUSED
    + """SELECT query_id, table_ids FROM f
         QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 12) DESC, table_ids) <= 3""",
    "p4_ranking": _FUSED + "SELECT query_id, table_ids, round(fused, 6) AS fused, n_scores FROM f",
    "p5_found": _RESIDUALS
    + """SELECT item_id, term FROM s WHERE has_text
         QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(residual, 9) DESC, term) = 1""",
    "p5_scores": _RESIDUALS + "SELECT item_id, term, n, round(residual, 5) AS residual FROM s",
    "p8_measures": _MEASURES,
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
