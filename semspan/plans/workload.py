"""Queries of the engine's own operators over the test tables, and the same in SQL.

The model-class queries go through the offline rule backend; it stands for a language model
so that questions, replies and parsing are exercised, and says nothing about answer quality.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semspan.backends import RuleBackend
from semspan.frame import SemFrame
from semspan.functions.columns import lexical_tokens
from semspan.operators import core, discover
from semspan.plans.physical import OptimizeConfig
from semspan.runtime import read_table
from semspan.sources.readers import as_media, load_media

BACKEND = RuleBackend()
QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

#: The engine's reading of a number in formatted text, for DuckDB.
_NUM = "try_cast(replace(regexp_extract(cast({c} AS varchar), '-?[0-9][0-9,]*(?:[.][0-9]+)?|-?[.][0-9]+'), ',', '') AS double)"


def num(column: str) -> str:
    return _NUM.format(c=column)


def query(name: str, sql: str | None = None):
    def register(f: QueryFn) -> QueryFn:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


# --- map -----------------------------------------------------------------------------------------

CLASSIFY = "Classify the text as game, film, house or other"
_CLASS_SQL = """CASE WHEN text IS NULL THEN NULL WHEN contains(lower(text), 'game') THEN 'game'
    WHEN contains(lower(text), 'film') THEN 'film' WHEN contains(lower(text), 'house') THEN 'house' ELSE 'other' END"""


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select("doc_id", "text", "lang", "source")


def _map(spark: SparkSession, sf: str, **kwargs) -> DataFrame:
    frame = core.sem_map(_documents(spark, sf), CLASSIFY, ["text"], ["topic"], backend=BACKEND, **kwargs)
    return frame.select("doc_id", "topic")


@query("map_plain", f"SELECT doc_id, {_CLASS_SQL} AS topic FROM documents")
def map_plain(spark, sf):
    return _map(spark, sf)


@query("map_self_refine", f"SELECT doc_id, upper({_CLASS_SQL}) AS topic FROM documents")
def map_self_refine(spark, sf):
    """The drafts are not in capital letters; the judge says so, and they are improved."""
    loud = f"In capital letters: {CLASSIFY[0].lower()}{CLASSIFY[1:]}"
    frame = core.sem_map(_documents(spark, sf), loud, ["text"], ["topic"], backend=BACKEND, strategy="self-refine")
    return frame.select("doc_id", "topic")


_WORD = "regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])%s($|[^\\p{L}\\p{N}_])')"


@query(
    "map_fewshot",
    f"""SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN {_WORD % 'film'} THEN 'cinema' WHEN {_WORD % 'house'} THEN 'home' ELSE 'thing' END AS topic
        FROM documents""",
)
def map_fewshot(spark, sf):
    """Only the examples say what the answers are."""
    shown = [{"data": {"text": t}, "answer": a} for t, a in (("film", "cinema"), ("house", "home"), ("other", "thing"))]
    frame = core.sem_map(
        _documents(spark, sf), "Say what it is about", ["text"], ["topic"], backend=BACKEND, strategy="fewshot", context=shown
    )
    return frame.select("doc_id", "topic")


@query("map_native", ORACLES["map_plain"])
def map_native(spark, sf):
    frame = SemFrame.of(_documents(spark, sf)).semantic_map(CLASSIFY, "text", "topic").optimized()
    return frame.to_spark(BACKEND).select("doc_id", "topic")


@query(
    "map_multi_output",
    f"SELECT doc_id, {_CLASS_SQL} AS topic, {_CLASS_SQL} AS theme FROM documents",
)
def map_multi_output(spark, sf):
    frame = core.sem_map(_documents(spark, sf), CLASSIFY, ["text"], ["topic", "theme"], backend=BACKEND)
    return frame.select("doc_id", "topic", "theme")


@query("map_udf", "SELECT p_partkey, upper(p_name) AS shout, cast(length(p_name) AS varchar) AS size FROM part")
def map_udf(spark, sf):
    part = read_table(spark, sf, "part").select("p_partkey", "p_name")
    return core.sem_map(part, None, ["p_name"], ["shout", "size"], func=lambda name: (name.upper(), len(name))).drop("p_name")


@query("map_fallback", "SELECT p_partkey, CASE WHEN p_size > 25 THEN upper(p_name) ELSE lower(p_name) END AS name FROM part")
def map_fallback(spark, sf):
    """The function fails for small parts; the model answers for those."""

    def shout(row):
        if int(row["p_size"]) <= 25:
            raise ValueError("too small")
        return f"{row['p_name'].upper()} {row['p_size']}"

    part = read_table(spark, sf, "part").select("p_partkey", "p_name", F.coalesce("p_size", F.lit(0)).alias("p_size"))
    mapped = core.sem_map(
        part, "Give the name and the size in lower case", ["p_name", "p_size"], ["both"], func=shout, backend=BACKEND
    )
    return mapped.select("p_partkey", F.regexp_extract("both", r"(?s)^(.*) \d+$", 1).alias("name"))


# --- filter --------------------------------------------------------------------------------------

MENTIONS = 'The text mentions "captain".'
_MENTIONS_SQL = "SELECT doc_id FROM documents WHERE contains(lower(text), 'captain')"


def _filter(spark, sf, **kwargs):
    return core.sem_filter(_documents(spark, sf), MENTIONS, ["text"], backend=BACKEND, **kwargs).select("doc_id")


@query("filter_plain", _MENTIONS_SQL)
def filter_plain(spark, sf):
    return _filter(spark, sf)


@query("filter_self_refine", _MENTIONS_SQL)
def filter_self_refine(spark, sf):
    return _filter(spark, sf, strategy="self_refine")


@query("filter_udf", _MENTIONS_SQL)
def filter_udf(spark, sf):
    return _filter(spark, sf, func=lambda text: "captain" in text.lower())


@query("filter_fallback", _MENTIONS_SQL)
def filter_fallback(spark, sf):
    def check(text):
        if len(text) % 2:
            raise ValueError("odd")
        return "captain" in text.lower()

    return _filter(spark, sf, func=check)


@query("filter_native", _MENTIONS_SQL)
def filter_native(spark, sf):
    return SemFrame.of(_documents(spark, sf)).semantic_filter(MENTIONS, "text").optimized().to_spark(BACKEND).select("doc_id")


@query("filter_mask", "SELECT doc_id, coalesce(contains(lower(text), 'captain'), false) AS keep FROM documents")
def filter_mask(spark, sf):
    return core.sem_mask(_documents(spark, sf), MENTIONS, ["text"], backend=BACKEND).select("doc_id", "keep")


@query("filter_two_columns", "SELECT doc_id FROM documents WHERE contains(lower(concat(lang, ' ', text)), 'en') AND lang IS NOT NULL AND text IS NOT NULL")
def filter_two_columns(spark, sf):
    frame = core.sem_filter(_documents(spark, sf), 'The record contains "en".', ["lang", "text"], backend=BACKEND)
    return frame.select("doc_id")


# --- join ----------------------------------------------------------------------------------------

LETTER = "Both names have the same first letter"
_JOIN_SQL = """SELECT source, target_share, scorer, better FROM mix_targets {how} JOIN scorers
    ON lower(substr(source, 1, 1)) = lower(substr(scorer, 1, 1))"""


def _join(spark, sf, how="inner", **kwargs):
    left = read_table(spark, sf, "mix_targets").select("source", "target_share")
    right = read_table(spark, sf, "scorers").select("scorer", "better")
    return core.sem_join(left, right, LETTER, "source", "scorer", "source", "scorer", how, backend=BACKEND, **kwargs)


@query("join_nest_inner", _JOIN_SQL.format(how=""))
def join_nest_inner(spark, sf):
    return _join(spark, sf)


@query("join_nest_left", _JOIN_SQL.format(how="LEFT"))
def join_nest_left(spark, sf):
    return _join(spark, sf, "left")


@query("join_nest_right", _JOIN_SQL.format(how="RIGHT"))
def join_nest_right(spark, sf):
    return _join(spark, sf, "right")


@query("join_block", _JOIN_SQL.format(how=""))
def join_block(spark, sf):
    return _join(spark, sf, strategy="block", batch_size=4)


@query("join_udf", _JOIN_SQL.format(how=""))
def join_udf(spark, sf):
    return _join(spark, sf, func=lambda l, r: l[:1].lower() == r[:1].lower())


@query("join_native", "SELECT o_orderkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_native(spark, sf):
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    customer = read_table(spark, sf, "customer").select("c_custkey", "c_name")
    joined = core.sem_join(orders, customer, None, "o_custkey", "c_custkey", "o_orderkey", "c_custkey", expr="l = r")
    return joined.drop("o_custkey")


@query("join_cache", "SELECT n_nationkey, r_regionkey FROM nation, region WHERE n_nationkey % 5 = r_regionkey")
def join_cache(spark, sf):
    """Every answer comes from the cache: no call is made."""
    nation, region = read_table(spark, sf, "nation"), read_table(spark, sf, "region")
    cache = nation.crossJoin(region).select(
        F.col("n_nationkey").alias("l_id"),
        F.col("r_regionkey").alias("r_id"),
        F.when(F.col("n_nationkey") % 5 == F.col("r_regionkey"), "True").otherwise("False").alias("answer"),
    )
    pairs = core.join_pairs(nation, region, LETTER, "n_name", "r_name", "n_nationkey", "r_regionkey", cache=cache, backend=BACKEND)
    return pairs.withColumnsRenamed({"l_id": "n_nationkey", "r_id": "r_regionkey"})


# --- rank ----------------------------------------------------------------------------------------


@query("rank_model_desc", "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS ranking FROM supplier")
def rank_model_desc(spark, sf):
    supplier = read_table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    return core.sem_rank(supplier, "The highest balance first", "s_acctbal", "s_suppkey", backend=BACKEND).drop("s_acctbal")


@query("rank_model_asc", "SELECT n_nationkey, row_number() OVER (ORDER BY n_name DESC, n_nationkey) AS ranking FROM nation")
def rank_model_asc(spark, sf):
    nation = read_table(spark, sf, "nation").select("n_nationkey", "n_name")
    ranked = core.sem_rank(nation, "In alphabetical order", "n_name", "n_nationkey", descend=False, backend=BACKEND)
    return ranked.drop("n_name")


@query("rank_native", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS ranking FROM customer")
def rank_native(spark, sf):
    customer = read_table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return core.sem_rank(customer, None, "c_acctbal", "c_custkey", expr="c_acctbal").drop("c_acctbal")


@query("rank_udf", "SELECT p_partkey, row_number() OVER (ORDER BY length(p_name) ASC, p_partkey) AS ranking FROM part")
def rank_udf(spark, sf):
    part = read_table(spark, sf, "part").select("p_partkey", "p_name")
    return core.sem_rank(part, None, "p_name", "p_partkey", descend=False, func=len).drop("p_name")


# --- reduce --------------------------------------------------------------------------------------

_REDUCTIONS = {
    "count": ("How many prices are there?", "cast(count(l_extendedprice) AS varchar)"),
    "sum": ("What is the total price?", "round(sum(l_extendedprice), 2)"),
    "max": ("What is the highest price?", "round(max(l_extendedprice), 2)"),
    "min": ("What is the lowest price?", "round(min(l_extendedprice), 2)"),
    "avg": ("What is the average price?", "round(avg(l_extendedprice), 2)"),
}


def _reduction(instruction: str, name: str) -> QueryFn:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        frame = SemFrame.of(read_table(spark, sf, "lineitem").select("l_extendedprice"))
        reduced = frame.semantic_reduce(instruction, "l_extendedprice").optimized().to_spark(BACKEND)
        return reduced if name == "count" else reduced.select(F.round(F.col("reduce_result").cast("double"), 2).alias("reduce_result"))

    return run


for _name, (_instruction, _sql) in _REDUCTIONS.items():
    query(f"reduce_{_name}", f"SELECT {_sql} AS reduce_result FROM lineitem")(_reduction(_instruction, _name))


@query(
    "reduce_mode",
    "SELECT publisher AS reduce_result FROM games WHERE publisher IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1",
)
def reduce_mode(spark, sf):
    frame = SemFrame.of(read_table(spark, sf, "games").select("publisher"))
    return frame.semantic_reduce("Which publisher is the most frequent?", "publisher").optimized().to_spark(BACKEND)


@query("reduce_udf", "SELECT round(max(o_totalprice) - min(o_totalprice), 2) AS reduce_result FROM orders")
def reduce_udf(spark, sf):
    orders = read_table(spark, sf, "orders").select("o_totalprice")
    reduced = core.sem_reduce(orders, None, "o_totalprice", func=lambda v: v.max() - v.min())
    return reduced.select(F.round(F.col("reduce_result").cast("double"), 2).alias("reduce_result"))


@query(
    "reduce_model_grouped",
    "SELECT n_regionkey, min(n_name) AS reduce_result FROM nation GROUP BY n_regionkey",
)
def reduce_model_grouped(spark, sf):
    nation = read_table(spark, sf, "nation")
    return core.sem_reduce(nation, "Which name is the earliest in the alphabet?", "n_name", ["n_regionkey"], order_by="n_nationkey", backend=BACKEND)


@query("reduce_model_batched", "SELECT max(c_acctbal) AS reduce_result FROM customer")
def reduce_model_batched(spark, sf):
    """More values than one question holds: reduced in batches, then together."""
    customer = read_table(spark, sf, "customer")
    reduced = core.sem_reduce(customer, "What is the highest balance?", "c_acctbal", order_by="c_custkey", backend=BACKEND)
    return reduced.select(F.col("reduce_result").cast("double").alias("reduce_result"))


@query("reduce_empty", "SELECT 'No data to process.' AS reduce_result")
def reduce_empty(spark, sf):
    nothing = read_table(spark, sf, "orders").filter("o_totalprice < 0")
    return core.sem_reduce(nothing, "What is the total price?", "o_totalprice", backend=BACKEND)


# --- discovery -----------------------------------------------------------------------------------


@query(
    "lake_summary",
    """WITH t AS (SELECT table_id, unnest(column_names) AS c, generate_subscripts(column_names, 1) AS i
          FROM (SELECT table_id, column_names FROM lake_tables QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY loaded_at DESC) = 1))
       SELECT table_id, string_agg(c || ': values of ' || replace(c, '_', ' '), ' || ' ORDER BY i) AS column_summary FROM t GROUP BY table_id""",
)
def lake_summary(spark, sf):
    latest = read_table(spark, sf, "lake_tables").groupBy("table_id").agg(F.max_by("column_names", "loaded_at").alias("column_names"))
    named = latest.filter("size(column_names) > 0")
    return discover.summarize(named, backend=BACKEND).select("table_id", "column_summary")


_STOP = "['a','an','and','are','as','at','be','but','by','for','if','in','into','is','it','no','not','of','on','or','such','that','the','their','then','there','these','they','this','to','was','will','with']"
_SCORES = """
c AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM d WHERE len(tokens) > 0),
p AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(tokens) AS len, unnest(tokens) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
qt AS (SELECT DISTINCT query_id, unnest(tokens) AS term FROM q),
bm AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))) AS text_score
       FROM p JOIN f USING (term) JOIN qt USING (term), c GROUP BY query_id, id),
vs AS (SELECT query_id, id, CASE WHEN sqrt(list_dot_product(v::double[], v::double[])) * sqrt(list_dot_product(qv::double[], qv::double[])) > 0
          THEN list_dot_product(v::double[], qv::double[]) / (sqrt(list_dot_product(v::double[], v::double[])) * sqrt(list_dot_product(qv::double[], qv::double[]))) ELSE 0 END AS vector_score
       FROM d, q WHERE v IS NOT NULL AND qv IS NOT NULL)
"""


#: The searches ask every stored query: the rows whose id is divisible by this.
QUERY_EVERY = 100


def _all_docs(spark, sf) -> DataFrame:
    """Every item once; one without a text has no tokens and is found by its vector alone."""
    rows = read_table(spark, sf, "vectorize_outputs").groupBy("item_id").agg(
        F.min_by(F.struct("documents", "semantic_vectors"), "loaded_at").alias("d")
    )
    v = F.col("d.semantic_vectors")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    usable = (F.size(v) == 64) & finite & F.exists(v, lambda x: x != 0)
    return rows.select(
        F.col("item_id").alias("doc_id"),
        lexical_tokens(F.col("d.documents"), stem=False).alias("tokens"),
        F.when(usable, v).alias("vector"),
    )


def _all_queries(spark, sf) -> DataFrame:
    """Stored texts and embeddings side by side by id; an id that only one of them has is a query of that one."""
    chosen = lambda c: F.col(c) % QUERY_EVERY == 0
    texts = read_table(spark, sf, "documents").filter(chosen("doc_id")).select(F.col("doc_id").alias("query_id"), "text")
    vectors = read_table(spark, sf, "embeddings").filter(chosen("vec_id")).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return texts.withColumn("tokens", lexical_tokens(F.col("text"), stem=False)).join(vectors, "query_id", "full")


_SEARCH_ALL = f"""
WITH one AS (
  SELECT item_id AS id, documents, semantic_vectors AS v FROM vectorize_outputs
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY loaded_at) = 1),
d AS (SELECT id, list_filter(regexp_extract_all(lower(documents), '[\\p{{L}}\\p{{N}}]+'), lambda t: NOT list_contains({_STOP}, t)) AS tokens,
             CASE WHEN len(v) = 64 AND list_bool_and(list_transform(v, lambda x: coalesce(isfinite(x), false)))
                   AND list_bool_or(list_transform(v, lambda x: x <> 0)) THEN v END AS v FROM one),
q AS (SELECT coalesce(doc_id, vec_id) AS query_id, embedding AS qv,
             list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: NOT list_contains({_STOP}, w)) AS tokens
      FROM (SELECT doc_id, text FROM documents WHERE doc_id % 100 = 0)
      FULL JOIN (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0) ON doc_id = vec_id),
""" + _SCORES


@query(
    "bm25_topk_all",
    _SEARCH_ALL + """SELECT query_id, id, round(text_score, 6) AS text_score FROM bm
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(text_score, 9) DESC, id) <= 10""",
)
def bm25_topk_all(spark, sf):
    found = discover.lexical_search(_all_docs(spark, sf), _all_queries(spark, sf), 10)
    return found.withColumn("text_score", F.round("text_score", 6))


@query(
    "vector_topk_all",
    _SEARCH_ALL + """SELECT query_id, id, round(vector_score, 6) AS vector_score FROM vs
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(vector_score, 9) DESC, id) <= 10""",
)
def vector_topk_all(spark, sf):
    found = discover.vector_search(_all_docs(spark, sf), _all_queries(spark, sf), 10)
    return found.withColumn("vector_score", F.round("vector_score", 6))


@query(
    "hybrid_discover_all",
    _SEARCH_ALL + """, cand AS (
      (SELECT query_id, id FROM vs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(vector_score, 9) DESC, id) <= 15)
      UNION (SELECT query_id, id FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(text_score, 9) DESC, id) <= 15)),
    s AS (SELECT query_id, id, coalesce(text_score, 0) AS t, coalesce(vector_score, 0) AS v
          FROM cand LEFT JOIN bm USING (query_id, id) LEFT JOIN vs USING (query_id, id)),
    m AS (SELECT *, min(t) OVER w AS t0, max(t) OVER w AS t1, min(v) OVER w AS v0, max(v) OVER w AS v1 FROM s WINDOW w AS (PARTITION BY query_id)),
    h AS (SELECT query_id, id, 0.5 * CASE WHEN t1 > t0 THEN (t - t0) / (t1 - t0) ELSE 1 END
                             + 0.5 * CASE WHEN v1 > v0 THEN (v - v0) / (v1 - v0) ELSE 1 END AS score FROM m)
    SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS position FROM h
    QUALIFY position <= 5""",
)
def hybrid_discover_all(spark, sf):
    return discover.hybrid_search(_all_docs(spark, sf), _all_queries(spark, sf), topk=5, pool_factor=3)


# --- workloads -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Step:
    """One step of a workload: operator, instruction, column, and its SQL over the raw table."""

    op: str
    instruction: str
    column: str
    sql: str
    out: str = ""


def M(instruction, column, out, sql):
    return Step("map", instruction, column, sql, out)


def C(instruction, column, sql):
    return Step("filter", instruction, column, sql)


def R(instruction, column, sql):
    return Step("reduce", instruction, column, sql)


def has(column: str, word: str) -> str:
    return f"contains(lower({column}), '{word.lower()}')"


def classes(column: str, *options: str) -> str:
    *named, other = options
    cases = " ".join(f"WHEN {has(column, o)} THEN '{o}'" for o in named)
    return f"CASE WHEN {column} IS NULL THEN NULL {cases} ELSE '{other}' END"


_GENRE = M("Classify the plot as comedy, drama, western or other", "plot", "genre", classes("plot", "comedy", "drama", "western", "other"))
_KIND = M("Classify the game as strategy, puzzle, sports or other", "description", "genre", classes("description", "strategy", "puzzle", "sports", "other"))
_BEDS = M("Extract the number of bedrooms", "title", "beds", f"CAST(CAST({num('title')} AS decimal(38,2)) AS varchar)")
_COST = M("Extract the price", "details", "price", f"CAST(CAST({num('details')} AS decimal(38,2)) AS varchar)")
_COOL = M("Classify the details as garden, pool or none", "details", "amenities", classes("details", "garden", "pool", "none"))
_USD = M("Convert to a price in USD", "original_price", "price_usd", f"CAST(CAST({num('original_price')} AS decimal(38,2)) AS varchar)")
_DRAMA = C('The genre is "drama".', "genre", "genre = 'drama'")
_RATED = C("The rating is higher than 6", "imdb_rating", f"{num('imdb_rating')} > 6")
_LOW = C("The rating is lower than 9", "imdb_rating", f"{num('imdb_rating')} < 9")
_WON = C('The awards mention "win".', "awards", has("awards", "win"))
_SENT = C('The director contains "ro".', "director", has("director", "ro"))
_POSTER = C('The picture contains "png".', "poster", has("poster", "png"))
_WINDOWS = C('The platforms include "windows".', "platforms", has("platforms", "windows"))
_STRATEGY = C('The genre is "strategy".', "genre", "genre = 'strategy'")
_ENGLISH = C('The language is "english".', "language", "lower(trim(language)) = 'english'")
_SCORED = C("The score is at least 60", "metacriticts", f"{num('metacriticts')} >= 60")
_LABS = C('The developer contains "labs".', "developer", has("developer", "labs"))
_RATING_IMG = C('The picture contains "pegi_12".', "rating", has("rating", "pegi_12"))
_GAME_IMG = C('The picture contains "png".', "image", has("image", "png"))
_STYLE = M("Classify the picture as game, pegi or other", "image", "graphic_style", classes("image", "game", "pegi", "other"))
_ESTATE_IMG = C('The picture starts with "data:image".', "image", "image IS NOT NULL")
_PLACE = C('The location contains "ville".', "location", has("location", "ville"))
_FLAT = C('The title contains "flat".', "title", has("title", "flat"))
_BEDROOM = C('The title contains "bed".', "title", has("title", "bed"))


def AVG(c, said="What is the average?"):
    return R(said, c, f"CAST(round(avg({num(c)}), 6) AS double)")


def PICK(fn, c, said):
    return R(said, c, f"CAST(round({fn}({num(c)}), 6) AS double)")


def COUNT(c):
    return R("How many are there?", c, f"CAST(count({c}) AS double)")


def FIRST(c):
    return R("What is the earliest date?", c, f"min({c})")


WORKLOADS: dict[str, tuple[str, tuple[Step, ...]]] = {
    "movies_q1": ("movies", (_GENRE,)),
    "movies_q2": ("movies", (_SENT,)),
    "movies_q3": ("movies", (_POSTER,)),
    "movies_q4": ("movies", (_WON,)),
    "movies_q5": ("movies", (_RATED, PICK("sum", "boxoffice", "What is the total box office?"))),
    "movies_q6": ("movies", (_SENT, COUNT("title"))),
    "movies_q7": ("movies", (_GENRE, _SENT, PICK("max", "imdb_rating", "What is the highest rating?"))),
    "movies_q8": ("movies", (_RATED, _WON, COUNT("title"))),
    "movies_q9": ("movies", (_GENRE, _RATED, _LOW, _DRAMA, PICK("max", "imdb_rating", "What is the highest rating?"))),
    "movies_q10": ("movies", (_GENRE, _RATED, _LOW, _DRAMA, COUNT("title"))),
    "movies_q11": ("movies", (_GENRE, _RATED, _DRAMA, AVG("runtime"))),
    "movies_q12": ("movies", (_GENRE, _RATED, _DRAMA, M("Give the first word of the plot", "plot", "character", "regexp_extract(plot, '[^ \\t\\n\\r\\f\\v]+')"))),
    "games_q1": ("games", (_RATING_IMG,)),
    "games_q2": ("games", (M("Classify the reviews as positive, negative or mixed", "overall_reviews", "comments", classes("overall_reviews", "positive", "negative", "mixed")),)),
    "games_q3": ("games", (_WINDOWS,)),
    "games_q4": ("games", (_STYLE,)),
    "games_q5": ("games", (_KIND, _STRATEGY, R("Which publisher is the most frequent?", "publisher", "mode_of(publisher)"))),
    "games_q6": ("games", (_WINDOWS, PICK("min", "discounted_price", "What is the lowest price?"))),
    "games_q7": ("games", (_KIND, _STRATEGY, _ENGLISH)),
    "games_q8": ("games", (_SCORED, _LABS, COUNT("title"))),
    "games_q9": ("games", (_KIND, _STRATEGY, _ENGLISH, _USD, AVG("price_usd"))),
    "games_q10": ("games", (_KIND, _STRATEGY, _GAME_IMG, _WINDOWS, AVG("original_price"))),
    "games_q11": ("games", (_WINDOWS, FIRST("release_date"))),
    "games_q12": ("games", (_STYLE, _WINDOWS, _KIND, _STRATEGY, FIRST("release_date"))),
    "estates_q1": ("estates", (_ESTATE_IMG,)),
    "estates_q2": ("estates", (_COST,)),
    "estates_q3": ("estates", (_PLACE,)),
    "estates_q4": ("estates", (_COOL,)),
    "estates_q5": ("estates", (_FLAT, _COOL, _BEDROOM)),
    "estates_q6": ("estates", (_COST, _ESTATE_IMG, AVG("price"))),
    "estates_q7": ("estates", (M("Give the first word", "details", "features", "regexp_extract(details, '[^ \\t\\n\\r\\f\\v]+')"), _FLAT)),
    "estates_q8": ("estates", (_COOL, _BEDROOM)),
    "estates_q9": ("estates", (_COST, _PLACE, _BEDROOM, AVG("price"))),
    "estates_q10": ("estates", (_COST, _PLACE, _BEDROOM, _ESTATE_IMG, PICK("min", "price", "What is the lowest price?"))),
    "estates_q11": ("estates", (_BEDS, _COOL, _FLAT, PICK("min", "beds", "What is the lowest number?"))),
    "estates_q12": ("estates", (_COST, _COOL, _PLACE, _BEDROOM, _ESTATE_IMG, AVG("price"))),
}
MEDIA_COLUMNS = {"movies": ("poster",), "games": ("image", "rating"), "estates": ("image",)}


def workload_frame(spark: SparkSession, sf: str, name: str) -> SemFrame:
    table, steps = WORKLOADS[name]
    df = read_table(spark, sf, table)
    for column in MEDIA_COLUMNS[table]:
        df = load_media(df, column, "image") if table == "estates" else as_media(df, column, "image")
    frame = SemFrame.of(df.drop("crawled_at"), table)
    for s in steps:
        if s.op == "map":
            frame = frame.semantic_map(s.instruction, s.column, s.out)
        elif s.op == "filter":
            frame = frame.semantic_filter(s.instruction, s.column)
        else:
            frame = frame.semantic_reduce(s.instruction, s.column)
    return frame


def _workload(name: str, optimized: bool = True) -> QueryFn:
    steps = WORKLOADS[name][1]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        frame = workload_frame(spark, sf, name)
        df = (frame.optimized() if optimized else frame).to_spark(BACKEND)
        last = steps[-1]
        if last.op != "reduce":
            return df.select("row_id", *[s.out for s in steps if s.op == "map"])
        text = last.sql.startswith(("min(", "mode_of("))
        result = F.col("reduce_result")
        return df.select(result if text else F.round(result.try_cast("double"), 6).alias("reduce_result"))

    return run


def _workload_sql(name: str) -> str:
    """Nested selects over the raw table, in the order of the steps."""
    table, steps = WORKLOADS[name]
    sql = f"SELECT * FROM {table}"
    kept = [s.out for s in steps if s.op == "map"]
    for s in steps:
        if s.op == "map":
            sql = f"SELECT *, {s.sql} AS {s.out} FROM ({sql})"
        elif s.op == "filter":
            sql = f"SELECT * FROM ({sql}) WHERE {s.sql}"
        elif s.sql.startswith("mode_of("):
            c = s.column
            sql = f"SELECT {c} AS reduce_result FROM ({sql}) WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1"
            return sql
        else:
            empty = "'No data to process.'" if s.sql.startswith("min(") else "NULL"
            return f"SELECT CASE WHEN count({s.column}) = 0 THEN {empty} ELSE {s.sql} END AS reduce_result FROM ({sql})"
    return f"SELECT {', '.join(['row_id', *kept])} FROM ({sql})"


for _name in WORKLOADS:
    query(_name, _workload_sql(_name))(_workload(_name))


@query("movies_q9_model", _workload_sql("movies_q9"))
def movies_q9_model(spark, sf):
    """The same query with every step asked of the model, in the order written."""
    return _workload("movies_q9", optimized=False)(spark, sf)


@query("movies_q12_pushed", _workload_sql("movies_q12"))
def movies_q12_pushed(spark, sf):
    """Filters pushed below model maps, without replacing any instruction."""
    frame = workload_frame(spark, sf, "movies_q12").optimized(OptimizeConfig(replacement=False))
    return frame.to_spark(BACKEND).select("row_id", "genre", "character")


@query(
    "cost_report",
    f"""SELECT 'as written' AS plan, round(CAST(count(*) AS double) * 0.01, 6) AS cost FROM movies WHERE plot IS NOT NULL
        UNION ALL SELECT 'filters first', round(CAST(count(*) AS double) * 0.01, 6) FROM movies WHERE plot IS NOT NULL AND {has('director', 'ro')}""",
)
def cost_report(spark, sf):
    """What the calls of a map cost before and after a native filter is pushed below it."""
    rows = []
    for plan, push in (("as written", False), ("filters first", True)):
        frame = SemFrame.of(read_table(spark, sf, "movies")).semantic_map(_GENRE.instruction, "plot", "genre")
        frame = frame.semantic_filter(None, "director", func="contains(lower(director), 'ro')")
        frame = frame.semantic_reduce(None, "genre", func="count(genre)")
        _, spend = frame.optimized(OptimizeConfig(replacement=False, pushdown=push)).execute(BACKEND)
        rows.append((plan, round(spend.cost, 6)))
    return spark.createDataFrame(rows, "plan string, cost double")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return QUERIES["movies_q9"](spark, sf)
