"""Queries of the engine's other surfaces: lazy frames, sources and sinks, the lake, streams, planning.

They are registered beside those of ``workload`` and run over whole tables. What a source is tried on is first written by
Spark to the folder that the cluster shares.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semspan.backends import ScriptedBackend
from semspan.frame import SemFrame, json_lines
from semspan.operators import core, discover
from semspan.plans import workload
from semspan.plans.physical import OptimizeConfig
from semspan.plans.workload import BACKEND, CLASSIFY, MENTIONS, ORACLES, _all_docs, _all_queries, _documents, query
from semspan.runtime import ensure_checkpoint_dir, read_table
from semspan.sources import readers
from semspan.sources.lake import Lake
from semspan.streaming.stateless import start


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, where all executors can write and read; deleted when the application ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/semspan-work-{uuid.uuid4().hex}/{name}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


# --- joins over tables that grow -----------------------------------------------------------------

_SAME = "Both are the same name"
_SOURCES = """SELECT doc_id, d.source AS source, m.source AS target, target_share FROM (SELECT doc_id, source FROM documents) d
    {how} JOIN mix_targets m ON lower(trim(d.source)) = lower(trim(m.source))"""


def _sources(spark, sf, how="inner", **kwargs) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "source")
    targets = read_table(spark, sf, "mix_targets").select(F.col("source").alias("target"), "target_share")
    return core.sem_join(docs, targets, _SAME, "source", "target", "doc_id", "target", how, backend=BACKEND, **kwargs)


@query("join_grow_inner", _SOURCES.format(how=""))
def join_grow_inner(spark, sf):
    return _sources(spark, sf)


@query("join_grow_left", _SOURCES.format(how="LEFT"))
def join_grow_left(spark, sf):
    return _sources(spark, sf, "left")


@query("join_grow_right", _SOURCES.format(how="RIGHT"))
def join_grow_right(spark, sf):
    return _sources(spark, sf, "right")


@query("join_grow_udf", _SOURCES.format(how=""))
def join_grow_udf(spark, sf):
    return _sources(spark, sf, func=lambda l, r: l.strip().lower() == r.strip().lower())


@query("join_grow_block", _SOURCES.format(how=""))
def join_grow_block(spark, sf):
    return _sources(spark, sf, strategy="block", batch_size=100)


@query("join_grow_only_where", _SOURCES.format(how=""))
def join_grow_only_where(spark, sf):
    """Only pairs with the same first letter are made and asked about."""
    return _sources(spark, sf, only_where="lower(left(l, 1)) = lower(left(r, 1))")


@query("join_lazy", _SOURCES.format(how=""))
def join_lazy(spark, sf):
    docs = SemFrame.of(read_table(spark, sf, "documents").select("doc_id", "source"))
    targets = SemFrame.of(read_table(spark, sf, "mix_targets").select(F.col("source").alias("target"), "target_share"))
    return docs.semantic_join(targets, _SAME, "source", "target", "doc_id", "target").to_spark(BACKEND)


# --- ranks and reduces ---------------------------------------------------------------------------

_SIZES = "SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS ranking FROM part"


@query("rank_model_ties", _SIZES)
def rank_model_ties(spark, sf):
    """Fifty different sizes, whatever the number of parts."""
    part = read_table(spark, sf, "part").select("p_partkey", "p_size")
    return core.sem_rank(part, "The highest size first", "p_size", "p_partkey", backend=BACKEND).drop("p_size")


@query("rank_lazy", "SELECT n_nationkey, row_number() OVER (ORDER BY n_name, n_nationkey) AS ranking FROM nation")
def rank_lazy(spark, sf):
    frame = SemFrame.of(read_table(spark, sf, "nation").select("n_nationkey", "n_name"))
    return frame.semantic_rank("In alphabetical order", "n_name", "n_nationkey").to_spark(BACKEND).drop("n_name")


def _number(df: DataFrame, digits: int = 2) -> DataFrame:
    return df.withColumn("reduce_result", F.round(F.col("reduce_result").cast("double"), digits))


for _name, _words, _sql in (
    ("count", "How many balances are there?", "CAST(count(c_acctbal) AS double)"),
    ("avg", "What is the average balance?", "round(avg(c_acctbal), 2)"),
    ("sum", "What is the total of the balances?", "round(sum(c_acctbal), 2)"),
    ("min", "What is the lowest balance?", "round(min(c_acctbal), 2)"),
):

    def _run(spark, sf, words=_words):
        customer = read_table(spark, sf, "customer").select("c_custkey", "c_acctbal")
        return _number(core.sem_reduce(customer, words, "c_acctbal", order_by="c_custkey", backend=BACKEND))

    query(f"reduce_model_{_name}", f"SELECT {_sql} AS reduce_result FROM customer")(_run)


@query("reduce_model_mode", "SELECT c_mktsegment AS reduce_result FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
def reduce_model_mode(spark, sf):
    customer = read_table(spark, sf, "customer").select("c_mktsegment")
    return core.sem_reduce(customer, "Which segment is the most frequent?", "c_mktsegment", backend=BACKEND)


@query(
    "reduce_model_grouped_avg",
    "SELECT o_orderpriority, round(avg(o_totalprice), 2) AS reduce_result FROM orders GROUP BY o_orderpriority",
)
def reduce_model_grouped_avg(spark, sf):
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    words = "What is the average price?"
    return _number(core.sem_reduce(orders, words, "o_totalprice", ["o_orderpriority"], order_by="o_orderkey", backend=BACKEND))


@query("reduce_udf_combined", "SELECT round(max(l_extendedprice) - min(l_extendedprice), 2) AS reduce_result FROM lineitem")
def reduce_udf_combined(spark, sf):
    """A function over parts of bounded size, and one that puts their results together."""
    lineitem = read_table(spark, sf, "lineitem").select("l_extendedprice")
    reduced = core.sem_reduce(
        lineitem, None, "l_extendedprice", func=lambda v: (v.min(), v.max()),
        combine=lambda parts: max(b for _, b in parts) - min(a for a, _ in parts),
    )
    return _number(reduced)


# --- strategies ----------------------------------------------------------------------------------


@query("filter_fewshot", "SELECT doc_id FROM documents WHERE contains(lower(text), 'captain')")
def filter_fewshot(spark, sf):
    shown = [{"data": {"text": "The captain left."}, "answer": "True"}, {"data": {"text": "A red house."}, "answer": "False"}]
    return workload._filter(spark, sf, strategy="fewshot", context=shown)


@query("map_assertions", "SELECT doc_id, CASE WHEN topic <> 'other' THEN topic END AS topic FROM (" + ORACLES["map_plain"] + ")")
def map_assertions(spark, sf):
    return workload._map(spark, sf, assertions=[lambda v: v != "other"])


@query("map_rate_limit", ORACLES["map_plain"])
def map_rate_limit(spark, sf):
    return workload._map(spark, sf, rate_limit=4)


@query("map_appended", ORACLES["map_plain"])
def map_appended(spark, sf):
    """Two batches mapped apart and put together."""
    docs = _documents(spark, sf)
    half = lambda n: core.sem_map(docs.filter(F.pmod("doc_id", F.lit(2)) == n), CLASSIFY, ["text"], ["topic"], backend=BACKEND)
    return half(0).unionByName(half(1)).select("doc_id", "topic")


# --- planning ------------------------------------------------------------------------------------


@query("plan_written_expressions", "SELECT doc_id FROM documents WHERE length(text) > 300 AND contains(lower(text), 'captain')")
def plan_written_expressions(spark, sf):
    """A model writes an expression for an instruction that the grammar does not know; a harmful one is not used."""
    script = (("TASK: Write", "```sql\nlength(text) > 300\n```"),)
    harmful = ScriptedBackend(script=(("TASK: Write", "```sql\nreflect('java.lang.System', 'exit', 0)\n```"),))
    frame = SemFrame.of(_documents(spark, sf)).semantic_filter("It is a rather long text", "text")
    frame = frame.semantic_filter(None, "text", func="contains(lower(text), 'captain')")
    config = OptimizeConfig(rewrite=True)
    if frame.optimized(config, harmful).plan != frame.optimized(OptimizeConfig()).plan:
        raise AssertionError("a harmful expression was used")
    written, _ = frame.optimize_and_execute(config, ScriptedBackend(script=script))
    return written.select("doc_id")


@query("plan_fused", f"SELECT doc_id, {workload._CLASS_SQL} AS topic FROM documents WHERE contains(lower(text), 'captain')")
def plan_fused(spark, sf):
    frame = SemFrame.of(_documents(spark, sf)).semantic_filter(MENTIONS, "text").semantic_map(CLASSIFY, "text", "topic")
    return frame.optimized(OptimizeConfig(replacement=False, fusion=True)).to_spark(BACKEND).select("doc_id", "topic")


@query("plan_chosen_model", ORACLES["map_plain"])
def plan_chosen_model(spark, sf):
    """The model is chosen on a sample, whose answers are kept."""
    frame = SemFrame.of(_documents(spark, sf)).semantic_map(CLASSIFY, "text", "topic")
    done, _ = frame.optimize_and_execute(OptimizeConfig(replacement=False, choose_models=True), BACKEND)
    return done.select("doc_id", "topic")


@query(
    "plan_calls",
    f"""SELECT 'as written' AS plan, CAST(count(text) + sum(CASE WHEN {workload._CLASS_SQL} IS NOT NULL THEN 1 ELSE 0 END) AS bigint) AS calls FROM documents
        UNION ALL SELECT 'native', 0""",
)
def plan_calls(spark, sf):
    """Model calls of a map and a filter on what it made, as written and after native replacement."""
    frame = SemFrame.of(_documents(spark, sf)).semantic_map(CLASSIFY, "text", "topic").semantic_filter('It is "game".', "topic")
    rows = [(name, f.execute(BACKEND)[1].calls) for name, f in (("as written", frame), ("native", frame.optimized()))]
    return spark.createDataFrame(rows, "plan string, calls long")


@query("frame_json", "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS value FROM region")
def frame_json(spark, sf):
    return json_lines(read_table(spark, sf, "region").select("r_regionkey", "r_name"))


@query("frame_memory", "SELECT * FROM (VALUES (1, 'A'), (2, 'B')) t(id, loud)")
def frame_memory(spark, sf):
    frame = SemFrame.create(spark, {"id": [1, 2], "name": ["a", "b"]}).semantic_map("Give it in upper case", "name", "loud")
    return frame.optimized().to_spark(BACKEND).select(F.col("id").cast("int").alias("id"), "loud")


# --- discovery -----------------------------------------------------------------------------------


@query(
    "lake_records",
    "SELECT 'r_regionkey: ' || r_regionkey || ' | r_name: ' || r_name AS record FROM region",
)
def lake_records(spark, sf):
    """As many records are sampled as the table has."""
    region = read_table(spark, sf, "region").select("r_regionkey", "r_name")
    found = discover.record_summary(region, n_records=5)
    return found.select(F.explode(F.split("record_summary", r" \|\| ")).alias("record"))


_LATEST = """SELECT table_id, column_names, context FROM lake_tables
    QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY loaded_at DESC, column_names DESC NULLS LAST, context DESC NULLS LAST) = 1"""


def _lake_tables(spark, sf) -> DataFrame:
    newest = F.struct("loaded_at", "column_names", "context")
    latest = read_table(spark, sf, "lake_tables").groupBy("table_id").agg(F.max(newest).alias("t"))
    return latest.select("table_id", "t.column_names", "t.context")


@query(
    "lake_vectorize",
    f"""WITH t AS ({_LATEST})
        SELECT table_id || '_column' AS doc_id, 'COLUMN' AS type, array_to_string(column_names, ' || ') AS document FROM t WHERE column_names IS NOT NULL
        UNION ALL SELECT table_id || '_context', 'CONTEXT', context FROM t WHERE context IS NOT NULL""",
)
def lake_vectorize(spark, sf):
    summaries = _lake_tables(spark, sf).select(
        "table_id", F.array_join("column_names", " || ").alias("column_summary"), F.lit(None).cast("string").alias("record_summary"), "context"
    )
    made = discover.vectorize(summaries, backend=BACKEND)
    return made.filter((F.size("vector") == 64) & F.col("tokens").isNotNull()).select("doc_id", "type", "document")


@query(
    "rerank",
    ORACLES["bm25_topk_all"].replace("SELECT query_id, id, round(text_score, 6) AS text_score FROM bm", ", best AS (SELECT query_id, id, text_score FROM bm", 1)
    + """), judged AS (
      SELECT b.query_id, b.id, round(text_score, 9) AS s, regexp_matches(lower(concat_ws(' ', o.documents, t.text)), '(^|[^\\p{L}\\p{N}_])(data|relevant|query)($|[^\\p{L}\\p{N}_])') AS relevant
      FROM best b JOIN one o USING (id) JOIN documents t ON t.doc_id = b.query_id)
    SELECT query_id, id, relevant, row_number() OVER (PARTITION BY query_id ORDER BY relevant DESC, s DESC, id) AS position FROM judged""",
)
def rerank(spark, sf):
    """The documents found by their words, those a model calls relevant first."""
    rows = read_table(spark, sf, "vectorize_outputs").groupBy("item_id").agg(F.min_by("documents", "loaded_at").alias("document"))
    found = discover.lexical_search(_all_docs(spark, sf), _all_queries(spark, sf), 10)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("text_score", 9)), "id")
    ordered = found.select("query_id", "id", F.col("text_score").alias("score"), F.row_number().over(order).alias("position"))
    texts = read_table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), "text")
    return discover.rerank(ordered, rows, texts, id_col="item_id", backend=BACKEND).select("query_id", "id", "relevant", "position")


def _lake_folder(spark, sf) -> str:
    """A lake of three tables as CSV, in subfolders, with a context for one of them."""
    root = work_folder(spark, "lake")
    for name in ("nation", "region", "supplier"):
        readers.write(read_table(spark, sf, name).coalesce(1), f"{root}/tables/{name}", "csv")
    spark.createDataFrame([("Where suppliers are.",)], "value string").coalesce(1).write.text(f"{root}/context")
    return root


@query(
    "lake_register",
    "SELECT * FROM (VALUES ('nation', ['n_nationkey', 'n_name', 'n_regionkey']), ('region', ['r_regionkey', 'r_name']), "
    "('supplier', ['s_suppkey', 's_name', 's_nationkey', 's_acctbal'])) t(name, columns)",
)
def lake_register(spark, sf):
    """Files of a folder tree are registered, their headers and records read in one job, and each is summarised."""
    lake = Lake(spark, backend=BACKEND).register(f"{_lake_folder(spark, sf)}/tables").summarize()
    known = lake.catalog.filter("column_summary is not null and record_summary is not null")
    return known.select(F.regexp_extract("path", r"/([a-z]+)/[^/]+$", 1).alias("name"), F.col("column_names").alias("columns"))


@query("lake_discover", "SELECT 'supplier' AS name, 1 AS position")
def lake_discover(spark, sf):
    lake = Lake(spark, backend=BACKEND).register(f"{_lake_folder(spark, sf)}/tables").summarize().build_index()
    index = work_folder(spark, "index")
    lake.save_index(index)
    found = lake.load_index(index).discover(["the balance (acctbal) of a supplier"], topk=1, rerank=True)
    named = found.join(lake.catalog.select(F.col("table_id").cast("string").alias("table_ids"), "path"), "table_ids")
    return named.select(F.regexp_extract("path", r"/([a-z]+)/[^/]+$", 1).alias("name"), "position")


# --- sources, sinks, streams ---------------------------------------------------------------------

_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def _nation(spark, sf) -> DataFrame:
    return read_table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")


def _round_trip(fmt: str, read) -> workload.QueryFn:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        nation, path = _nation(spark, sf), work_folder(spark, fmt)
        readers.write(nation, path, fmt)
        return read(spark, path, nation.schema).select(*nation.columns)

    return run


for _fmt, _read in (
    ("csv", lambda spark, path, schema: readers.read_csv(spark, path)),
    ("json", lambda spark, path, schema: readers.read_json(spark, path, schema)),
    ("parquet", lambda spark, path, schema: readers.read_parquet(spark, path)),
    ("orc", lambda spark, path, schema: spark.read.orc(path)),
):
    query(f"source_{_fmt}", _NATION)(_round_trip(_fmt, _read))


@query("source_delimited", _NATION)
def source_delimited(spark, sf):
    path = work_folder(spark, "delimited")
    readers.write(_nation(spark, sf), path, "csv", sep="|")
    return readers.read_delimited(spark, path, "|", _nation(spark, sf).schema)


@query("source_text", "SELECT r_name AS line FROM region")
def source_text(spark, sf):
    path = work_folder(spark, "text")
    readers.write(read_table(spark, sf, "region").select("r_name"), path, "text")
    return readers.read_text(spark, path).select(F.explode(F.split(F.rtrim("text", F.lit("\n")), "\n")).alias("line"))


@query("sink_partitioned", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def sink_partitioned(spark, sf):
    path = work_folder(spark, "orders")
    readers.write(read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), path, partition_by=("o_orderstatus",))
    return readers.read_parquet(spark, path).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("media_kinds", "SELECT * FROM (VALUES ('games', 'image', 'image'), ('games', 'title', 'str'), ('movies', 'poster', 'image')) t(name, col, kind)")
def media_kinds(spark, sf):
    looked = (("games", "image"), ("games", "title"), ("movies", "poster"))
    return spark.createDataFrame([(t, c, readers.infer_media_kind(read_table(spark, sf, t), c)) for t, c in looked], "name string, col string, kind string")


@query("media_binary", "SELECT row_id, 'data:image/png;base64,' || base64(image) AS image FROM estates")
def media_binary(spark, sf):
    return readers.load_media(read_table(spark, sf, "estates").select("row_id", "image"), "image", "image")


@query("stream_map_filter", f"SELECT doc_id, {workload._CLASS_SQL} AS topic FROM documents WHERE contains(lower(text), 'captain')")
def stream_map_filter(spark, sf):
    """The table as a stream of files, filtered and mapped by the model, written exactly once."""
    documents = read_table(spark, sf, "documents")
    live = spark.readStream.schema(documents.schema).parquet(f"{sf}/documents.parquet*").select("doc_id", "text")
    frame = SemFrame.of(live).semantic_filter(MENTIONS, "text").semantic_map(CLASSIFY, "text", "topic")
    out = work_folder(spark, "stream")
    start(frame, out, f"{out}-checkpoint", BACKEND).awaitTermination()
    return spark.read.parquet(out).select("doc_id", "topic")


# --- what Spark brings itself --------------------------------------------------------------------


@query("native_set_operations", "SELECT n_regionkey AS key FROM nation EXCEPT SELECT r_regionkey FROM region WHERE r_regionkey > 2")
def native_set_operations(spark, sf):
    nation = read_table(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("key"))
    region = read_table(spark, sf, "region").filter("r_regionkey > 2").select(F.col("r_regionkey").cast("long").alias("key"))
    return nation.subtract(region)


@query("native_window", "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS place FROM orders")
def native_window(spark, sf):
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))
    return read_table(spark, sf, "orders").select("o_orderkey", F.rank().over(order).alias("place"))


@query("native_sql", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def native_sql(spark, sf):
    return spark.sql(
        "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM {customer} GROUP BY ROLLUP (c_mktsegment, c_nationkey)",
        customer=read_table(spark, sf, "customer"),
    )


@query("native_distinct_over_map", f"SELECT DISTINCT {workload._CLASS_SQL} AS topic FROM documents")
def native_distinct_over_map(spark, sf):
    return SemFrame.of(_documents(spark, sf)).semantic_map(CLASSIFY, "text", "topic").optimized().to_spark(BACKEND).select("topic").distinct()
