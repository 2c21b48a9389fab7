import base64

import pytest
from pyspark.sql import functions as F

from semspan.backends import RuleBackend
from semspan.frame import SemFrame
from semspan.functions.columns import cosine, merge_segments
from semspan.operators import discover
from semspan.sources import readers
from semspan.sources.lake import Lake
from semspan.streaming.stateless import start, stream

RULES = RuleBackend()


def test_delimited_json_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"'), (2, "a,b")], "id int, text string")
    for fmt, read in (("csv", readers.read_csv), ("json", readers.read_json), ("parquet", readers.read_parquet)):
        path = str(tmp_path / fmt)
        readers.write(df, path, fmt, **({"escape": '"'} if fmt == "csv" else {}))
        assert sorted((r["id"], r["text"]) for r in read(spark, path).collect()) == [(1, 'say "hi"'), (2, "a,b")]
    (tmp_path / "t.tsv").write_text("id\tname\n1\tx\n")
    assert readers.read_delimited(spark, str(tmp_path / "t.tsv"), "\t").first()["name"] == "x"


def test_media(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG")
    (tmp_path / "b.txt").write_text("no")
    rows = [(1, "a.png"), (2, "https://x/y.png"), (3, None), (4, "gone.png"), (5, "data:image/png;base64,AA==")]
    df = spark.createDataFrame(rows, "id int, pic string")
    assert readers.infer_media_kind(df, "pic") == "image"
    loaded = readers.load_media(df, "pic", "image", root=str(tmp_path))
    got = {r["id"]: r["pic"] for r in loaded.collect()}
    assert got[1] == "data:image/png;base64," + base64.b64encode(b"\x89PNG").decode()
    assert got[2] == "https://x/y.png" and got[3] is None and got[4] is None and got[5].startswith("data:")
    assert loaded.schema["pic"].metadata == {"semtype": "image"}
    assert readers.scan_media(spark, str(tmp_path)).count() == 1
    binary = spark.createDataFrame([(bytearray(b"x"),), (None,)], "pic binary")
    assert [r[0] for r in readers.load_media(binary, "pic", "image").collect()] == ["data:image/png;base64,eA==", None]
    with pytest.raises(ValueError):
        readers.as_media(df, "pic", "video")


def test_lake(spark, tmp_path):
    (tmp_path / "lake/sub").mkdir(parents=True)
    (tmp_path / "lake/pets.csv").write_text("name,age\nRex,3\nTom,4\n")
    (tmp_path / "lake/sub/planets.csv").write_text("planet,mass\nMars,0.1\nEarth,1.0\n")
    (tmp_path / "ctx").mkdir()
    (tmp_path / "ctx/pets.txt").write_text("Animals and how old they are.")
    lake = Lake(spark, backend=RULES).register(str(tmp_path / "lake")).with_context(str(tmp_path / "ctx"))
    assert lake.catalog.count() == 2
    lake = lake.summarize().build_index()
    assert lake.index.count() == 5
    lake.save_index(str(tmp_path / "index"))
    again = lake.load_index(str(tmp_path / "index"))
    found = again.discover(["mass of the planet Mars"], topk=2, rerank=True).orderBy("position").collect()
    pets = {r["table_id"] for r in lake.catalog.filter(F.col("path").contains("pets")).collect()}
    assert int(found[0]["table_ids"]) not in pets and found[0]["types"] in ("COLUMN", "RECORD")


def test_merge_and_cosine(spark):
    df = spark.createDataFrame([(["aa", "bb", "cc"], [1.0, 0.0], [1.0, 1.0])], "s array<string>, a array<double>, b array<double>")
    row = df.select(
        merge_segments(F.col("s"), 9, truncate=True).alias("cut"), merge_segments(F.col("s")).alias("all"), cosine(F.col("a"), F.col("b")).alias("c")
    ).first()
    assert row["cut"] == "aa || bb" and row["all"] == "aa || bb || cc" and row["c"] == pytest.approx(2**-0.5)


def test_equal_scores_scale_to_one(spark):
    docs = spark.createDataFrame([("1_column", ["x"], [1.0, 0.0]), ("2_column", ["x"], [1.0, 0.0])], "doc_id string, tokens array<string>, vector array<double>")
    queries = spark.createDataFrame([(0, ["x"], [1.0, 0.0])], "query_id long, tokens array<string>, vector array<double>")
    found = discover.hybrid_search(docs, queries, topk=2).orderBy("position").collect()
    assert [(r["id"], r["score"]) for r in found] == [("1_column", 1.0), ("2_column", 1.0)]


def test_stream_of_map_and_filter(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "A river"), (2, "A hill"), (3, None)], "id int, text string").write.parquet(source)
    live = spark.readStream.schema("id int, text string").parquet(source)
    frame = SemFrame.of(live).semantic_filter('It mentions "river".', "text").semantic_map("in upper case", "text", "loud")
    query = start(frame, str(tmp_path / "out"), str(tmp_path / "cp"), RULES)
    query.awaitTermination(60)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "A river", "A RIVER")]
    with pytest.raises(ValueError):
        stream(SemFrame.of(live).semantic_reduce("How many?", "text"), RULES)
