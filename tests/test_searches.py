import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from semspan.operators import discover
from semspan.plans import workload
from semspan.runtime import read_table

FOLDER = os.environ.get("SEMSPAN_TEST_DATA", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_every_stored_query_is_asked(spark):
    vectors = {r[0] for r in read_table(spark, FOLDER, "embeddings").filter("vec_id % 100 = 0").select("vec_id").collect()}
    texts = {r[0] for r in read_table(spark, FOLDER, "documents").filter("doc_id % 100 = 0 and text is not null").select("doc_id").collect()}
    found = {r[0] for r in workload.QUERIES["vector_topk_all"](spark, FOLDER).select("query_id").collect()}
    assert len(vectors) > 3 and found == vectors
    asked = workload._all_queries(spark, FOLDER)
    assert {r[0] for r in asked.filter("tokens is not null").select("query_id").collect()} == texts
    assert {r[0] for r in workload.QUERIES["hybrid_discover_all"](spark, FOLDER).select("query_id").collect()} >= vectors


def test_items_without_a_text_are_searched(spark, tmp_path):
    v = [1.0] + [0.0] * 63
    bad = [[0.0] * 64, [float("nan")] + v[1:], [float("inf")] + v[1:], v[:63], None]
    rows = [(1, None, v, 0), (2, "a red house", v, 0)] + [(3 + i, None, b, 0) for i, b in enumerate(bad)]
    schema = "item_id long, documents string, semantic_vectors array<float>, loaded_at long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "vectorize_outputs.parquet"))
    queries = spark.createDataFrame([(0, v)], "query_id long, vector array<float>")
    found = discover.vector_search(workload._all_docs(spark, str(tmp_path)), queries, 10).select("id", F.round("vector_score", 6))
    assert sorted(map(tuple, found.collect())) == [(1, 1.0), (2, 1.0)]


def test_searches_equal_brute_force_in_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(40)]
    say = lambda n: [str(w) for w in rng.choice(words, n)]
    docs = [(i, say(int(rng.integers(0, 30))) if i % 7 else None, [float(v) for v in rng.integers(-2, 3, 4)] if i % 5 else None) for i in range(300)]
    queries = [(i, say(3) if i % 4 else None, [float(v) for v in rng.integers(-2, 3, 4)]) for i in range(23)]
    d = spark.createDataFrame(docs, "doc_id long, tokens array<string>, vector array<float>").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, tokens array<string>, vector array<float>")
    lengths = [len(t) for _, t, _ in docs if t]
    mean, n = sum(lengths) / len(lengths), len(lengths)
    df = {w: sum(w in (t or ()) for _, t, _ in docs) for w in words}
    idf = {w: math.log1p((n - c + 0.5) / (c + 0.5)) for w, c in df.items()}
    text, near = {}, {}
    for qi, qt, qv in queries:
        for di, dt, dv in docs:
            tf = {w: (dt or []).count(w) for w in set(qt or ())}
            if any(tf.values()):
                text[qi, di] = sum(idf[w] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(dt) / mean)) for w, f in tf.items() if f)
            if dv is not None:
                size = np.linalg.norm(qv) * np.linalg.norm(dv)
                near[qi, di] = float(np.dot(qv, dv) / size) if size else 0.0

    def best(scores, k):
        return {(a, b): s for qi, _, _ in queries for (a, b), s in sorted(((p, s) for p, s in scores.items() if p[0] == qi), key=lambda x: (-round(x[1], 9), x[0]))[:k]}

    for block, at_once, sums in ((1_024, 2_000_000, 4_000_000), (5, 60, 50)):
        for name, value in (("QUERY_BLOCK", block), ("SCORES_AT_ONCE", at_once), ("SUMS_AT_ONCE", sums)):
            monkeypatch.setattr(discover, name, value)
        got = {(r[0], r[1]): r[2] for r in discover.lexical_search(d, q, 5).collect()}
        assert got == pytest.approx(best(text, 5))
        got = {(r[0], r[1]): r[2] for r in discover.vector_search(d, q, 5).collect()}
        assert got == pytest.approx(best(near, 5))
        pool = {p: (text.get(p, 0.0), near.get(p, 0.0)) for p in {**best(text, 6), **best(near, 6)}}
        scaled = lambda v, all_: (v - min(all_)) / (max(all_) - min(all_)) if max(all_) > min(all_) else 1.0
        want = {}
        for p, (t, v) in pool.items():
            own = [x for k, x in pool.items() if k[0] == p[0]]
            want[p] = 0.5 * scaled(t, [x for x, _ in own]) + 0.5 * scaled(v, [x for _, x in own])
        got = {(r["query_id"], r["id"]): r["score"] for r in discover.hybrid_search(d, q, topk=2, pool_factor=3).collect()}
        assert got == pytest.approx(best(want, 2), abs=1e-6)
    assert discover.lexical_search(d, q.limit(0), 5).count() == 0 and discover.hybrid_search(d.limit(0), q, 5).count() == 0
