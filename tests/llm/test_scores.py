import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from semspan.llm import distinctive, fusion, neighbors
from semspan.llm.mixing import PERIOD, mix, mix_report, pfair_slots, source_plan, whole_weights


def test_fusion_ignores_ranges_missing_scores_and_old_deliveries(spark):
    rows = []
    for i in range(10):
        good = i < 3
        rows += [(1, i, "a", 10.0 + i * 0.01 if good else 1.0 + i * 0.01, 5), (1, i, "b", 0.1 if good else 0.9 + i * 0.01, 5)]
    rows += [(1, 9, "c", 1e12, 5), (1, 8, "c", None, 5), (1, 7, "c", float("nan"), 5), (1, 0, "a", -1e9, 1), (1, 99, "zzz", 5.0, 5), (None, 1, "a", 5.0, 5)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "query_id long, table_ids long, scorer string, scores double, loaded_at long, g string")
    better = spark.createDataFrame([("a", "high"), ("b", "low"), ("c", "high")], "scorer string, better string")
    fused = fusion.fuse_scores(df, better)
    assert {r["table_ids"] for r in fusion.top_ranked(fused, 3).collect()} == {0, 1, 2}
    got = {r["table_ids"]: r for r in fused.collect()}
    assert 99 not in got and got[8]["n_scores"] == 2 and all(0 <= r["fused"] <= 1 for r in got.values())
    assert fusion.fuse_scores(df.limit(0), better).count() == 0


def test_fusion_brute_force_and_weights(spark):
    rng = np.random.default_rng(0)
    x = {(i, s): float(rng.lognormal(0, 3)) for i in range(7) for s in "ab"}
    df = spark.createDataFrame([(1, i, s, v, 0) for (i, s), v in x.items()], "query_id long, table_ids long, scorer string, scores double, loaded_at long")
    better = spark.createDataFrame([("a", "high"), ("b", "low")], "scorer string, better string")
    want = {}
    for s, sign, w in (("a", 1, 3.0), ("b", -1, 1.0)):
        v = np.array([sign * x[i, s] for i in range(7)])
        z = (v - np.median(v)) / (1.4826 * np.median(abs(v - np.median(v))))
        for i in range(7):
            want[i] = want.get(i, 0) + w / 4 * -math.log1p(math.exp(-z[i]))
    for r in fusion.fuse_scores(df, better, weights={"a": 3.0}).collect():
        assert r["fused"] == pytest.approx(math.exp(want[r["table_ids"]]))


def test_residuals_against_brute_force(spark):
    docs = {1: ["x", "x", "Y", ""], 2: ["y", "z", "z"], 3: ["x", "z"], 4: None, 5: [], 6: ["only"]}
    rows = [(i, w, "text x y" if i != 6 else None, 0) for i, w in docs.items()] + [(1, docs[1], "text x y", 9)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "item_id long, lexical_vectors array<string>, documents string, loaded_at long, term string")
    counts = {1: {"x": 2, "y": 1}, 2: {"y": 1, "z": 2}, 3: {"x": 1, "z": 1}, 4: {"text": 1}, 6: {"only": 1}}
    total = sum(sum(c.values()) for c in counts.values())
    want = {}
    for i, c in counts.items():
        for t, n in c.items():
            col = [d.get(t, 0) for d in counts.values()]
            if sum(v > 0 for v in col) > 1:
                r, k = sum(c.values()) / total, sum(col) / total
                want[i, t] = (n - total * r * k) / math.sqrt(total * r * k * (1 - r) * (1 - k))
    for hot in (0, 1, 100):
        got = {(r["item_id"], r["term"]): r["residual"] for r in distinctive.term_residuals(df, hot_terms=hot).collect()}
        assert got == pytest.approx(want)
    best = {r["item_id"]: r["term"] for r in distinctive.most_distinctive(df).collect()}
    assert best == {1: "x", 2: "z", 3: "x"} or best[1] == "x"
    assert distinctive.most_distinctive(df.limit(0)).count() == 0


def clustered(n, seed=0, dim=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 5, dim))
    return np.repeat(centres, 5, axis=0) + rng.normal(size=(n // 5 * 5, dim)) * 0.3


def exact(x, k=3):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i], kind="stable")[:k]}


def frame(spark, x, extra=()):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame([(*r, 1) for r in rows], "item_id long, semantic_vectors array<float>, cell int")


def test_neighbor_recall_and_exact_cosines(spark):
    x = clustered(1000)
    odd = [(5000, None), (5001, []), (5002, [1.0] * 63), (5003, [0.0] * 64), (5004, [float("nan")] * 64), (5005, [float("inf")] * 64)]
    got = neighbors.nearest(frame(spark, x, odd + [(0, [float(v) for v in x[0]])])).collect()
    pairs = {(r["id"], r["neighbor"]) for r in got}
    want = exact(x)
    assert len(pairs & want) / len(want) >= 0.9 and all(a < 5000 and b < 5000 and a != b for a, b in pairs)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert all(abs(r["cosine"] - u[r["id"]] @ u[r["neighbor"]]) < 1e-5 for r in got)
    assert len(got) == len({(r["id"], r["position"]) for r in got})


def test_crowded_cells_are_split_without_loss(spark):
    x = clustered(600, 1)
    whole = {(r["id"], r["neighbor"]) for r in neighbors.nearest(frame(spark, x)).collect()}
    split = {(r["id"], r["neighbor"]) for r in neighbors.nearest(frame(spark, x), hot_cell=10).collect()}
    assert whole == split


def test_exact_search_equals_brute_force(spark):
    x = clustered(200, 4)
    got = {(r["id"], r["neighbor"]) for r in neighbors.nearest(frame(spark, x, [(900, [float(v) for v in x[3]])]), exact=True).collect()}
    assert {p for p in got if 900 not in p} >= {p for p in exact(x) if 3 not in p and p[1] not in (3,)} - {p for p in exact(x) if any((p[0], q) in got for q in (900,))}
    assert (3, 900) in got and (900, 3) in got


def test_more_tables_where_neighbours_meet_less():
    tables = [neighbors.plan_tables(once) for once in (0.9, 0.6, 0.4, 0.2)]
    assert tables == sorted(tables) and tables[0] == neighbors.TABLES and tables[-1] >= 17
    assert neighbors.plan_tables(0.5, 0.999) > neighbors.plan_tables(0.5, 0.9)
    with pytest.raises(ValueError):
        neighbors.plan_tables(0.5, 1.0)
    with pytest.warns(UserWarning):
        neighbors.plan_tables(0.001)


def test_copies_find_each_other(spark):
    x = clustered(100, 2)
    copies = [(1000 + i, [float(v) for v in x[0]]) for i in range(6)]
    got = {}
    for r in neighbors.nearest(frame(spark, x, copies)).collect():
        got.setdefault(r["id"], set()).add(r["neighbor"])
    assert got[0] == {1000, 1001, 1002} and got[1005] == {0, 1000, 1001}
    assert neighbors.nearest(frame(spark, x[:0])).count() == 0
    assert neighbors.nearest(frame(spark, x[:1])).count() == 0


def test_pfair_windows():
    weights = whole_weights({"a": 0.5, "b": 0.3, "c": 0.2})
    slots = pfair_slots(weights)
    assert sorted(s for v in slots.values() for s in v) == list(range(PERIOD))
    for source, n in weights.items():
        for j, t in enumerate(slots[source]):
            assert j * PERIOD // n <= t < -(-(j + 1) * PERIOD // n)
    with pytest.raises(ValueError):
        whole_weights({str(i): 1.0 for i in range(PERIOD + 1)})
    assert sum(whole_weights({"a": 1e-9, "b": 1.0}).values()) == PERIOD and whole_weights({"a": 0.0})["a"] == 0


@pytest.mark.parametrize("keep", [True, False])
def test_mix(spark, keep):
    sized = spark.range(3000).select(
        "id", F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "mid").otherwise("small").alias("source"), (F.col("id") % 50).alias("tokens")
    )
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.3, 2), ("small", 0.3, 1), ("none", 0.0, 1)], "source string, target_share double, max_uses int")
    plan = {r["source"]: r["reachable"] for r in source_plan(sized, targets).collect()}
    assert plan == {"big": True, "mid": True, "small": False, "none": True}
    mixed = mix(sized, targets, block_tokens=500, keep_shares=keep)
    report = {r["source"]: r for r in mix_report(sized, targets, mixed).collect()}
    assert report["big"]["most_uses"] == 1 and report["mid"]["most_uses"] <= 2 and report["small"]["most_uses"] == 1
    rows = mixed.orderBy("slot", "start").collect()
    assert all(r["tokens"] > 0 for r in rows) and len({(r["id"], r["use"]) for r in rows}) == len(rows)
    if keep:
        assert all(abs(report[s]["reached_share"] - w) < 0.01 for s, w in (("big", 0.4), ("mid", 0.3), ("small", 0.3)))
        total, part = 0, 0
        for r in rows[: len(rows) * 9 // 10]:
            total += r["tokens"]
            part += r["tokens"] if r["source"] == "big" else 0
            assert abs(part - 0.4 * total) <= 500 * 1.5
    assert mix(sized.limit(0), targets).count() == 0
