from semspan.llm import mixing, queries


def test_short_sources_come_from_the_mix(spark, monkeypatch):
    sized = spark.createDataFrame([(i, "abc"[i % 3], 10 + i) for i in range(90)], "id long, source string, tokens long")
    targets = spark.createDataFrame(
        [("a", 0.8, 2), ("b", 0.1, 1), ("c", 0.05, 1), ("none", 0.05, 3), ("zero", 0.0, 1)], "source string, target_share double, max_uses int"
    )
    simulated, slots = [], mixing.pfair_slots
    monkeypatch.setattr(mixing, "pfair_slots", lambda weights, *more: simulated.append(weights) or slots(weights, *more))
    monkeypatch.setattr(queries, "_mix_inputs", lambda spark, sf: (sized, targets))
    found = {r["source"] for r in queries.p7_found(spark, "").collect()}
    assert len(simulated) == 1
    assert found == {r["source"] for r in mixing.source_plan(sized, targets).filter("not reachable").collect()} == {"a", "none"}
