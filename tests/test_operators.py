import statistics

import pytest
from pyspark.sql import functions as F

from tests.backends import FailsOnThirteen as _Flaky
from tests.backends import SecondTry as _Second
from semspan.backends import CachedBackend, FailingBackend, Reply, RuleBackend, Sampling, ScriptedBackend, parse_code, parse_tags, price_of
from semspan.operators import core
from semspan.operators.core import (
    EMPTY_REDUCTION,
    Ledger,
    decode_block_replies,
    join_pairs,
    sem_filter,
    sem_join,
    sem_map,
    sem_mask,
    sem_rank,
    sem_reduce,
)

RULES = RuleBackend()
COURSES = [(0, "History of Rome"), (1, "Linear Algebra"), (2, "Cooking"), (3, "Algebra II")]


@pytest.fixture
def courses(spark):
    return spark.createDataFrame(COURSES, "row_id long, course string")


@pytest.fixture
def symptoms(spark):
    return spark.createDataFrame([(1, "fever"), (2, "cough"), (3, "rash")], "row_id long, symptom string")


@pytest.fixture
def drugs(spark):
    return spark.createDataFrame([(1, "treats fever"), (4, "for sleep"), (7, "soothes a rash")], "row_id long, medical_use string")


def values(df, *columns):
    # Sorted here: a sort in Spark samples its input first, which would ask the model twice.
    rows = sorted(df.select("row_id", *[F.col(c).alias(f"_{c}") for c in columns]).collect(), key=lambda r: r["row_id"])
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in rows]


def test_mask_and_cost(courses):
    ledger = Ledger()
    mask = sem_mask(courses, 'The course contains "algebra".', ["course"], backend=RULES, ledger=ledger)
    assert values(mask, "keep") == [False, True, False, True]
    assert ledger.settle().cost == pytest.approx(0.04)


def test_filter_null_is_false_and_free(spark):
    df = spark.createDataFrame([(0, "algebra"), (1, None)], "row_id long, course string")
    ledger = Ledger()
    assert values(sem_filter(df, 'It contains "algebra".', ["course"], backend=RULES, ledger=ledger), "row_id") == [0]
    assert ledger.settle().calls == 1


def test_filter_empty(courses):
    assert sem_filter(courses.filter("row_id < 0"), "x", ["course"], backend=RULES).count() == 0


def test_filter_function_gets_a_scalar_and_is_free(courses):
    ledger = Ledger()
    kept = sem_filter(courses, "x", ["course"], func=lambda c: c.startswith("L"), backend=RULES, ledger=ledger)
    assert values(kept, "row_id") == [1]
    assert ledger.settle().cost == 0


def test_filter_function_falls_back_to_the_model(courses):
    def broken(course):
        raise RuntimeError

    ledger = Ledger()
    kept = sem_filter(courses, 'It contains "algebra".', ["course"], func=broken, backend=RULES, ledger=ledger)
    assert values(kept, "row_id") == [1, 3]
    assert ledger.settle().calls == 4


def test_unreadable_answer_is_false(courses):
    assert sem_filter(courses, "x", ["course"], backend=ScriptedBackend(default="no tags")).count() == 0


def test_failed_calls_are_false_and_counted(courses):
    ledger = Ledger()
    backend = FailingBackend(sampling=Sampling(attempts=2, backoff_seconds=0))
    assert sem_filter(courses, "x", ["course"], backend=backend, ledger=ledger).count() == 0
    spend = ledger.settle()
    assert (spend.errors, spend.calls) == (4, 8)


@pytest.mark.parametrize("strategy", ["plain", "self-refine", "self_refine"])
def test_map_strategies(courses, strategy):
    mapped = sem_map(courses, "Give it in upper case", ["course"], ["loud"], strategy=strategy, backend=RULES)
    assert values(mapped, "loud") == [c.upper() for _, c in COURSES]


def test_self_refine_costs_three_calls_when_refined(courses):
    script = (("TASK: Check", "<output>too short</output>"), ("TASK: Improve", "<loud>better</loud>"))
    backend = ScriptedBackend(script=script, default="<loud>draft</loud>")
    ledger = Ledger()
    mapped = sem_map(courses, "x", ["course"], ["loud"], strategy="self_refine", backend=backend, ledger=ledger)
    assert set(values(mapped, "loud")) == {"better"}
    assert ledger.settle().calls == 12


def test_fewshot_needs_demonstrations(courses):
    with pytest.raises(ValueError):
        sem_map(courses, "x", ["course"], ["y"], strategy="fewshot", backend=RULES)
    with pytest.raises(ValueError):
        sem_map(courses, "x", ["course"], ["y"], strategy="vote", backend=RULES)
    with pytest.raises(ValueError):
        sem_map(courses, None, ["course"], ["y"], backend=RULES)


def test_map_nulls_missing_tags_and_several_outputs(spark):
    df = spark.createDataFrame([(0, "a", "b"), (1, None, "b")], "row_id long, title string, plot string")
    backend = ScriptedBackend(default="<genre>drama</genre>")
    ledger = Ledger()
    mapped = sem_map(df, "x", ["title", "plot"], ["genre", "mood"], backend=backend, ledger=ledger)
    assert values(mapped, "genre", "mood") == [("drama", None), (None, None)]
    assert ledger.settle().calls == 1


def test_map_function_row_by_name(spark):
    df = spark.createDataFrame([(0, "a", 2), (1, "b", None)], "row_id long, title string, n int")
    mapped = sem_map(df, None, ["title", "n"], ["both"], func=lambda row: f"{row['title']}{int(row['n'])}")
    assert values(mapped, "both") == ["a2", None]


def test_map_assertions(courses):
    mapped = sem_map(courses, "Give it in upper case", ["course"], ["loud"], backend=RULES, assertions=[lambda v: "A" in v])
    assert values(mapped, "loud") == [None, "LINEAR ALGEBRA", None, "ALGEBRA II"]


def test_nest_join_with_cache(spark, symptoms, drugs):
    cache = spark.createDataFrame([(1, 1, "True"), (3, 7, "True")], "l_id long, r_id long, answer string")
    ledger = Ledger()
    pairs = join_pairs(
        symptoms, drugs, "x", "symptom", "medical_use", "row_id", "row_id", cache=cache,
        backend=ScriptedBackend(default="<output>False</output>"), ledger=ledger,
    )
    assert sorted(map(tuple, pairs.collect())) == [(1, 1), (3, 7)]
    assert ledger.settle().cost == pytest.approx(0.07)


def test_block_join_with_cache(spark, symptoms, drugs):
    cache = spark.createDataFrame([(0, 0, "L0-R0"), (1, 1, "L0-R0")], "l_block long, r_block long, answer string")
    ledger = Ledger()
    pairs = join_pairs(
        symptoms, drugs, "x", "symptom", "medical_use", "row_id", "row_id", strategy="block", batch_size=2, cache=cache,
        backend=ScriptedBackend(default="<output></output>"), ledger=ledger,
    )
    assert sorted(map(tuple, pairs.collect())) == [(1, 1), (3, 7)]
    assert ledger.settle().cost == pytest.approx(0.02)


def test_block_replies_drop_what_is_malformed(spark):
    item = "array<struct<no:long,id:long,v:string>>"
    rows = [
        ([(0, 10, "a"), (1, 11, "b")], [(0, 20, "c"), (1, 21, "d")], "L0-R0, L1 - R1"),
        ([(0, 10, "a")], [(0, 22, "e")], "nothing, L9-R0, L-R0"),
        ([(0, 13, "z")], [(0, 22, "e")], ""),
        ([(0, 13, "z")], [(0, 22, "e")], "L0-R0"),
    ]
    df = spark.createDataFrame(rows, f"ls {item}, rs {item}, reply string")
    assert sorted(map(tuple, decode_block_replies(df).collect())) == [(10, 20), (11, 21), (13, 22)]


@pytest.mark.parametrize(("how", "expected"), [("inner", 2), ("left", 3), ("right", 3)])
@pytest.mark.parametrize("strategy", ["nest", "block"])
def test_join_types(symptoms, drugs, how, expected, strategy):
    joined = sem_join(
        symptoms, drugs, "The drug mentions the symptom", "symptom", "medical_use", "row_id", "row_id", how,
        strategy=strategy, batch_size=2, backend=RULES,
    )
    assert joined.columns == ["row_id", "symptom", "row_id_right", "medical_use"]
    rows = joined.collect()
    assert len(rows) == expected
    if how == "left":
        assert [r["medical_use"] for r in rows if r["symptom"] == "cough"] == [None]
    if how == "right":
        assert [r["symptom"] for r in rows if r["medical_use"] == "for sleep"] == [None]


def test_join_keeps_all_matches_and_ignores_nulls(spark, drugs):
    left = spark.createDataFrame([(1, "e"), (2, None)], "row_id long, symptom string")
    ledger = Ledger()
    pairs = join_pairs(left, drugs, "The drug contains it", "symptom", "medical_use", "row_id", "row_id", backend=RULES, ledger=ledger)
    assert sorted(map(tuple, pairs.collect())) == [(1, 1), (1, 4), (1, 7)]
    assert ledger.settle().calls == 3


def test_join_function_takes_scalars_and_native_joins_hash(spark, symptoms, drugs):
    pairs = join_pairs(symptoms, drugs, None, "symptom", "medical_use", "row_id", "row_id", func=lambda l, r: l in r)
    assert sorted(map(tuple, pairs.collect())) == [(1, 1), (3, 7)]
    equal = join_pairs(symptoms, symptoms, None, "symptom", "symptom", "row_id", "row_id", expr="l = r")
    plan = equal._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError):
        join_pairs(symptoms, drugs, "x", "symptom", "medical_use", "row_id", "row_id", strategy="hash")
    with pytest.raises(ValueError):
        sem_join(symptoms, drugs, "x", "symptom", "medical_use", "row_id", "row_id", "outer")


def test_block_join_warns_about_a_function(symptoms, drugs):
    with pytest.warns(UserWarning):
        join_pairs(
            symptoms, drugs, "The drug mentions it", "symptom", "medical_use", "row_id", "row_id",
            strategy="block", func=lambda l, r: True, backend=RULES,
        )


def ranking_cache(order):
    place = {r: i for i, r in enumerate(order)}
    return {(a, b): "1" if place[a] < place[b] else "2" for a in order for b in order if a != b}


@pytest.mark.parametrize(("descend", "expected"), [(True, [3, 1, 2, 4]), (False, [2, 4, 3, 1])])
def test_rank_from_cache(courses, descend, expected):
    ledger = Ledger()
    ranked = sem_rank(courses, "x", "course", "row_id", descend, cache=ranking_cache([1, 2, 0, 3]), backend=FailingBackend(), ledger=ledger)
    assert values(ranked, "ranking") == expected
    assert ledger.spend.calls == 0


def test_rank_nulls_last_ties_and_empty(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["5", None, "9", "5", "1"])], "row_id long, v string")
    ranked = sem_rank(df, "The highest number first", "v", "row_id", backend=RULES)
    got = values(ranked, "ranking")
    assert got == [2, 5, 1, 3, 4]  # equal values by id
    assert sem_rank(df.filter("row_id > 9"), "x", "v", "row_id", backend=RULES).count() == 0


def test_rank_many_rows_equals_sort(spark):
    df = spark.range(60).select(F.col("id").alias("row_id"), ((F.col("id") * 37) % 211).cast("string").alias("v"))
    ranked = sem_rank(df, "The highest number first", "v", "row_id", backend=RULES)
    assert [r[0] for r in ranked.orderBy("ranking").select("v").collect()] == [
        str(v) for v in sorted(((i * 37) % 211 for i in range(60)), reverse=True)
    ]


def test_reduce(spark):
    df = spark.createDataFrame([(0, "a", 1.5), (1, "a", 4.0), (2, "b", None), (3, "b", 2.0)], "row_id long, g string, x double")
    assert sem_reduce(df, "What is the highest?", "x", backend=RULES).first()[0] == "4.0"
    grouped = sem_reduce(df, "How many?", "x", ["g"], backend=RULES)
    assert sorted(map(tuple, grouped.collect())) == [("a", "2"), ("b", "1")]
    assert sem_reduce(df.filter("x > 9"), "How many?", "x", backend=RULES).first()[0] == EMPTY_REDUCTION
    assert sem_reduce(df, None, "x", expr="sum(x)").first()[0] == "7.5"
    assert float(sem_reduce(df, None, "x", func=lambda v: v.max() - v.min()).first()[0]) == 2.5


def test_reduce_function_falls_back(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 3.0)], "row_id long, x double")

    def broken(v):
        raise RuntimeError

    assert sem_reduce(df, "What is the total?", "x", func=broken, backend=RULES).first()[0] == "4.0"


def test_rank_of_repeated_values(spark):
    df = spark.range(500).select(F.col("id").alias("row_id"), (F.col("id") % 7).cast("string").alias("v"), F.lit(1).alias("path"))
    ledger = Ledger()
    ranked = sem_rank(df, "The highest number first", "v", "row_id", backend=RULES, ledger=ledger)
    want = {i: n + 1 for n, i in enumerate(sorted(range(500), key=lambda i: (-(i % 7), i)))}
    assert {r["row_id"]: r["ranking"] for r in ranked.collect()} == want
    assert ledger.spend.calls <= 21  # seven different values, whatever the rows


def test_rank_says_when_it_cannot(spark):
    df = spark.range(40).select(F.col("id").alias("row_id"), F.col("id").cast("string").alias("v"))
    with pytest.raises(RuntimeError, match="not complete"):
        sem_rank(df, "The highest number first", "v", "row_id", backend=RULES, max_rounds=2)
    with pytest.raises(RuntimeError, match="comparisons failed"):
        sem_rank(df, "The highest number first", "v", "row_id", backend=FailingBackend(sampling=Sampling(attempts=1)))


def test_rank_takes_equal_for_an_answer(spark):
    df = spark.createDataFrame([(0, "5"), (1, "5.0"), (2, "7"), (3, "$5")], "row_id long, v string")
    ranked = sem_rank(df, "The highest number first", "v", "row_id", backend=RULES)
    assert values(ranked, "ranking") == [2, 3, 1, 4]


def test_rank_cache_as_a_frame_answers_both_ways(spark, courses):
    order = [1, 2, 0, 3]
    pairs = {(a, b) for n, a in enumerate(order) for b in order[n + 1 :]}
    cache = spark.createDataFrame([(a, b, "1") for a, b in pairs], "id long, pivot long, answer string")
    assert values(sem_rank(courses, "x", "course", "row_id", cache=cache, backend=FailingBackend()), "ranking") == [3, 1, 2, 4]


@pytest.mark.parametrize(
    ("instruction", "want"),
    [("How many are there?", 1200), ("What is the average?", 49.25), ("What is the total?", 59100), ("The lowest?", 0), ("The most frequent?", 7)],
)
def test_reduce_beyond_one_prompt(spark, instruction, want):
    numbers = [7 if i < 50 else i % 101 for i in range(1200)]
    want = sum(numbers) / 1200 if "average" in instruction else sum(numbers) if "total" in instruction else want
    df = spark.createDataFrame([(i, n, i % 2) for i, n in enumerate(numbers)] + [(9999, None, 1)], "row_id long, x int, g int")
    for size in (20, 500, 5000):
        got = sem_reduce(df, instruction, "x", values_per_prompt=size, backend=RULES).first()[0]
        assert float(got) == pytest.approx(want), size
    grouped = {r["g"]: float(r["reduce_result"]) for r in sem_reduce(df, instruction, "x", ["g"], values_per_prompt=100, backend=RULES).collect()}
    whole = {g: float(sem_reduce(df.filter(f"g = {g}"), instruction, "x", values_per_prompt=5000, backend=RULES).first()[0]) for g in (0, 1)}
    assert grouped == pytest.approx(whole)


def test_reduce_of_free_text_needs_a_way_to_combine(spark):
    df = spark.range(30).select(F.col("id").alias("row_id"), F.format_string("v%02d", "id").alias("t"))
    with pytest.raises(ValueError, match="combine"):
        sem_reduce(df, "Summarise them", "t", values_per_prompt=10, backend=RULES)
    joined = sem_reduce(df, "Summarise them", "t", values_per_prompt=10, combine="Put them together", backend=RULES).first()[0]
    assert joined.replace("; ", " ").split() == [f"v{i:02d}" for i in range(30)]
    longest = sem_reduce(df, "Summarise them", "t", values_per_prompt=4, combine=lambda parts: max(parts), backend=RULES).first()[0]
    assert longest.endswith("v29")


def test_reduce_with_a_failed_part_has_no_result(spark):
    df = spark.range(40).select(F.col("id").alias("row_id"), (F.col("id") % 2).alias("g"), F.col("id").cast("string").alias("x"))
    ledger = Ledger()
    backend = _Flaky(sampling=Sampling(attempts=1))
    got = sem_reduce(df, "How many?", "x", ["g"], values_per_prompt=5, backend=backend, ledger=ledger)
    assert sorted(map(tuple, got.collect())) == [(0, "20"), (1, None)]
    assert ledger.settle().errors == 1


def test_reduce_function_is_not_paid_for_where_it_works(spark):
    df = spark.createDataFrame([(i, i % 3, float(i)) for i in range(60)], "row_id long, g long, x double")
    ledger = Ledger()

    def picky(v):
        if v.min() == 1:
            raise ValueError
        return v.max()

    got = sem_reduce(df, "What is the highest?", "x", ["g"], func=picky, backend=RULES, ledger=ledger)
    assert sorted((r[0], float(r[1])) for r in got.collect()) == [(0, 57.0), (1, 58.0), (2, 59.0)]
    assert ledger.settle().calls == 1
    sem_reduce(df, "What is the highest?", "x", func=lambda v: v.max(), backend=RULES, ledger=ledger).collect()
    assert ledger.settle().calls == 1
    assert sem_reduce(df, None, "x", func=sum).first()[0] == "1770.0"
    spread = sem_reduce(df, None, "x", func=lambda v: (v.min(), v.max()), combine=lambda p: max(b for _, b in p) - min(a for a, _ in p))
    assert float(spread.first()[0]) == 59.0


def test_reduce_function_gets_all_values_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(core, "FUNCTION_VALUES", 1_000)
    df = spark.range(30_000).select(
        F.expr("if(id < 25000, timestamp_seconds(0), if(id < 29990, timestamp_seconds(1), null))").alias("g"),
        F.expr("if(id % 10 = 3, null, cast(id as double))").alias("x"),
    )

    def whole(v):  # needs all values at once, and changes what it got
        v.sort_values(inplace=True, ignore_index=True)
        return f"{len(v)} {v.median()} {v[0]} {v[len(v) - 1]}"

    assert sem_reduce(df, None, "x", func=lambda v: v.max() - v.min()).first()[0] == "29999.0"
    expected = {}
    for key, start, end in ((0, 0, 25_000), (1, 25_000, 29_990), (None, 29_990, 30_000)):
        kept = [float(i) for i in range(start, end) if i % 10 != 3]
        expected[key] = f"{len(kept)} {statistics.median(kept)} {kept[0]} {kept[-1]}"
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            got = sem_reduce(df, None, "x", ["g"], func=whole)
            assert {r[0]: r[1] for r in got.select(F.unix_seconds("g"), "reduce_result").collect()} == expected
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")

    def picky(v):
        if v.min() == 0:
            raise ValueError
        return v.max()

    got = sem_reduce(df, "What is the highest?", "x", ["g"], func=picky, backend=RULES)
    assert {r[0]: float(r[1]) for r in got.select(F.unix_seconds("g"), "reduce_result").collect()} == {0: 24_999, 1: 29_989, None: 29_999}
    assert sem_reduce(df.filter("x < 0"), None, "x", func=whole).first()[0] == EMPTY_REDUCTION
    without = df.withColumn("x", F.expr("if(g is null, null, x)"))
    assert sem_reduce(without, None, "x", ["g"], func=whole).filter("g is null").first()["reduce_result"] == EMPTY_REDUCTION


def test_rate_limit_is_shared_by_all_tasks(courses):
    from semspan.operators.core import limited

    df, backend = limited(courses.repartition(8), RULES, 2)
    assert df.rdd.getNumPartitions() * backend.max_in_flight <= 2
    with pytest.raises(ValueError):
        limited(courses, RULES, 0)
    assert values(sem_map(courses, "in upper case", ["course"], ["loud"], backend=RULES, rate_limit=2), "loud")[2] == "COOKING"


def test_join_pairs_different_values_once_and_refuses_too_many(spark):
    left = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "row_id long, x string")
    right = spark.createDataFrame([(i, "ac"[i % 2]) for i in range(10)], "row_id long, y string")
    ledger = Ledger()
    pairs = join_pairs(left, right, "They are equal", "x", "y", "row_id", "row_id", backend=RULES, ledger=ledger)
    assert pairs.count() == 50 and ledger.settle().calls == 4
    with pytest.raises(ValueError, match="4 pairs"):
        join_pairs(left, right, "They are equal", "x", "y", "row_id", "row_id", backend=RULES, max_pairs=3)
    some = join_pairs(left, right, "They are equal", "x", "y", "row_id", "row_id", backend=RULES, ledger=ledger, only_where="l = r", max_pairs=3)
    assert some.count() == 50 and ledger.settle().calls == 5


def test_retries_count_as_calls():
    assert _Second(sampling=Sampling(attempts=2, backoff_seconds=0)).complete([_prompt()])[0].calls == 2


def test_filter_assertions_and_fewshot(courses):
    shown = [{"data": {"course": "algebra"}, "answer": "maths"}, {"data": {"course": "x"}, "answer": "other"}]
    mapped = sem_map(courses, "Say what it is about", ["course"], ["topic"], strategy="fewshot", context=shown, backend=RULES)
    assert values(mapped, "topic") == ["other", "maths", "other", "maths"]
    kept = sem_filter(courses, 'It contains "algebra".', ["course"], backend=RULES, assertions=[lambda v: v == "False"])
    assert kept.count() == 0


def test_media_are_parts_of_their_own():
    from semspan.backends import Prompt
    from semspan.backends.http import media_parts

    prompt = Prompt("map", "What is it?", (("pic", "image", "data:image/png;base64,AAAA"), ("voice", "audio", "data:audio/wav;base64,BBBB"),
                                            ("doc", "file", "data:application/pdf;base64,CCCC"), ("name", "image", "cover.png")))
    text = prompt.text()
    assert "AAAA" not in text and "BBBB" not in text and "cover.png" in text
    parts = [p for p in media_parts(prompt) if p["type"] != "text"]
    assert [p["type"] for p in parts] == ["image_url", "input_audio", "file"]
    assert parts[1]["input_audio"] == {"data": "BBBB", "format": "wav"} and parts[2]["file"]["file_data"].endswith("CCCC")


def test_reduce_in_batches(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("x"))
    ledger = Ledger()
    reduced = sem_reduce(df, "What is the highest?", "x", order_by="row_id", values_per_prompt=100, backend=RULES, ledger=ledger)
    assert reduced.first()[0] == "999.0"
    assert ledger.settle().calls > 10


def test_cache_pays_once(tmp_path, courses):
    backend = CachedBackend(inner=RULES, folder=str(tmp_path))
    costs = []
    for _ in range(2):
        ledger = Ledger()
        sem_filter(courses, 'It contains "algebra".', ["course"], backend=backend, ledger=ledger).count()
        costs.append(ledger.settle().cost)
    assert costs == [pytest.approx(0.04), 0.0]
    twice = CachedBackend(inner=RULES).complete([p := _prompt(), p])
    assert [r.calls for r in twice] == [1, 0]


def _prompt():
    from semspan.backends import Prompt

    return Prompt("filter", "never asked before", (("a", "str", "b"),))


def test_parsing_and_prices():
    assert parse_tags("x <a> 1\n</a> <b></b>", ["a", "b", "c"]) == {"a": "1", "b": "", "c": None}
    assert parse_code("```python\nx = 1\n```") == "x = 1"
    assert price_of("gpt-4o", 1000, 1000, 500) == pytest.approx((500 * 0.0025 + 500 * 0.00125 + 1000 * 0.01) / 1000)
    assert price_of("gpt-4o", 1000, 0) == price_of("gpt-4o-2024-08-06", 1000, 0)
    assert price_of("qwen-max-latest", 1000, 0, 1000) == pytest.approx(0.00033)
    with pytest.raises(KeyError):
        price_of("unknown", 10, 10)
    with pytest.raises(KeyError):
        price_of("gpt-4o-nano", 10, 10)
    assert Reply(None).status == "ok"
    with pytest.raises(ValueError):
        Sampling(temperature=2)
    from semspan.backends.http import HttpBackend

    with pytest.raises(ValueError):
        HttpBackend(model="mystery-1")


def test_clashing_names_and_extra_columns(spark):
    df = spark.createDataFrame([(0, "algebra", 1, 2)], "row_id long, course string, __keep int, __filter int")
    kept = sem_filter(df, 'It contains "algebra".', ["course"], backend=RULES)
    assert kept.columns == df.columns and kept.count() == 1
