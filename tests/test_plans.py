import pytest

from semspan.backends import RuleBackend, ScriptedBackend, grammar
from semspan.frame import SemFrame
from semspan.plans.nodes import Filter, Map
from semspan.plans.physical import OptimizeConfig, assign_models, choose_model, sample_rows
from semspan.plans.rules import safe_expression

RULES = RuleBackend()


@pytest.fixture
def movies(spark):
    rows = [(i, f"A {'drama' if i % 3 else 'comedy'} about {i}", f"Director {'Ro' if i % 2 else 'Mi'}", f"{i % 10}.5/10") for i in range(30)]
    return SemFrame.of(spark.createDataFrame(rows, "row_id long, plot string, director string, rating string"), "movies")


def steps(frame):
    found, node = [], frame.plan
    while node.children:
        found.append((type(node).__name__, node.cost_class))
        node = node.children[0]
    return found


def example(movies):
    return (
        movies.semantic_map("Classify the plot as comedy, drama or other", "plot", "genre")
        .semantic_filter("The rating is higher than 3", "rating")
        .semantic_filter('The director contains "ro".', "director")
        .semantic_filter('The genre is "drama".', "genre")
    )


def test_rewrites_keep_the_result_and_save_calls(movies):
    plain = example(movies)
    pushed = plain.optimized(OptimizeConfig(replacement=False))
    native = plain.optimized()
    rows, spend = plain.execute(RULES)
    rows_pushed, spend_pushed = pushed.execute(RULES)
    rows_native, spend_native = native.execute(RULES)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, rows_pushed.collect())) == sorted(map(tuple, rows_native.collect())) and rows.count()
    assert spend_native.calls == 0 < spend_pushed.calls < spend.calls
    assert [s for s, _ in steps(pushed)][:2] == ["Filter", "Map"]  # the genre's filter stays above its map


def test_cheap_filters_run_first(movies):
    frame = movies.semantic_filter('The plot mentions "drama".', "plot").semantic_filter(None, "director", func="director like '%Ro%'")
    assert steps(frame.optimized(OptimizeConfig(replacement=False))) == [("Filter", 2), ("Filter", 0)]
    _, spend = frame.optimized(OptimizeConfig(replacement=False)).execute(RULES)
    assert spend.calls == 15


def test_native_predicates_reach_the_scan(spark, movies, tmp_path):
    path = str(tmp_path / "m")
    movies.plan.frame.write.parquet(path)
    frame = SemFrame.of(spark.read.parquet(path)).semantic_map("Give it in upper case", "plot", "loud")
    frame = frame.semantic_filter(None, "director", func="director = 'Director Ro'").optimized(OptimizeConfig(replacement=False))
    plan = frame.to_spark(RULES)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(dire" in plan


@pytest.mark.parametrize(("how", "sides"), [("inner", (True, True)), ("left", (True, False)), ("right", (False, True))])
def test_filters_enter_only_the_preserved_side(spark, movies, how, sides):
    other = SemFrame.of(spark.createDataFrame([(1, "Ro", "x")], "rid long, name string, note string"))
    joined = movies.semantic_join(other, "The name contains it", "director", "name", "row_id", "rid", how)
    for column, expected in zip(("plot", "note"), sides):
        node = joined.semantic_filter(None, column, func=f"{column} is not null").optimized().plan
        assert (not isinstance(node, Filter)) is expected


def test_reduce_and_rank_are_barriers(movies):
    ranked = movies.semantic_rank("The highest number first", "rating", "row_id").semantic_filter(None, "plot", func="plot like '%drama%'")
    assert [s for s, _ in steps(ranked.optimized())] == ["Filter", "Rank"]
    reduced = movies.semantic_reduce("How many?", "plot").semantic_map(None, "reduce_result", "n", func="reduce_result")
    assert [s for s, _ in steps(reduced.optimized())] == ["Map", "Reduce"]


def test_fusion_is_off_by_default(movies):
    frame = movies.semantic_filter("about war", "plot").semantic_filter("about love", "plot")
    assert len(steps(frame.optimized())) == 2
    assert len(steps(frame.optimized(OptimizeConfig(fusion=True)))) == 1


def test_fused_questions_answer_the_same_with_fewer_calls(movies):
    frame = (
        movies.semantic_filter('The plot mentions "about 1".', "plot")
        .semantic_map("Classify the plot as comedy, drama or other", "plot", "genre")
        .semantic_map("Give the first word", "plot", "start")
    )
    plain = frame.optimized(OptimizeConfig(replacement=False))
    fused = frame.optimized(OptimizeConfig(replacement=False, fusion=True))
    rows, spend = plain.execute(RULES)
    rows_fused, spend_fused = fused.execute(RULES)
    assert rows.columns == rows_fused.columns
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, rows_fused.collect())) and rows.count()
    assert spend_fused.calls == 30 < spend.calls == 30 + 2 * rows.count()


def test_a_model_writes_expressions_that_are_checked(movies):
    script = (("many words", "```sql\nlength(plot) > 16\n```"), ("evil", "```sql\nreflect('java.lang.System', 'exit', 0)\n```"),
              ("other column", "```sql\nlength(rating) > 1\n```"), ("not a condition", "```sql\nupper(plot)\n```"))
    writer = ScriptedBackend(script=script, default="<output>True</output>")
    config = OptimizeConfig(rewrite=True)
    frame = movies.semantic_filter("It has many words", "plot").optimized(config, writer)
    assert frame.plan.expr == "length(plot) > 16" and frame.planning.calls == 1
    rows, spend = frame.execute(writer)
    assert spend.calls == 1 and {len(r["plot"]) > 16 for r in rows.collect()} == {True}
    for words in ("evil", "other column", "not a condition", "nothing known"):
        kept = movies.semantic_filter(f"It is {words}", "plot").optimized(config, writer)
        assert kept.plan.expr is None
    assert movies.semantic_filter("It is evil", "plot").optimized(config, writer).execute(writer)[1].calls == 31


def test_the_sample_is_paid_once_and_not_asked_again(movies):
    frame = movies.semantic_map("Classify the plot as comedy, drama or other", "plot", "genre")
    config = OptimizeConfig(replacement=False, choose_models=True, sample_size=5, models=("weak", "strong"))
    planned = frame.optimized(config, RULES)
    assert planned.plan.model == "weak" and planned.planning.calls == 10
    rows, spend = planned.execute(RULES)
    assert spend.calls == 10 + 30 - 5
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, frame.execute(RULES)[0].collect()))


def test_joins_get_the_weakest_model_and_children_are_computed_once(movies):
    config = OptimizeConfig(replacement=False, choose_models=True, sample_size=2, models=("weak", "strong"))
    two = movies.semantic_map("Give the first word", "plot", "w").semantic_filter('It contains "A".', "w").optimized(config, RULES)
    assert two.plan.children[0].label().startswith("Scan computed")
    joined = movies.semantic_join(movies, "They are equal", "director", "director", "row_id", "row_id").optimized(config, RULES)
    assert joined.plan.model == "weak"


def test_explain(movies):
    text = example(movies).explain()
    assert text.splitlines()[-1].strip().startswith("Scan movies") and "Map (model)" in text


@pytest.mark.parametrize(
    ("instruction", "values"),
    [
        ("higher than 5", ["6", "5", "$7.50", "x", "1,200"]),
        ("at most 3.5", ["3.5", "4", "none"]),
        ('contains "Ro"', ["bro", "RO", "x"]),
        ('does not contain "ro"', ["bro", "x"]),
        ("directed by Nolan", ["Christopher Nolan", "x"]),
        ('starts with "A"', ["abc", "b"]),
        ('is "x"', [" X ", "xx"]),
    ],
)
def test_grammar_means_the_same_in_python_and_sql(spark, instruction, values):
    rule = grammar.predicate(instruction)
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.selectExpr(rule.sql("v")).collect()] == [rule.test(v) for v in values]


@pytest.mark.parametrize("instruction", ["Classify it as ab, cd or other", "in upper case", "first word", "Extract the number", "How long is it"])
def test_mappings_mean_the_same(spark, instruction):
    values = ["abc 12.25", "x CD", "  7", "none"]
    rule = grammar.mapping(instruction)
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.selectExpr(rule.sql("v")).collect()] == [rule.value(v) for v in values]


def test_safe_expressions(movies):
    df = movies.plan.frame
    assert safe_expression(df, "upper(plot)")
    assert not safe_expression(df, "reflect('java.lang.System', 'exit', 0)")
    assert not safe_expression(df, "upper(nothing)") and not safe_expression(df, "upper(plot); drop")
    assert not safe_expression(df, "(select max(plot) from x)") and not safe_expression(df, "max(plot)") and not safe_expression(df, "1 / 0")
    assert safe_expression(df, "max(plot)", aggregate=True) and not safe_expression(df, "upper(plot)", aggregate=True)
    assert safe_expression(df, "plot like '%; select / %'", boolean=True) and not safe_expression(df, "plot", boolean=True)


def test_model_choice():
    good = {"a": [1, 1, 1, 1], "b": [1, 1, 1, 1], "c": [1, 1, 1, 1], "d": [1, 1, 1, 1]}
    ask = lambda table: lambda m, rows: [table[m][r] for r in rows]
    assert choose_model(ask(good), 4, "abcd", 0.2) == "a"
    assert choose_model(ask({**good, "a": [0, 0, 1, 1]}), 4, "ab", 0.2) == "b"
    assert choose_model(ask({**good, "c": [2, 2, 1, 1], "d": [2, 2, 1, 1]}), 4, "abc", 0.2) == "c"
    calls = []

    def counting(m, rows):
        calls.append((m, len(rows)))
        return [{**good, "a": [0, 1, 1, 1]}[m][r] for r in rows]

    choose_model(counting, 4, "abcd", 0.2)
    assert calls[-1] == ("d", 3)  # the strongest only where all others agree


def test_models_are_assigned(movies):
    frame = example(movies)
    plan = assign_models(frame.plan, OptimizeConfig(sample_size=5, models=("weak", "strong")), RULES)
    assert plan.model == "weak"
    small = assign_models(frame.plan, OptimizeConfig(sample_size=500, models=("weak", "strong")), RULES)
    assert small.model == "strong"
    assert sample_rows(100, OptimizeConfig(sample_ratio=0.1)) == 11
    with pytest.raises(ValueError):
        sample_rows(1, OptimizeConfig(sample_size=None))


def test_frames_are_immutable(movies):
    more = movies.semantic_map("first word", "plot", "w")
    assert "w" in more and "w" not in movies and isinstance(more.plan, Map)
