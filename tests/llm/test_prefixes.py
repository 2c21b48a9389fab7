from semspan.llm import truncation


def test_cut_inside_a_word_seen_once(spark):
    rows = [(0, "owner: Holds the labyrinthine key."), (1, "owner: Holds the labyr"), (2, "owner: Holds the key.")]
    schema = "summary_id long, table_id long, source string, column_summary string, record_summary string, loaded_at long"
    df = spark.createDataFrame([(i, i, "csv", text, None, 0) for i, text in rows], schema)
    got = {r["summary_id"]: r["in_word"] for r in truncation.truncated_values(df).collect()}
    assert got == {0: False, 1: True, 2: False}
