import numpy as np
import pytest

from semspan.llm import quality


def test_reported_statistics_are_not_cut(spark):
    many = 1_100_000
    while np.rint(np.expm1(np.round(np.log1p(many), 6))) == many:
        many += 1
    texts = ["a" * 300, "これはとてもおいしいのでまたたべたい", "x " * many, "One two. Three four.", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.classify(docs).collect()}
    assert got[0]["mean_word_length"] == 300 and got[1]["common_words"] == 1
    assert got[2]["word_count"] == many
    assert got[3]["word_count"] == 4 and got[3]["mean_word_length"] == pytest.approx(3.75)
    assert got[4]["word_count"] == 0 and got[4]["mean_word_length"] == 0 and got[4]["common_words"] == 0


def test_the_mixture_still_gets_cut_statistics():
    got = quality.measure(["a" * 300, "これはとてもおいしいのでまたたべたい"])
    assert got["mean_word_length"][0] == 20 and got["common_words"][1] == 0.45
    assert got["exact_mean_word_length"][0] == 300 and got["exact_common_words"][1] == 1


def test_texts_are_measured_alike_alone_and_together():
    texts = ["a b", "", "- x\n- y\n", "p || q\tr", "Ends here.\r", "\r\nname: a | age: 2 || name: b | age: 3", "e\u0301 it's well-known -x-", "..... 7"]
    together = quality.measure(texts)
    for i, text in enumerate(texts):
        alone = quality.measure([text])
        assert all(alone[s][0] == pytest.approx(together[s][i], abs=1e-12) for s in together)
    assert together["exact_word_count"][6] == 4 and together["bullet_lines"][2] == 1 and together["bullet_lines"][7] == 1
    assert together["delimited_lines"][5] > 0.9 and list(together["blank"]) == [False, True] + [False] * 6
