import numpy as np
import pytest

from semspan.llm import quality, truncation

WORDS = "harbor station lantern kingdom workshop meadow canyon frontier monastery satellite".split()


def summaries(spark):
    rows = []
    for i in range(120):
        rng = np.random.default_rng(i)
        said = [f"Holds the {rng.choice(WORDS)} of the {rng.choice(WORDS)} as a short code." for _ in range(3)]
        columns = " || ".join(f"{n}: {s}" for n, s in zip(("owner", "title", "price"), said))
        records = " || ".join(f"owner: {rng.choice(WORDS)} | title: The {rng.choice(WORDS)} | price: {rng.integers(1000)}" for _ in range(5))
        rows.append([i, i, ("feed", "form")[i % 2], columns, records, 0])
    cut = {(0, "column_summary"), (2, "record_summary"), (4, "record_summary"), (6, "column_summary"), (8, "record_summary"), (10, "column_summary")}
    rows[0][3] = rows[0][3][: rows[0][3].rindex("short") + 3]  # within a word
    rows[2][4] = rows[2][4][: rows[2][4].rindex(" | title")]  # within a record
    rows[4][4] = rows[4][4].rpartition(" || ")[0]  # a whole record
    rows[6][3] = rows[6][3].rpartition(" || ")[0] + " || "  # a whole segment
    rows[8][4] = rows[8][4][:-20] + " [...]"
    rows[10][3] = rows[10][3][: rows[10][3].rindex(" as a")]  # within a sentence
    rows[1][3] = rows[1][3].rstrip(".") + ", etc."  # complete
    rows[3][3] = rows[3][3] + "  \n"  # padded
    rows[5][3], rows[5][4], rows[7][3] = None, "", "   "
    return rows, cut


def test_truncation(spark):
    rows, cut = summaries(spark)
    schema = "summary_id long, table_id long, source string, column_summary string, record_summary string, loaded_at long, last string"
    df = spark.createDataFrame([(*r, "x") for r in rows + [rows[0]]], schema)
    tables = spark.createDataFrame([(i, 100, 0) for i in range(120)] + [(None, None, 0)], "table_id long, n_rows long, loaded_at long")
    values = truncation.truncated_values(df, tables)
    assert {(r["summary_id"], r["field"]) for r in values.filter("cut").collect()} == cut
    rates = {r["source"]: r for r in truncation.truncation_rates(values).collect()}
    assert rates["feed"]["n_cut"] == 6 and rates["form"]["n_cut"] == 0 and rates["form"]["n_values"] == 117
    assert truncation.truncated_values(df.limit(0), tables).count() == 0


def test_length_limits(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        text = " || ".join(f"c{j}: Holds the {rng.choice(WORDS)} of a {rng.choice(WORDS)}." for j in range(rng.integers(3, 14)))
        rows.append((i, i, "csv", text[:300], None, 0, len(text) > 300))
    df = spark.createDataFrame([r[:6] for r in rows], "summary_id long, table_id long, source string, column_summary string, record_summary string, loaded_at long")
    got = {r["summary_id"] for r in truncation.truncated_values(df).filter("cut").collect()}
    want = {r[0] for r in rows if r[6]}
    assert len(want) > 50 and len(got ^ want) <= 0.03 * len(want)


def test_statistics_of_odd_texts(spark):
    texts = ["", None, "  \n ", "One two. Three!\nfour", "a" * 200_000, "🇳🇬 \u200b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as words", "'z' as kind")
    got = {r["id"]: r for r in quality.text_statistics(df).collect()}
    assert [got[i]["blank"] for i in range(6)] == [True, True, True, False, False, False]
    assert got[3]["punctuated_lines"] == 0.5 and got[3]["mean_word_length"] == pytest.approx(3.75)
    assert got[3]["word_count"] == 4 and got[0]["symbol_ratio"] == 0


def test_kinds_of_held_out_texts(spark):
    rng = np.random.default_rng(0)
    word = lambda: str(rng.choice(WORDS))
    made = {
        "prose": lambda: " ".join(f"The {word()} is not far from the {word()}, and we saw it on the way to the {word()}." for _ in range(5)),
        "list": lambda: "\n".join(f"- {word()} {word()}" for _ in range(8)),
        "table": lambda: "name,count,price\n" + "\n".join(f"{word()},{rng.integers(999)},{rng.integers(99)}.50" for _ in range(8)),
        "junk": lambda: "".join(rng.choice(list("#$%^&*~<>|+=@ ")) for _ in range(200)),
    }
    kinds = ["prose"] * 60 + ["list", "table", "junk"] * 15
    texts = [(i, made[k]()) for i, k in enumerate(kinds)] + [(999, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, k in enumerate(kinds) if i % 3 == 0] + [(1, "junk")], "doc_id long, kind string")
    for known in (None, labels):
        got = {r["doc_id"]: r["kind"] for r in quality.classify(docs, known).collect()}
        held_out = [i for i in range(len(kinds)) if i % 3 and i != 1]
        assert sum(got[i] == kinds[i] for i in held_out) / len(held_out) >= 0.95
        assert got[999] is None
    assert quality.classify(docs.limit(0)).count() == 0
