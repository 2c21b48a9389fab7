import os

import pytest

from semspan.llm import tokenizer as tk

pytestmark = pytest.mark.skipif(not os.path.exists(tk.vocabulary_path()), reason="no vocabulary files")

TEXTS = [
    "Hello world, it's 2024! don't we'll I'm", "", None, "   ", "a", " a\n\n b \t c", "<|endoftext|> is text", "Zuvewick's Ängström naïve café",
    "これは日本語の文章です。漢字とかな", "😀👩‍💻🇳🇬", "x" * 900, "ab" * 700, " ".join(f"zq{i}" for i in range(2500)), "  　 x\u0085y z", "é � \x00\x1c\x1f",
]


def reference(texts):
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [e.encode_ordinary(t or "") for t in texts]


def test_equals_the_public_library_and_round_trips(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    encoded = tk.encode(df)
    got = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    for i, ids in enumerate(reference(TEXTS)):
        assert got[i] == ids, TEXTS[i]
    assert {r["doc_id"]: r["text"] for r in tk.decode(encoded).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_heap_equals_fold(spark):
    ranks = tk.load_ranks(tk.vocabulary_path())
    words = [" antidisestablishmentarianism", " Qwxzv", "ééé", "aaaaaaaaaa", "日本語"]
    assert [tk.merge_with_heap(w.encode(), ranks) for w in words] == reference(words)


def test_repeated_ids_null_ids_and_clashing_names(spark):
    long = " ".join(f"zq{i}" for i in range(1500))
    rows = [(1, "zqx", "k"), (1, "zqy", "k"), (None, "zqx", "k"), (2, long, "k"), (2, long, "k"), (2, long + "!", "k")]
    df = spark.createDataFrame([(*r, "w", 7) for r in rows], "doc_id long, text string, kept string, slice_key string, ids int")
    got = tk.encode(df, keep=["kept"]).collect()
    assert sorted((r["doc_id"] or 0, len(r["ids"])) for r in got) == sorted((i or 0, len(x)) for (i, _, _), x in zip(rows, reference([t for _, t, _ in rows])))
    assert {r["kept"] for r in got} == {"k"}
    assert tk.encode(df.limit(0)).count() == 0
