"""Encoding a corpus with a public byte-level BPE vocabulary, inside the JVM.

Method: every text is cut into words by the vocabulary's own pattern; a higher-order
fold then merges the bytes of each *distinct* word by ascending rank, with the rank
map held as a literal. Bytes travel as ISO-8859-1 strings (one character per byte), so
that concatenation of pieces and map keys are plain strings. Decoding looks up the
binary piece of every id and concatenates.

The rank map is a constant hash table: an array of keys and one of ranks, in which a key stands in one of
the two slots that its XXH64 names. A lookup in a Spark map scans all of its keys; here it is one or two
comparisons. Words that are a single token resolve in place, which takes every frequent word out of
the shuffle; only the distinct words that need merges are exchanged, folded once and joined back. The
constant is bounded by the vocabulary (50,256 entries), whatever the corpus.

Results for odd inputs: a null text and an empty text both give an empty list; strings
that look like special tokens are ordinary text; repeated rows and repeated ids are
encoded row by row; columns of the input other than id and text are not read.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semspan.runtime import reliable_checkpoint

DEFAULT_TOKENIZER_DIR = os.environ.get("SEMSPAN_TOKENIZERS", "/opt/tokenizers")

#: The white space of Unicode's White_Space property, for Java's regular expressions.
_WS = r"\t\n\x0B\f\r \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The public word pattern of byte_bpe_50k in Java's syntax.
WORD_PATTERN = rf"'(?:s|t|re|ve|m|ll|d)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"

#: Slots of the rank literal are 2 to this power; with 50,256 keys two thirds stay empty, so that all keys find a place.
SLOT_BITS = 17
#: Words of one slice of a text; bounds the in-row lookup of merged words.
WORDS_PER_SLICE = 1024
#: Bytes beyond which a word is merged with a heap instead of the fold, whose cost is quadratic.
LONG_WORD_BYTES = 768
#: Distinct words that are work enough for one task.
WORDS_PER_TASK, LONG_WORDS_PER_TASK = 40_000, 1_000
#: Most frequent words that need merges whose ids are broadcast; of at most LONG_WORD_BYTES each, they hold 20 MB at most.
HOT_WORDS = 5_000
#: Keys over which the exact copies of a text are spread.
COPY_SALTS = 64
_NONE = 2**31 - 1


def vocabulary_path(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return os.path.join(folder or DEFAULT_TOKENIZER_DIR, f"{name}.tiktoken")


def read_vocabulary(path: str) -> bytes:
    """The vocabulary file. It is read by the driver alone, and travels to the executors with the tasks."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=4)
def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to rank; the rank of a token is its id."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line.strip())}


def load_ranks(path: str) -> dict[bytes, int]:
    return parse_ranks(read_vocabulary(path))


#: Stands between the keys of the rank literal. No key holds it: keys are of ISO-8859-1, or tokens that are words.
_SLOT = chr(0x2401)


def _places(key: str) -> tuple[int, int]:
    h = xxhash.xxh64_intdigest(key.encode(), seed=42)
    return h & ((1 << SLOT_BITS) - 1), (h >> 32) & ((1 << SLOT_BITS) - 1)


@lru_cache(maxsize=4)
def _rank_slots(path: str, whole_words: bool) -> tuple[str, str]:
    """Keys and ranks by slot, as texts. Frequent tokens come first and get their first slot."""
    keys: list[str] = [""] * (1 << SLOT_BITS)
    ranks = {}
    for token, rank in load_ranks(path).items():
        try:
            ranks[token.decode("utf-8") if whole_words else token.decode("latin-1")] = rank
        except UnicodeDecodeError:
            continue  # part of a character: no word of a text
    for key in ranks:
        first, second = _places(key)
        at = first if not keys[first] or keys[second] else second
        for _ in range(1_000):
            key, keys[at] = keys[at], key
            if not key:
                break
            first, second = _places(key)
            at = second if at == first else first
        else:
            raise ValueError("the vocabulary does not fit its table")
    return _SLOT.join(keys), ",".join(str(ranks.get(k, 0)) for k in keys)


def rank_literal(path: str, whole_words: bool = False) -> tuple[Column, Column]:
    """(keys, ranks) of the rank map; constant folding turns them into literals of the plan.

    Keys are bytes as ISO-8859-1, or with ``whole_words`` the tokens that are text, as they are. Every use is a
    copy that each task must read and every description of the plan prints, so callers bind it once with
    ``_with_ranks`` and run the plan at once.
    """
    keys, ranks = _rank_slots(path, whole_words)
    return F.split(F.lit(keys), _SLOT), F.split(F.lit(ranks), ",").cast("array<int>")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _with_ranks(path: str, whole_words: bool, body) -> Column:
    keys, ranks = rank_literal(path, whole_words)
    return _let(keys, lambda k: _let(ranks, lambda r: body((k, r))))


def _bytes_as_text(word: Column) -> Column:
    return F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")


def _rank_of(table: tuple[Column, Column], key: Column) -> Column:
    keys, ranks = table
    h, mask = F.xxhash64(key), F.lit((1 << SLOT_BITS) - 1).cast("long")
    first = h.bitwiseAND(mask).cast("int")
    second = F.shiftright(h, 32).bitwiseAND(mask).cast("int")
    return (
        F.when(F.get(keys, first) == key, F.get(ranks, first))
        .when(F.get(keys, second) == key, F.get(ranks, second))
        .otherwise(_NONE)
    )


def fold_merges(word: Column, ranks: tuple[Column, Column]) -> Column:
    """Token ids of one word: repeatedly merge the adjacent pair of lowest rank, leftmost first."""

    def step(state: Column, _i: Column) -> Column:
        pieces, pair = state["p"], state["r"]

        def merge(at: Column) -> Column:
            # at: 1-based place of the pair (p[at], p[at+1]) that merges
            joined = F.concat(F.element_at(pieces, at), F.element_at(pieces, at + 1))
            left = F.when(
                at > 1,
                F.array(_rank_of(ranks, F.concat(F.element_at(pieces, F.greatest(at - 1, F.lit(1))), joined))),
            ).otherwise(F.array().cast("array<int>"))
            right = F.when(
                at + 1 < F.size(pieces),
                F.array(_rank_of(ranks, F.concat(joined, F.get(pieces, at + 1)))),
            ).otherwise(F.array().cast("array<int>"))
            return F.struct(
                F.concat(F.slice(pieces, 1, at - 1), F.array(joined), F.slice(pieces, at + 2, F.size(pieces))).alias("p"),
                F.concat(
                    F.slice(pair, 1, F.greatest(at - 2, F.lit(0))), left, right, F.slice(pair, at + 2, F.size(pieces))
                ).alias("r"),
            )

        return _let(
            F.array_min(pair),
            lambda low: F.when(
                F.coalesce(low, F.lit(_NONE)) == _NONE, F.struct(pieces.alias("p"), pair.alias("r"))
            ).otherwise(_let(F.array_position(pair, low).cast("int"), merge)),
        )

    def fold(text: Column) -> Column:
        n = F.length(text)
        start = _let(
            F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(1))),
            lambda p: F.struct(
                p.alias("p"),
                F.when(
                    F.size(p) > 1,
                    F.transform(
                        F.sequence(F.lit(0), F.greatest(F.size(p) - 2, F.lit(0))),
                        lambda i: _rank_of(ranks, F.concat(F.get(p, i), F.get(p, i + 1))),
                    ),
                )
                .otherwise(F.array().cast("array<int>"))
                .alias("r"),
            ),
        )
        merged = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), start, step)["p"]
        return F.transform(merged, lambda piece: _rank_of(ranks, piece))

    return _let(_bytes_as_text(word), fold)


def merge_with_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges in n log n, for single words of unusual length."""
    n = len(word)
    if n < 2:
        return [ranks[word]] if n else []
    parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] is not a or j >= n or parts[j] is not b:
            continue  # one side has merged elsewhere since
        parts[i], parts[j], after[i] = a + b, None, after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n and (r := ranks.get(parts[k] + parts[after[k]])) is not None:
                heapq.heappush(heap, (r, k, parts[k], parts[after[k]]))
    return [ranks[p] for p in parts if p is not None]


def _long_word_ids(path: str):
    raw = read_vocabulary(path)

    @F.pandas_udf("array<int>")
    def ids(words: pd.Series) -> pd.Series:
        ranks = parse_ranks(raw)
        return words.map(lambda w: merge_with_heap(w.encode(), ranks))

    return ids


def _slices(docs: DataFrame, id_col: str, text_col: str, path: str, keep: list[str]) -> DataFrame:
    """Rows cut into slices of at most ``WORDS_PER_SLICE`` words, their words looked up; written once.

    (id, kept, h, n, k, t, need, slice_key): ``t`` holds ids, and -i for the i-th word of ``need``.
    """
    base = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept") if keep else F.lit(None).cast("string").alias("kept"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD_PATTERN), F.lit(0))
    cut = base.select("id", "kept", F.xxhash64("text").alias("h"), words.alias("w")).select(
        "id",
        "kept",
        "h",
        F.transform(
            F.sequence(F.lit(0), F.greatest(F.ceil(F.size("w") / WORDS_PER_SLICE) - 1, F.lit(0)).cast("int")),
            lambda k: F.struct(k.alias("k"), F.slice("w", k * WORDS_PER_SLICE + 1, F.lit(WORDS_PER_SLICE)).alias("w")),
        ).alias("slices"),
    )
    # explode(array(x)) keeps x from being copied into every later use of it.
    looked_up = cut.select("id", "kept", "h", F.size("slices").alias("n"), F.explode("slices").alias("s")).select(
        "id",
        "kept",
        "h",
        "n",
        F.col("s.k").alias("k"),
        F.col("s.w").alias("w"),
        F.explode(
            F.array(_with_ranks(path, True, lambda ranks: F.transform(F.col("s.w"), lambda w: _rank_of(ranks, w))))
        ).alias("t"),
    )
    missing = lambda w, i: F.get("t", i) == _NONE
    needed = looked_up.select("*", F.explode(F.array(F.array_distinct(F.filter("w", missing)))).alias("need"))
    place = lambda x, i: F.when(x != _NONE, x).otherwise(-F.array_position("need", F.get("w", i)).cast("int"))
    return reliable_checkpoint(
        needed.select(
            "id",
            "kept",
            "h",
            "n",
            "k",
            F.when(F.size("need") > 0, F.transform("t", place)).otherwise(F.col("t")).alias("t"),
            "need",
            # Copies of a text need the same words: they share keys, but spread over several, so that no task gets them all.
            F.when(F.size("need") > 0, F.xxhash64("need", F.pmod(F.xxhash64("id"), F.lit(COPY_SALTS))))
            .otherwise(F.xxhash64("id", "h", "k"))
            .alias("slice_key"),
        )
    )


def _needed(sliced: DataFrame, path: str, finish) -> DataFrame:
    """(slice_key, m): ``finish(ids)`` of each needed word of a slice, in order. Every distinct word is merged once."""
    wanted = (
        sliced.filter(F.size("need") > 0)
        .select("slice_key", F.posexplode("need").alias("pos", "word"))
        .groupBy("slice_key", "pos", "word")
        .agg(F.lit(1).alias("one"))
        .drop("one")
    )
    # Few bytes but much work: a fixed number of partitions, since adaptive execution would merge them by their bytes.
    # Written, so that the plan with the rank literal has no stage but its own: each would describe the literal anew.
    parts = int(sliced.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = reliable_checkpoint(wanted.groupBy("word").agg(F.count("*").alias("uses")).repartition(parts, "word"))
    is_long = F.octet_length("word") > LONG_WORD_BYTES
    n = distinct.agg(F.count("*").alias("all"), F.count_if(is_long).alias("long")).first()
    # Every task reads the rank literal, so that there are no more of them than the words need.
    short = distinct.filter(~is_long).coalesce(max(1, -(-n["all"] // WORDS_PER_TASK)))
    merged = short.select("word", "uses", _with_ranks(path, False, lambda ranks: fold_merges(F.col("word"), ranks)).alias("t"))
    if n["long"]:
        long = distinct.filter(is_long).coalesce(max(1, -(-n["long"] // LONG_WORDS_PER_TASK)))
        merged = merged.unionByName(long.select("word", "uses", _long_word_ids(path)(F.col("word")).alias("t")))
    merged = reliable_checkpoint(merged)
    dictionary = merged.select("word", finish(F.col("t")).alias("v"))
    hot = merged.filter(F.octet_length("word") <= LONG_WORD_BYTES).orderBy(F.desc("uses"), "word").limit(HOT_WORDS)
    hot = hot.select("word", finish(F.col("t")).alias("v"))
    tried = wanted.join(F.broadcast(hot), "word", "left")
    found = tried.filter("v is not null").select("slice_key", "pos", "v").unionByName(
        tried.filter("v is null").drop("v").join(dictionary, "word").select("slice_key", "pos", "v")
    )
    return found.groupBy("slice_key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("m")
    )


def _gathered(sliced: DataFrame, value: str, empty: Column, join, id_col: str, keep: list[str], out_col: str) -> DataFrame:
    """Slices to rows. Only those of texts of more than one are exchanged; rows that share an id come apart by the text's hash."""
    result = [F.col("id").alias(id_col), *[F.col(f"kept.`{c}`").alias(c) for c in keep]]
    whole = sliced.filter("n = 1").select(*result, F.col(value).alias(out_col))
    several = (
        sliced.filter("n > 1")
        .groupBy("id", "kept", "h", "n")
        .agg(F.array_sort(F.collect_list(F.struct("k", value))).alias("parts"))
        .withColumn("copies", F.floor(F.size("parts") / F.col("n")).cast("int"))
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        .select(
            *result,
            F.aggregate(
                F.transform(
                    F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.get("parts", k * F.col("copies") + F.col("copy"))[value]
                ),
                empty,
                join,
            ).alias(out_col),
        )
    )
    return whole.unionByName(several)


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "byte_bpe_50k",
    tokenizer_dir: str | None = None,
    keep: Iterable[str] = (),
    out_col: str = "ids",
) -> DataFrame:
    """One row per input row: ``id_col``, the columns of ``keep`` and ``out_col`` (array of token ids)."""
    path, keep = vocabulary_path(tokenizer, tokenizer_dir), [c for c in keep if c not in (id_col, out_col)]
    sliced = _slices(docs, id_col, text_col, path, keep)
    ids = F.flatten(F.transform("t", lambda x: F.when(x >= 0, F.array(x)).otherwise(F.get("m", -x - 1))))
    joined = sliced.join(_needed(sliced, path, lambda t: t), "slice_key", "left").select("id", "kept", "h", "n", "k", ids.alias("t"))
    return _gathered(joined, "t", F.array().cast("array<int>"), lambda a, b: F.concat(a, b), id_col, keep, out_col)


def count_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "byte_bpe_50k",
    tokenizer_dir: str | None = None,
    keep: Iterable[str] = (),
    out_col: str = "tokens",
) -> DataFrame:
    """As ``encode``, but only the number of ids (long): the ids themselves are never put together or exchanged."""
    path, keep = vocabulary_path(tokenizer, tokenizer_dir), [c for c in keep if c not in (id_col, out_col)]
    sliced = _slices(docs, id_col, text_col, path, keep)
    n = F.aggregate(
        "t", F.lit(0).cast("long"), lambda s, x: s + F.when(x >= 0, F.lit(1)).otherwise(F.get("m", -x - 1)).cast("long")
    )
    sizes = _needed(sliced, path, F.size)
    joined = sliced.join(sizes, "slice_key", "left").select("id", "kept", "h", "n", "k", n.alias("c"))
    return _gathered(joined, "c", F.lit(0).cast("long"), lambda a, b: a + b, id_col, keep, out_col)


def decode(
    encoded: DataFrame,
    id_col: str = "doc_id",
    ids_col: str = "ids",
    tokenizer: str = "byte_bpe_50k",
    tokenizer_dir: str | None = None,
    out_col: str = "text",
) -> DataFrame:
    """The text of every row: binary pieces looked up by id and concatenated. Unknown ids give nothing."""
    ranks = load_ranks(vocabulary_path(tokenizer, tokenizer_dir))
    pieces: list[str] = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    literal = F.split(F.lit(",".join(pieces)), ",")
    text = F.decode(
        F.unhex(
            _let(
                literal,
                lambda table: F.array_join(
                    F.transform(F.col(f"`{ids_col}`"), lambda i: F.coalesce(F.get(table, i), F.lit(""))), ""
                ),
            )
        ),
        "UTF-8",
    )
    return encoded.select(F.col(f"`{id_col}`"), text.alias(out_col))
