"""Values that lost their end, and how often each source loses it.

Method: the words of all values but each value's last one form the corpus vocabulary;
its trie is held as a table of proper prefixes. A value whose last word is unknown and a
proper prefix of known words ends within a word. This is combined with evidence of

* length: a (source, field) whose lengths pile up at one size, in characters or bytes, or
  crowd just below the largest, has a limit, and values at it were cut there, unless they end
  with a full stop and miss nothing: a complete value may happen to have the limit's length;
* structure: records of a value share their fields and order, the described columns are
  the fields of the records, and ``max_records`` records are sampled where the table has so many rows;
  a value that falls short of these, or ends in a separator, lost its end;
* ending: the last words of finished segments are known; a description that ends otherwise,
  without being finished elsewhere in that way, ends within a sentence.

A mark put in place of the lost end ('...', '[...]' and the like) is looked through. ``by_method`` says
whether the trie and the lengths alone decide: a last word that is no word but the start of one, or a length at which
values pile up. Structure and endings are an extension of the method, for values cut between words at a length that is no
limit; ``truncation_evidence`` counts what each contributes. Marks, closing phrases and stops are looked for in the
last ``TAIL`` characters, words and names in the whole value. Everything
is DataFrame arithmetic: words, prefixes and endings are counted over all values, pre-aggregated
before each exchange, and joined by hash; only last words and last endings travel back.

Results for odd inputs: null, empty and blank values are no cases; of repeated deliveries
the first counts; padding is no content; accents and case make no difference to names and words;
unknown row counts give no evidence; a null source is a source of its own.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semspan.runtime import reliable_checkpoint

FIELDS = ("column_summary", "record_summary")
#: How many records a summary samples at most.
MAX_RECORDS = 5
#: A length is a limit if it is this many times as frequent as the lengths around it, at least so often, and three
#: times as frequent as any length near it.
PILE_RATIO, PILE_LEAST = 6.0, 10
#: Lengths below a limit that are compared with it, and that count as close to it.
NEAR = 24

_ACCENTED = [c for c in map(chr, range(0xC0, 0x180)) if (d := unicodedata.normalize("NFD", c)) != c and d[0].isascii()]
_PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)
#: What is put in place of a lost end.
_MARK = r"(?:\s*(?:\[\s*(?:\.{3}|…)\s*\]|\(cont[a-z.]*\)?|(?:\.{3}|…)\s*(?:\(?(?:read )?more\)?)?|\x{FFFD}+))\s*$"
#: Marks that no writer ends a text with, so that they are evidence by themselves.
_PLAIN_MARK = r"(?:\[\s*(?:\.{3}|…)\s*\]|\(cont[a-z.]*\)?|(?:\.{3}|…)\s*\(?(?:read )?more\)?|\x{FFFD})\s*$"
#: Phrases by which a writer closes an enumeration; a text that ends so is finished.
CLOSERS = ("etc", "among others", "and so on", "and so forth", "and others")
_CLOSED = r"(?:\b(?:" + "|".join(CLOSERS) + r")|\((?:see|cf)\.? [^()|]+\))[.…\s]*$"
_WORDS = r"[\p{L}\p{M}\p{N}]+"


#: White space as regular expressions see it.
_BLANKS = " \t\n\r\x0b\f"
#: Characters at the end of a value in which marks, closing phrases and stops are looked for: the longest such ending.
TAIL = 160


def plain(text: Column) -> Column:
    """Lower case without accents, composed or not; a text of ASCII has none to look for."""
    bare = F.translate(F.regexp_replace(text, r"\p{M}+", ""), "".join(_ACCENTED), _PLAIN)
    return F.lower(F.when(F.octet_length(text) == F.char_length(text), text).otherwise(bare))


def _names(parts: Column) -> Column:
    return F.transform(parts, lambda p: F.trim(F.substring_index(p, ":", 1)))


def _is_start(short: Column, long: Column) -> Column:
    """Whether ``short`` is ``long`` cut off: equal names, of which the last may be incomplete, and something is missing."""
    n = F.size(short)
    last = F.get(short, n - 1)
    same = F.slice(short, 1, F.greatest(n - 1, F.lit(0))) == F.slice(long, 1, F.greatest(n - 1, F.lit(0)))
    goes_on = F.startswith(F.get(long, n - 1), last)
    missing = (n < F.size(long)) | (last != F.get(long, n - 1))
    return F.coalesce((n > 0) & (n <= F.size(long)) & same & goes_on & missing, F.lit(False))


def _values(summaries: DataFrame, rows_of: DataFrame | None) -> DataFrame:
    one = summaries.groupBy("summary_id").agg(
        F.min_by(F.struct("table_id", "source", *FIELDS), F.col("loaded_at")).alias("s")
    )
    one = one.filter("summary_id is not null").select("summary_id", "s.*")
    if rows_of is not None:
        current = rows_of.groupBy("table_id").agg(F.max_by("n_rows", "loaded_at").alias("n_rows"))
        one = one.join(current, "table_id", "left")
    else:
        one = one.withColumn("n_rows", F.lit(None).cast("long"))
    blanks = F.lit(_BLANKS)
    ended = one.select(
        "summary_id",
        "source",
        "n_rows",
        *[F.struct(F.rtrim(F.col(f), blanks).alias("t"), F.char_length(f).alias("chars"), F.octet_length(f).alias("bytes")).alias(f) for f in FIELDS],
    )
    with_tail = ended.select("*", *[F.right(F.col(f"{f}.t"), F.lit(TAIL)).alias(f"tail_{f}") for f in FIELDS])
    unmarked = with_tail.select("*", *[F.regexp_replace(f"tail_{f}", _MARK, "").alias(f"end_{f}") for f in FIELDS])

    def bare(f: str) -> Column:
        lost = F.length(f"tail_{f}") - F.length(f"end_{f}")
        return F.when(lost > 0, F.left(F.col(f"{f}.t"), F.length(F.col(f"{f}.t")) - lost)).otherwise(F.col(f"{f}.t"))

    cleared = unmarked.select("*", *[plain(F.rtrim(bare(f), blanks)).alias(f"body_{f}") for f in FIELDS])
    cut = cleared.select(
        "*",
        F.filter(F.split("body_column_summary", r"\s*\|\|\s*"), lambda p: F.length(p) > 0).alias("columns"),
        F.transform(
            F.filter(F.split("body_record_summary", r"\s*\|\|\s*"), lambda p: F.length(F.trim(p)) > 0),
            lambda r: F.split(r, r"\s\|(?:\s+|$)"),
        ).alias("records"),
    )
    named = cut.select(
        "*",
        _names(F.col("columns")).alias("column_names"),
        _names(F.get("records", F.lit(0))).alias("first_names"),
        _names(F.get("records", F.size("records") - 1)).alias("last_names"),
    )
    few = F.coalesce(F.size("records") < F.least(F.lit(MAX_RECORDS), F.col("n_rows").cast("int")), F.lit(False))
    record_short = few | (
        F.when(F.size("records") > 1, _is_start(F.col("last_names"), F.col("first_names"))).otherwise(
            _is_start(F.col("first_names"), F.col("column_names"))
        )
    )
    column_short = (F.size("records") > 0) & _is_start(F.col("column_names"), F.col("first_names")) & (
        (F.size("records") > 1) | F.lit(False)
    )
    rest = lambda f, short: F.struct(
        F.lit(f).alias("field"), F.col(f"{f}.chars").alias("chars"), F.col(f"{f}.bytes").alias("bytes"), F.col(f"tail_{f}").alias("tail"),
        F.col(f"end_{f}").alias("end"), F.col(f"body_{f}").alias("body"), F.coalesce(short, F.lit(False)).alias("short"),
    )
    return (
        named.select(
            "summary_id",
            "source",
            F.explode(F.array(rest(FIELDS[0], column_short), rest(FIELDS[1], record_short))).alias("v"),
        )
        .select("summary_id", "source", "v.*")
        .filter(F.length("tail") > 0)
    )


def _limits(values: DataFrame) -> DataFrame:
    """(source, field, unit, at, exact): lengths at which values pile up, and largest lengths that values crowd below."""
    lengths = values.select(
        "source",
        "field",
        F.explode(
            F.array(
                F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("len")),
                F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("len")),
            )
        ).alias("l"),
    )
    counts = lengths.groupBy("source", "field", F.col("l.unit").alias("unit"), F.col("l.len").alias("len")).agg(
        F.count("*").alias("n")
    )
    series = Window.partitionBy("source", "field", "unit").orderBy("len")
    below = F.coalesce(F.sum("n").over(series.rangeBetween(-NEAR, -1)), F.lit(0))
    before = F.coalesce(F.sum("n").over(series.rangeBetween(-5 * NEAR, -NEAR - 1)), F.lit(0))
    above = F.coalesce(F.sum("n").over(series.rangeBetween(1, 5 * NEAR)), F.lit(0))
    here = F.col("n") + below
    rival = F.greatest(
        F.max("n").over(series.rangeBetween(-NEAR, -1)), F.max("n").over(series.rangeBetween(1, NEAR)), F.lit(0)
    )
    n, near = F.col("n"), F.col("n") + F.col("below")
    around = counts.select(
        "*", below.alias("below"), before.alias("before"), above.alias("above"), rival.alias("rival")
    )
    exact = (
        (n >= PILE_LEAST)
        & (n >= 3 * F.col("rival"))
        & (n >= PILE_RATIO * (F.col("below") + 1) / NEAR)
        & (n >= PILE_RATIO * (F.col("above") + 1) / (5 * NEAR))
    )
    crowd = (F.col("above") == 0) & (near >= 2 * PILE_LEAST) & (near >= (F.col("before") + 1) / 2)
    found = around.select("*", exact.alias("exact"), crowd.alias("crowd")).filter("exact or crowd")
    # A limit in one unit shows as smaller piles beside it and in the other unit: the largest pile is the limit.
    beside = Window.partitionBy("source", "field").orderBy("len").rangeBetween(-NEAR, NEAR)
    largest = F.max(F.when(F.col("exact"), F.col("n"))).over(beside)
    return found.withColumn("exact", F.col("exact") & (F.col("n") == largest)).withColumnRenamed("len", "at")


def truncated_values(summaries: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """One row per value that is not blank: summary_id, source, field, the evidence, and ``cut``.

    ``tables`` has (table_id, n_rows, loaded_at); without it the number of records is no evidence.
    """
    values = _values(summaries, tables)
    trimmed, bare = F.col("tail"), F.col("end")
    seen = values.select(
        "*",
        trimmed.rlike(_PLAIN_MARK).alias("marked"),
        (trimmed != bare).alias("any_mark"),
        bare.rlike(r"\|\s*$").alias("open"),
        bare.rlike(r"[(\[<&%\"“„/=+-]\s*$").alias("dangling"),
        trimmed.rlike(_CLOSED).alias("closed"),
        trimmed.rlike(r"[\p{L}\p{M})\]\"”][.!?。！？][\"”')\]]*$").alias("stop"),
        F.explode(F.array(F.split("body", r"\s*\|\|\s*|\s\|\s"))).alias("parts"),
    )
    worded = seen.select(
        "*",
        F.explode(
            F.array(
                F.transform("parts", lambda p: F.regexp_extract_all(F.regexp_replace(p, r"^[^:|]*:", ""), F.lit(_WORDS), F.lit(0)))
            )
        ).alias("words"),
        bare.rlike(r"[\p{L}\p{M}\p{N}]$").alias("ends_in_word"),
    )
    tail = lambda w: F.array_join(
        F.transform(F.slice(w, F.greatest(F.size(w) - 2, F.lit(1)), F.lit(3)), lambda x: F.regexp_replace(x, r"\d+", "0")), " "
    )
    ends = worded.select(
        "summary_id", "source", "field", "short", "marked", "any_mark", "open", "dangling", "closed", "stop", "chars", "bytes", "ends_in_word",
        F.flatten("words").alias("flat"),
        F.transform(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), tail).alias("tails"),
        tail(F.element_at("words", -1)).alias("tail"),
    ).withColumn("last", F.element_at("flat", F.when(F.size("flat") > 0, -1)))
    # Read by five aggregates: written once to the shared folder instead of being cut into words five times.
    ends = reliable_checkpoint(ends)
    limits = _limits(ends)
    # Vocabulary and finished endings, over all values.
    vocabulary = (
        ends.select(F.explode(F.slice("flat", 1, F.greatest(F.size("flat") - 1, F.lit(0)))).alias("word"))
        .filter(~F.col("word").rlike(r"\p{N}"))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )
    endings = (
        ends.filter(F.col("field") == FIELDS[0])
        .select(F.explode("tails").alias("tail"))
        .groupBy("tail")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .select("tail", F.lit(True).alias("finished"))
    )
    lasts = ends.filter(F.col("ends_in_word") & ~F.col("last").rlike(r"\p{N}")).select(F.col("last").alias("word")).distinct()
    prefixes = vocabulary.select(
        F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", F.lit(1), i))).alias("word")
    ).filter(F.length("word") > 0).distinct()
    partial = (
        lasts.join(vocabulary, "word", "left_anti").join(prefixes, "word", "left_semi").select(F.col("word").alias("last"), F.lit(True).alias("partial"))
    )
    at_limit = []
    for unit in ("chars", "bytes"):
        own = limits.filter(F.col("unit") == unit)
        at_limit.append(
            own.filter("exact").select("source", "field", F.col("at").alias(unit), F.lit(True).alias(f"exact_{unit}"))
        )
        at_limit.append(own.filter("crowd").groupBy("source", "field").agg(F.max("at").alias(f"most_{unit}")))
    found = ends.drop("flat", "tails").join(partial, "last", "left").join(endings, "tail", "left")
    for unit, (exact, most) in zip(("chars", "bytes"), (at_limit[:2], at_limit[2:])):
        null_safe = lambda other, keys, df: df.join(
            other.withColumnsRenamed({c: f"__{c}" for c in keys}),
            [df[c].eqNullSafe(F.col(f"__{c}")) for c in keys],
            "left",
        ).drop(*[f"__{c}" for c in keys])
        found = null_safe(exact, ["source", "field", unit], found)
        found = null_safe(most, ["source", "field"], found)
    yes = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))
    near = yes(F.col("chars") >= F.col("most_chars") - NEAR) | yes(F.col("bytes") >= F.col("most_bytes") - NEAR)
    unfinished = (F.col("field") == FIELDS[0]) & ~yes("finished") & ~F.col("closed") & ~F.col("stop")
    found = found.select(
        "summary_id",
        "source",
        "field",
        "last",
        "tail",
        "chars",
        F.col("short").alias("structure"),
        F.col("open"),
        F.col("marked"),
        F.col("any_mark"),
        F.col("dangling"),
        (yes("partial") & F.col("ends_in_word")).alias("in_word"),
        ((yes("exact_chars") | yes("exact_bytes")) & ~F.col("stop")).alias("at_limit"),
        near.alias("near_limit"),
        unfinished.alias("unfinished"),
    )
    cut = (
        F.col("structure")
        | F.col("open")
        | F.col("marked")
        | F.col("in_word")
        | F.col("at_limit")
        | F.col("unfinished")
        | (F.col("near_limit") & (F.col("any_mark") | F.col("dangling")))
    )
    return found.withColumn("by_method", F.col("in_word") | F.col("at_limit")).withColumn("cut", cut)


#: What can decide that a value is cut: the first two are the method's own, the others extend it.
EVIDENCE = ("in_word", "at_limit", "structure", "open", "marked", "unfinished")


def truncation_evidence(values: DataFrame) -> DataFrame:
    """Per field and piece of evidence: the cut values that have it (``n``), that have it alone, and that lie near a limit too."""
    every = F.array(*[F.struct(F.lit(e).alias("evidence"), F.col(e).alias("has")) for e in EVIDENCE])
    several = sum((F.col(e).cast("int") for e in EVIDENCE), F.lit(0))
    by = F.when(F.col("e.evidence").isin(*EVIDENCE[:2]), "method").otherwise("extension")
    return (
        values.filter("cut")
        .select("field", "near_limit", several.alias("several"), F.explode(every).alias("e"))
        .filter("e.has")
        .groupBy("field", F.col("e.evidence").alias("evidence"), by.alias("by"))
        .agg(F.count("*").alias("n"), F.count_if(F.col("several") == 1).alias("n_alone"), F.count_if("near_limit").alias("n_near_limit"))
    )


def truncation_rates(values: DataFrame) -> DataFrame:
    """Per source: ``n_values``, ``n_cut``, ``share_cut``."""
    return values.groupBy("source").agg(
        F.count("*").alias("n_values"),
        F.count_if("cut").alias("n_cut"),
        F.round(F.avg(F.col("cut").cast("double")), 6).alias("share_cut"),
    )
