"""The semantic operators on Spark DataFrames: map, filter, join, rank and reduce.

Each takes an instruction in words, a Python function (``func``) or a SQL expression (``expr``), and
returns a frame. What model calls cost is observed as the frame is computed: pass a ``Ledger`` and
read it after an action.
"""

from __future__ import annotations

import json
import math
import os
import statistics
import tempfile
import warnings
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from semspan.backends import Backend, Prompt, Spend, current_backend, grammar, parse_tags
from semspan.operators.evaluate import (
    ANSWER,
    Question,
    ask,
    call_function,
    demonstrations,
    kind_of,
    normal_strategy,
    truth,
)
from semspan.runtime import fresh_name, numbered, reliable_checkpoint

EMPTY_REDUCTION = "No data to process."
#: Pairs of values (or of batches) that a join by a function or a model makes unless it is told that more are meant.
MAX_PAIRS = 10_000_000
#: Segments of a ranking whose pivots are broadcast, and the most characters such a pivot may have: 40 MB at most.
BROADCAST_PIVOTS, PIVOT_CHARS = 1_000, 10_000
#: Values of one call of an aggregate function that are held in memory; where there are more, it gets them in a mapped file.
FUNCTION_VALUES = 5_000_000


@dataclass
class Ledger:
    """Collects what calls cost: at once for eager rounds, through observations for lazy frames."""

    spend: Spend = field(default_factory=Spend)
    observations: list[Observation] = field(default_factory=list)

    def watch(self, df: DataFrame, answer: str) -> DataFrame:
        seen = Observation()
        self.observations.append(seen)
        a = F.col(f"`{answer}`")
        return df.observe(
            seen,
            F.coalesce(F.sum(a["cost"]), F.lit(0.0)).alias("cost"),
            F.coalesce(F.sum(a["calls"]), F.lit(0)).alias("calls"),
            F.count_if(a["status"].startswith("error")).alias("errors"),
        )

    def settle(self) -> Spend:
        """Adds up the observations of frames that have been computed."""
        for seen in self.observations:
            got = seen.get
            self.spend.add(got["cost"], got["calls"], got["errors"])
        self.observations.clear()
        return self.spend


def limited(df: DataFrame, backend: Backend | None, rate_limit: int | None) -> tuple[DataFrame, Backend | None]:
    """``df`` and the backend such that all tasks together have at most ``rate_limit`` calls in flight.

    There are at most as many tasks as calls are allowed, and each gets its share of them.
    """
    if rate_limit is None:
        return df, backend
    if rate_limit < 1:
        raise ValueError("rate_limit must be at least 1")
    tasks = min(rate_limit, df.sparkSession.sparkContext.defaultParallelism)
    return df.coalesce(tasks), (backend or current_backend()).with_limit(max(1, rate_limit // tasks))


def _check(instruction: str | None, func, expr) -> None:
    if not instruction and func is None and expr is None:
        raise ValueError("an instruction, a function or an expression is needed")


def _answered(
    df: DataFrame, question: Question | None, inputs: Sequence[str], func, n_outputs: int, backend, model, ledger, answer: str
) -> DataFrame:
    """``df`` with the struct column ``answer`` (values, …): from the function, and from the model where that fails."""
    columns = [F.col(f"`{c}`") for c in inputs]
    if func is None:
        asked = df.withColumn(answer, ask(question, columns, backend, model))
        return ledger.watch(asked, answer) if ledger else asked
    tried = fresh_name(df, "tried")
    with_func = df.withColumn(tried, call_function(func, inputs, n_outputs))
    if question is None:
        return with_func.withColumnRenamed(tried, answer)
    asked = with_func.withColumn(answer, ask(question, columns, backend, model, when=F.col(f"`{tried}`.failed")))
    asked = ledger.watch(asked, answer) if ledger else asked
    a, t = F.col(f"`{answer}`"), F.col(f"`{tried}`")
    return asked.withColumn(answer, F.struct(F.when(t["failed"], a["values"]).otherwise(t["values"]).alias("values"))).drop(tried)


def _question(df, operation, instruction, inputs, tags, strategy, context, assertions=(), known=()) -> Question | None:
    if not instruction:
        return None
    return Question(
        operation,
        instruction,
        tuple(inputs),
        tuple(kind_of(df, c) for c in inputs),
        tuple(tags),
        normal_strategy(strategy),
        demonstrations(context),
        assertions=tuple(assertions),
        known=tuple(known),
    )


def sem_map(
    df: DataFrame,
    instruction: str | None = None,
    input_columns: Sequence[str] = (),
    output_columns: Sequence[str] = (),
    func: Callable | None = None,
    expr: str | None = None,
    context=None,
    strategy: str = "plain",
    backend: Backend | None = None,
    model: str | None = None,
    assertions: Sequence[Callable[[str], bool]] = (),
    ledger: Ledger | None = None,
    rate_limit: int | None = None,
    known: Sequence[tuple] = (),
) -> DataFrame:
    """Appends ``output_columns`` (strings). A row with a null input is not asked and gets nulls; so does a missing tag.

    An answer that fails an assertion becomes null. A failing ``func`` falls back to the model. ``rate_limit`` bounds
    the calls of all tasks together; ``known`` holds (inputs, answers) that need no call.
    """
    _check(instruction, func, expr)
    if not output_columns:
        raise ValueError("output_columns are needed")
    some_null = F.lit(False)
    for c in input_columns:
        some_null = some_null | F.col(f"`{c}`").isNull()
    if expr is not None:
        value = F.when(~some_null, F.expr(expr).cast("string"))
        return df.withColumns({c: value for c in output_columns})
    question = _question(df, "map", instruction, input_columns, output_columns, strategy, context, assertions, known)
    df, backend = limited(df, backend, rate_limit)
    answer = fresh_name(df, "map")
    done = _answered(df, question, input_columns, func, len(output_columns), backend, model, ledger, answer)
    values: dict[str, Column] = {c: F.get(F.col(f"`{answer}`.values"), F.lit(i)) for i, c in enumerate(output_columns)}
    return done.withColumns(values).drop(answer)


def sem_mask(
    df: DataFrame,
    instruction: str | None = None,
    input_columns: Sequence[str] = (),
    func: Callable | None = None,
    expr: str | None = None,
    context=None,
    strategy: str = "plain",
    backend: Backend | None = None,
    model: str | None = None,
    ledger: Ledger | None = None,
    mask_column: str = "keep",
    assertions: Sequence[Callable[[str], bool]] = (),
    rate_limit: int | None = None,
    known: Sequence[tuple] = (),
) -> DataFrame:
    """Appends the boolean ``mask_column``. A row with a null input is not asked and is False; so is an unreadable answer."""
    _check(instruction, func, expr)
    if expr is not None:
        some_null = F.lit(False)
        for c in input_columns:
            some_null = some_null | F.col(f"`{c}`").isNull()
        return df.withColumn(mask_column, F.coalesce(F.expr(expr), F.lit(False)) & ~some_null)
    question = _question(df, "filter", instruction, input_columns, ("output",), strategy, context, assertions, known)
    df, backend = limited(df, backend, rate_limit)
    answer = fresh_name(df, "filter")
    done = _answered(df, question, input_columns, func, 1, backend, model, ledger, answer)
    return done.withColumn(mask_column, truth(F.get(F.col(f"`{answer}`.values"), F.lit(0)))).drop(answer)


def sem_filter(df: DataFrame, *args, **kwargs) -> DataFrame:
    """The rows that meet the condition; arguments as for ``sem_mask``."""
    mask = fresh_name(df, "keep")
    return sem_mask(df, *args, **{**kwargs, "mask_column": mask}).filter(F.col(f"`{mask}`")).drop(mask)


def join_pairs(
    left: DataFrame,
    right: DataFrame,
    instruction: str | None,
    left_on: str,
    right_on: str,
    left_id: str,
    right_id: str,
    func: Callable | None = None,
    expr: str | None = None,
    strategy: str = "nest",
    batch_size: int = 5,
    cache: DataFrame | None = None,
    backend: Backend | None = None,
    model: str | None = None,
    ledger: Ledger | None = None,
    rate_limit: int | None = None,
    only_where: str | None = None,
    max_pairs: int | None = MAX_PAIRS,
) -> DataFrame:
    """Matching (l_id, r_id) pairs. Nulls never match and are never asked.

    ``expr`` is a condition over ``l`` and ``r``: an equality in it becomes a hash or sort-merge join. A
    function or a model must see every pair of different values: 'nest' asks for each pair, 'block' for each pair
    of batches of rows. ``only_where`` is a condition over ``l`` and ``r`` that a match of 'nest' meets in any case;
    with an equality in it only those pairs are made. More than ``max_pairs`` pairs are refused unless it is None.
    ``cache`` has (l_id, r_id, answer) for 'nest', (l_block, r_block, answer) for 'block'; what it holds is not asked.
    """
    _check(instruction, func, expr)
    if strategy not in ("nest", "block"):
        raise ValueError(f"unknown join strategy {strategy!r}")
    if strategy == "block" and func is not None:
        warnings.warn("the block strategy cannot use a function; it is ignored", stacklevel=2)
        func = None
    lv = left.select(F.col(f"`{left_id}`").alias("l_id"), F.col(f"`{left_on}`").alias("l")).filter("l is not null")
    rv = right.select(F.col(f"`{right_id}`").alias("r_id"), F.col(f"`{right_on}`").alias("r")).filter("r is not null")
    if expr is not None:
        return lv.join(rv, F.expr(expr)).select("l_id", "r_id")
    kinds = (kind_of(left, left_on), kind_of(right, right_on))
    lv, rv = reliable_checkpoint(lv), reliable_checkpoint(rv)  # read several times; what is above is computed, and paid, once
    if strategy == "block":
        return _block_pairs(lv, rv, instruction, kinds, batch_size, cache, backend, model, ledger, rate_limit, max_pairs)
    question = Question("join", instruction, ("left", "right"), kinds) if instruction else None
    lu, ru = lv.select("l").distinct(), rv.select("r").distinct()
    pairs = lu.join(ru, F.expr(only_where)) if only_where else lu.crossJoin(ru)
    n_pairs = pairs.count() if only_where else lu.count() * ru.count()
    if max_pairs is not None and n_pairs > max_pairs:
        raise ValueError(f"{n_pairs} pairs of values; give only_where, or a larger max_pairs")
    matches = None
    if cache is not None:
        said = cache.select("l_id", "r_id", F.col("answer").cast("string").alias("answer"))
        named = said.join(lv, "l_id").join(rv, "r_id").groupBy("l", "r").agg(F.max("answer").alias("answer"))
        known = reliable_checkpoint(named)
        matches = known.filter(truth(F.col("answer"), ignore_case=True)).select("l", "r")
        pairs = pairs.limit(0) if known.count() >= n_pairs else pairs.join(known, ["l", "r"], "left_anti")
    pairs, backend = limited(pairs, backend, rate_limit)
    if func is not None:
        tried = pairs.withColumn("t", call_function(lambda row: func(row["l"], row["r"]), ["l", "r"]))
    else:
        tried = pairs.withColumn("t", F.lit(None).cast("struct<values:array<string>,failed:boolean>"))
    if question is None:
        found = tried.filter(truth(F.get("t.values", F.lit(0)), True)).select("l", "r")
    else:
        when = F.coalesce(F.col("t.failed"), F.lit(True))
        asked = tried.withColumn("a", ask(question, [F.col("l"), F.col("r")], backend, model, when=when))
        asked = ledger.watch(asked, "a") if ledger else asked
        found = asked.filter(truth(F.coalesce(F.get("t.values", F.lit(0)), F.get("a.values", F.lit(0))), ignore_case=True)).select("l", "r")
    matches = found if matches is None else matches.unionByName(found)
    return matches.join(lv, "l").join(rv, "r").select("l_id", "r_id")


def _blocks(values: DataFrame, side: str, size: int) -> DataFrame:
    """Rows in batches of ``size`` by id."""
    no = F.col("no") - 1
    row = F.struct(no.alias("no"), F.col(f"{side}_id").alias("id"), F.col(side).cast("string").alias("v"))
    return (
        numbered(values, [F.col(f"{side}_id")], "no")
        .groupBy(F.floor(no / size).alias(f"{side}_block"))
        .agg(F.array_sort(F.collect_list(row)).alias(f"{side}s"))
    )


def _block_pairs(lv, rv, instruction, kinds, size, cache, backend, model, ledger, rate_limit, max_pairs) -> DataFrame:
    n_pairs = -(-lv.count() // size) * -(-rv.count() // size)
    if max_pairs is not None and n_pairs > max_pairs:
        raise ValueError(f"{n_pairs} pairs of batches; give a larger max_pairs")
    pairs, backend = limited(_blocks(lv, "l", size).crossJoin(_blocks(rv, "r", size)), backend, rate_limit)
    known = F.lit(None).cast("string")
    if cache is not None:
        pairs = pairs.join(
            cache.select("l_block", "r_block", F.col("answer").cast("string").alias("known")), ["l_block", "r_block"], "left"
        )
        known = F.col("known")
    chosen = backend or current_backend()
    @F.pandas_udf(ANSWER)
    def evaluate(row):
        out = [{"values": None, "cost": 0.0, "calls": 0, "status": "skipped"} for _ in range(len(row))]
        at = [i for i, w in enumerate(row["asked"]) if w]
        prompts = [
            Prompt(
                "join_block",
                instruction,
                tuple((f"L{k}", kinds[0], x) for k, x in enumerate(row["l"].iloc[i]))
                + tuple((f"R{k}", kinds[1], x) for k, x in enumerate(row["r"].iloc[i])),
            )
            for i in at
        ]
        for i, reply in zip(at, chosen.complete(prompts, model) if prompts else []):
            out[i] = {
                "values": [parse_tags(reply.text, ("output",))["output"]],
                "cost": reply.cost,
                "calls": reply.calls,
                "status": reply.status,
            }
        return pd.DataFrame(out, columns=["values", "cost", "calls", "status"])

    values = lambda side: F.transform(F.col(f"{side}s"), lambda x: x["v"]).alias(side)
    asked = pairs.withColumn("a", evaluate.asNondeterministic()(F.struct(values("l"), values("r"), known.isNull().alias("asked"))))
    asked = ledger.watch(asked, "a") if ledger else asked
    said = F.coalesce(known, F.get("a.values", F.lit(0)), F.lit(""))
    return decode_block_replies(asked.withColumn("reply", said))


def decode_block_replies(pairs: DataFrame) -> DataFrame:
    """(l_id, r_id) from ``reply`` ('L0-R1, …', counted from 0 within ``ls`` and ``rs``); malformed and foreign labels are dropped."""
    hit = F.explode(F.regexp_extract_all("reply", F.lit(r"L\d+\s*-\s*R\d+"), F.lit(0))).alias("hit")
    place = lambda side: F.regexp_extract("hit", rf"{side}(\d+)", 1).cast("int")
    return (
        pairs.select("ls", "rs", hit)
        .select(F.get("ls", place("L"))["id"].alias("l_id"), F.get("rs", place("R"))["id"].alias("r_id"))
        .filter("l_id is not null and r_id is not null")
        .distinct()
    )


def sem_join(
    left: DataFrame,
    right: DataFrame,
    instruction: str | None,
    left_on: str,
    right_on: str,
    left_id: str,
    right_id: str,
    how: str = "inner",
    suffix: str = "_right",
    **kwargs,
) -> DataFrame:
    """Rows of both sides for all matching pairs; ``how`` is inner, left or right. Clashing names of the right side get a suffix."""
    if how not in ("inner", "left", "right"):
        raise ValueError(f"unknown join type {how!r}")
    pairs = join_pairs(left, right, instruction, left_on, right_on, left_id, right_id, **kwargs)
    taken = {c.lower() for c in left.columns}
    renamed = right.select(*[F.col(f"`{c}`").alias(c + suffix if c.lower() in taken else c) for c in right.columns])
    r_key = right_id + suffix if right_id.lower() in taken else right_id
    first = left.join(pairs, left[left_id] == pairs["l_id"], "left" if how == "left" else "inner").drop("l_id")
    joined = first.join(renamed, F.col("r_id") == F.col(f"`{r_key}`"), {"inner": "inner", "left": "left", "right": "right"}[how])
    return joined.drop("r_id")


def sem_rank(
    df: DataFrame,
    instruction: str | None,
    input_column: str,
    id_column: str,
    descend: bool = True,
    func: Callable | None = None,
    expr: str | None = None,
    cache: dict | DataFrame | None = None,
    backend: Backend | None = None,
    model: str | None = None,
    ledger: Ledger | None = None,
    max_rounds: int = 200,
    rank_column: str = "ranking",
    rate_limit: int | None = None,
) -> DataFrame:
    """Appends ``rank_column``, 1 for the row that meets the criterion most (or least, if not ``descend``).

    With ``expr`` or ``func`` rows are ordered by that key. A model compares different values, each once however
    many rows have it: in each round every value of every open segment is compared with its segment's pivot in one
    job, and segments split into better, equal and worse. For n different values that is an expected
    1.39 n log2(n) calls at most, in fewer than 4.4 ln(n) rounds but for freak chance; after ``max_rounds`` an error
    is raised, as it is when a comparison fails. Nulls are never compared and come last, ties are ordered by
    id. ``cache`` holds ``(id, pivot id) -> "1" or "2"``, as a dict or as a frame (id, pivot, answer).
    """
    _check(instruction, func, expr)
    value = F.col(f"`{input_column}`")
    if expr is not None or func is not None:
        key = fresh_name(df, "key")
        if expr is not None:
            keyed = df.withColumn(key, F.when(value.isNotNull(), F.expr(expr)))
        else:
            got = F.get(call_function(func, [input_column])["values"], F.lit(0))
            keyed = df.withColumn(key, got.try_cast("double"))
        order = F.col(f"`{key}`").desc_nulls_last() if descend else F.col(f"`{key}`").asc_nulls_last()
        return numbered(keyed, [order, F.col(f"`{id_column}`")], rank_column).drop(key)
    ledger = ledger or Ledger()
    # Read in every round and by the final numbering: what is above is computed, and paid, once.
    df = reliable_checkpoint(df)
    text = fresh_name(df, "text")
    question = Question("rank", instruction, ("first", "second"), (kind_of(df, input_column),) * 2)
    state = reliable_checkpoint(
        df.filter(value.isNotNull()).groupBy(value.cast("string").alias("v")).agg(F.lit("").alias("path"), F.lit(False).alias("done"))
    )
    known = _known_order(df, cache, id_column, value)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for no in range(max_rounds):
        # A segment's pivot is its value of least hash: chosen by an aggregate, never by ordering a segment.
        pivots = state.filter("not done").groupBy("path").agg(
            F.min_by("v", F.struct(F.xxhash64("v", F.lit(no)), "v")).alias("pv"), F.count("*").alias("n")
        )
        # The largest segments meet their pivots by broadcast, so that none is gathered; the others are small and join by hash.
        bounded = pivots.withColumn("pv", F.when(F.length("pv") <= PIVOT_CHARS, F.col("pv")))
        largest = bounded.orderBy(F.desc("n"), "path").limit(BROADCAST_PIVOTS).collect()
        if not largest:
            break
        large = [r for r in largest if r["pv"] is not None]
        near = F.broadcast(df.sparkSession.createDataFrame(large, pivots.schema))
        open_values = state.join(near, "path", "left")  # what is done has a path of its own, and passes through
        if len(large) < len(largest) or len(largest) == BROADCAST_PIVOTS:
            far = open_values.filter("not done and pv is null").drop("pv", "n").join(pivots, "path")
            open_values = open_values.filter("done or pv is not null").unionByName(far).coalesce(parts)
        if known is not None:
            open_values = open_values.join(known, ["v", "pv"], "left")
        else:
            open_values = open_values.withColumn("known", F.lit(None).cast("string"))
        open_values, asking = limited(open_values, backend, rate_limit)
        is_pivot = F.col("v") == F.col("pv")
        asked = open_values.withColumn(
            "a", ask(question, [F.col("v"), F.col("pv")], asking, model, when=~F.col("done") & ~is_pivot & F.col("known").isNull())
        )
        asked = ledger.watch(asked, "a")
        said = F.lower(F.trim(F.coalesce(F.col("known"), F.get("a.values", F.lit(0)), F.lit("2"))))
        equal = is_pivot | said.isin("0", "=", "equal")
        moved = asked.select(
            "v",
            F.when(F.col("done"), F.col("path"))
            .otherwise(F.concat("path", F.when(equal, "1").when(said == "1", "0").otherwise("2")))
            .alias("path"),
            (F.col("done") | equal | (F.col("n") == 1)).alias("done"),
        )
        errors = ledger.spend.errors
        state = reliable_checkpoint(moved)
        if ledger.settle().errors > errors:
            raise RuntimeError(f"{ledger.spend.errors - errors} comparisons failed")
    else:
        if not state.filter("not done").isEmpty():
            raise RuntimeError(f"the order was not complete after {max_rounds} rounds")
    path = fresh_name(df, "path")
    order = F.col(path).asc_nulls_last() if descend else F.col(path).desc_nulls_last()
    placed = df.withColumn(text, value.cast("string")).join(state.select(F.col("v").alias(text), F.col("path").alias(path)), text, "left")
    return numbered(placed, [order, F.col(f"`{id_column}`")], rank_column).select(*[F.col(f"`{c}`") for c in df.columns], rank_column)


def _known_order(df: DataFrame, cache, id_column: str, value: Column) -> DataFrame | None:
    """(v, pv, known) from answers by id; an answer also says what the reverse question would give."""
    if cache is None or (isinstance(cache, dict) and not cache):
        return None
    if isinstance(cache, dict):
        kind = df.schema[id_column].dataType.simpleString()
        rows = [(a, b, str(c)) for (a, b), c in cache.items()]
        cache = df.sparkSession.createDataFrame(rows, f"id {kind}, pivot {kind}, answer string")
    of = lambda name, said: df.select(F.col(f"`{id_column}`").alias(name), value.cast("string").alias(said)).filter(F.col(said).isNotNull())
    named = cache.join(of("id", "v"), "id").join(of("pivot", "pv"), "pivot").select("v", "pv", F.trim("answer").alias("known"))
    turned = F.when(F.col("known") == "1", "2").when(F.col("known") == "2", "1").otherwise(F.col("known"))
    both = named.withColumn("own", F.lit(0)).unionByName(
        named.select(F.col("pv").alias("v"), F.col("v").alias("pv"), turned.alias("known"), F.lit(1).alias("own"))
    )
    return reliable_checkpoint(both.groupBy("v", "pv").agg(F.min_by("known", F.struct("own", "known")).alias("known")))


#: Functions that Spark computes itself, with what they are called in SQL.
_NATIVE_AGGREGATES = {max: "max", min: "min", sum: "sum", len: "count", statistics.mean: "avg", statistics.fmean: "avg", math.fsum: "sum"}


def _reduce_whole_groups(base: DataFrame, keys: list[str], func: Callable, held_values: int) -> DataFrame:
    """(keys, n, result, failed) of ``func``, called once for all values of a group, however many they are.

    They reach Python in small batches; more than ``held_values`` are written to a file as they come, and mapped from there.
    """
    kinds = [to_arrow_type(base.schema[k].dataType) for k in keys]
    outcome = [StructField("n", LongType()), StructField("result", StringType()), StructField("failed", BooleanType())]

    def gathered(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
        held, n, file = [np.empty(0)], 0, None
        try:
            for batch in batches:
                got = batch.column("v").to_numpy(zero_copy_only=False)
                held.append(got[~np.isnan(got)])
                n += len(held[-1])
                if n > held_values:
                    # Without a name, in the executor's own scratch space: it goes with the last reference to the array.
                    file = file or tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
                    file.writelines(held)
                    held.clear()
            if file is None:
                return np.concatenate(held)
            file.flush()
            return np.asarray(np.memmap(file, "float64", "r+", shape=(n,)))
        finally:
            if file:
                file.close()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches)
        kept = gathered(chain([first], batches))
        result, failed = None, False
        if len(kept):
            try:
                result = str(func(pd.Series(kept, copy=False)))
            except Exception:  # noqa: BLE001 - the group falls back to the model
                failed = True
        named = [first.column(k).slice(0, 1).cast(kind) for k, kind in zip(keys, kinds)]
        row = [pa.array([len(kept)], pa.int64()), pa.array([result], pa.string()), pa.array([failed])]
        yield pa.RecordBatch.from_arrays([*named, *row], names=[*keys, "n", "result", "failed"])

    values = base.select(*keys, F.col("__v").cast("double").alias("v"))
    return values.groupBy(*keys).applyInArrow(apply, StructType([*(base.schema[k] for k in keys), *outcome]))


def _reduce_by_function(base: DataFrame, keys: list[str], func: Callable, combine: Callable | None) -> DataFrame:
    """(keys, n, result, failed) of ``func`` over the numbers of each group, written once."""
    value = F.col("__v").cast("double")
    if name := _NATIVE_AGGREGATES.get(func):
        native = F.expr(f"{name}(cast(__v as double))").cast("string")
        got = base.groupBy(*keys).agg(F.count(value).alias("n"), native.alias("result")).withColumn("failed", F.lit(False))
        return reliable_checkpoint(got)
    largest = base.groupBy(*keys).agg(F.count(value).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > FUNCTION_VALUES and combine is None:
        return reliable_checkpoint(_reduce_whole_groups(base, keys, func, FUNCTION_VALUES))
    # A grouped function gives one plain value and stands alone: a JSON text holds all there is to say.
    result = "struct<n:bigint,result:string,parts:array<double>,failed:boolean>"

    @F.pandas_udf("string")
    def apply(values: pd.Series) -> str:
        kept = values.dropna()
        if kept.empty:
            return json.dumps({"n": 0, "failed": False})
        try:
            got = func(kept)
            parts = [float(x) for x in (got if isinstance(got, (tuple, list)) else [got])] if combine else None
            return json.dumps({"n": len(kept), "result": str(got), "parts": parts, "failed": False})
        except Exception:  # noqa: BLE001 - the group falls back to the model
            return json.dumps({"n": len(kept), "failed": True})

    if combine is None:
        got = base.groupBy(*keys).agg(apply(value).alias("r")).withColumn("r", F.from_json("r", result))
        return reliable_checkpoint(got.select(*keys, "r.n", "r.result", "r.failed"))
    # Parts of bounded size, whatever the group: rows go round the parts of their group.
    parts = max(1, -(-largest // FUNCTION_VALUES), base.sparkSession.sparkContext.defaultParallelism)
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts))
    partial = base.withColumn("__p", part).groupBy(*keys, "__p").agg(apply(value).alias("r")).withColumn("r", F.from_json("r", result))

    @F.udf("struct<result:string,failed:boolean>")
    def merge(rows):
        try:
            got = [tuple(p) if len(p) > 1 else p[0] for p in rows if p is not None]
            return (str(combine(got)) if got else None, False)
        except Exception:  # noqa: BLE001
            return (None, True)

    merged = partial.groupBy(*keys).agg(F.collect_list("r.parts").alias("p"), F.sum("r.n").alias("n"), F.max("r.failed").alias("f"))
    merged = merged.withColumn("m", merge("p"))
    return reliable_checkpoint(merged.select(*keys, "n", "m.result", (F.col("m.failed") | F.col("f")).alias("failed")))


#: Aggregates that are their own combination: the answers over parts are asked about in the same words.
_IDEMPOTENT = ("max", "min", "first", "last")


def _reduce_by_model(
    base: DataFrame, keys: list[str], instruction: str, kind: str, size: int, combine: str | Callable | None,
    backend: Backend | None, model: str | None, ledger: Ledger | None, rate_limit: int | None,
) -> DataFrame:
    """(keys, result) for every group that has values; ``base`` has (keys, __o, __v) and is read several times."""
    chosen = backend or current_backend()
    ledger = ledger or Ledger()
    level = base.filter("__v is not null").select(*keys, "__o", F.col("__v").alias("v"))
    largest = level.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0

    def asking(words: str, backend: Backend):
        @F.pandas_udf(ANSWER)
        def answer(rows: pd.Series) -> pd.DataFrame:
            prompts = []
            for values in rows:
                label = lambda i, w: str(i + 1) if w == 1 else f"{i + 1} ({w} times)"
                prompts.append(Prompt("reduce", words, tuple((label(i, x["w"]), kind, x["v"]) for i, x in enumerate(values))))
            return pd.DataFrame(
                [
                    {"values": [parse_tags(r.text, ("output",))["output"]], "cost": r.cost, "calls": r.calls, "status": r.status}
                    for r in (backend.complete(prompts, model) if prompts else [])
                ],
                columns=["values", "cost", "calls", "status"],
            )

        return answer.asNondeterministic()

    def ask_parts(parts: DataFrame, words: Sequence[str]) -> DataFrame:
        """``parts`` has ``s``, the values of each question; adds a0, a1, … for the questions, written once."""
        parts, limited_backend = limited(parts, chosen, rate_limit)
        for i, w in enumerate(words):
            parts = ledger.watch(parts.withColumn(f"a{i}", asking(w, limited_backend)("s")), f"a{i}")
        done = reliable_checkpoint(parts)
        ledger.settle()
        return done

    row = lambda *more: F.struct(*more, "v", F.col("w").cast("long").alias("w"))
    said = lambda i: F.get(F.col(f"a{i}.values"), F.lit(0))
    if largest <= size:
        one = level.withColumn("w", F.lit(1)).groupBy(*keys).agg(F.array_sort(F.collect_list(row("__o"))).alias("s"))
        return ask_parts(one, [instruction]).select(*keys, said(0).alias("result"))
    found = grammar.aggregate(instruction)
    name = found[0] if found else None
    if callable(combine):
        name, words = "function", [instruction]
    elif combine:
        name, words = "again", [instruction]
    elif name == "avg":
        total = grammar.in_place_of_average(instruction, "total")
        words = [total, f"How many numbers are there among the values? (Wanted is: {total})"]
    elif name in ("count", "sum", "mode", *_IDEMPOTENT):
        words = [instruction]
    else:
        raise ValueError(
            f"{largest} values do not fit one question ({size}), and how to combine answers to {instruction!r} is not known; give combine"
        )
    # Numbers run on within a group, so that parts are full and none is larger than a question may be; equal values, and
    # values without an order, are told apart by where they are read.
    level = level.withColumn("w", F.lit(1).cast("long"))
    if name == "mode":
        # Equal values are counted first: a question holds each once, with its number.
        level = level.groupBy(*keys, "v").agg(F.count("*").alias("w"), F.min("__o").alias("__o"))
    ordered = numbered(level.withColumn("__tie", F.monotonically_increasing_id()), [*keys, "__o", "v", "__tie"], "__no")
    if keys:
        starts = ordered.groupBy(*keys).agg(F.min("__no").alias("__start")).withColumnsRenamed({k: f"__{k}" for k in keys})
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        ordered = ordered.join(starts, same).select(*keys, "v", "w", (F.col("__no") - F.col("__start")).alias("no"))
    else:
        ordered = ordered.select("v", "w", (F.col("__no") - 1).alias("no"))
    part = F.floor(F.col("no") / size).alias("part")
    first = ask_parts(ordered.groupBy(*keys, part).agg(F.array_sort(F.collect_list(row("no"))).alias("s")), words)
    bad = said(0).isNull()
    for i in range(1, len(words)):
        bad = bad | said(i).isNull()
    if name in ("count", "sum", "avg"):
        number = lambda i: F.coalesce(F.expr(grammar.sql_number(f"a{i}.`values`[0]")), F.lit(0.0))
        added = first.groupBy(*keys).agg(
            F.sum(number(0)).alias("x"), F.sum(number(len(words) - 1)).alias("c"), F.max(bad).alias("bad")
        )
        result = {
            "count": F.col("x").cast("long").cast("string"),
            "sum": F.round("x", 6).cast("string"),
            "avg": F.when(F.col("c") > 0, F.round(F.col("x") / F.col("c"), 6).cast("string")),
        }[name]
        return added.select(*keys, F.when(~F.col("bad"), result).alias("result"))
    level = first.select(*keys, "part", said(0).alias("v"), bad.alias("bad"), "s")

    def counted(df: DataFrame) -> DataFrame:
        """The number of the value that was answered; an answer that is none of the values is no answer."""
        if name != "mode":
            return df.withColumn("w", F.lit(1).cast("long")).drop("s")
        own = F.get(F.filter("s", lambda x: x["v"] == F.col("v")), F.lit(0))["w"]
        return df.withColumn("w", F.coalesce(own, F.lit(0))).withColumn("bad", F.col("bad") | own.isNull()).drop("s")

    level = counted(level)
    while level.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").count():
        gathered = level.groupBy(*keys, F.floor(F.col("part") / size).alias("next")).agg(
            F.array_sort(F.collect_list(F.struct("part", "v", "w"))).alias("s"), F.max("bad").alias("bad"), F.count("*").alias("n")
        )
        gathered = gathered.withColumnRenamed("next", "part")
        if name == "function":
            merge = F.udf(lambda rows: str(combine([r["v"] for r in rows])) if rows else None, "string")
            level = reliable_checkpoint(gathered.select(*keys, "part", merge("s").alias("v"), "bad", F.lit(1).cast("long").alias("w")))
            continue
        alone = gathered.filter("n = 1").select(*keys, "part", F.get("s", F.lit(0))["v"].alias("v"), F.get("s", F.lit(0))["w"].alias("w"), "bad")
        again = ask_parts(gathered.filter("n > 1 and not bad"), [combine or instruction])
        answered = counted(again.select(*keys, "part", said(0).alias("v"), said(0).isNull().alias("bad"), "s"))
        failed = gathered.filter("n > 1 and bad").select(*keys, "part", F.lit(None).cast("string").alias("v"), "bad", F.lit(1).cast("long").alias("w"))
        level = reliable_checkpoint(alone.unionByName(answered).unionByName(failed))
    return level.select(*keys, F.when(~F.col("bad"), F.col("v")).alias("result"))


def sem_reduce(
    df: DataFrame,
    instruction: str | None,
    input_column: str,
    group_by: Sequence[str] = (),
    func: Callable | None = None,
    expr: str | None = None,
    order_by: str | None = None,
    values_per_prompt: int = 500,
    combine: str | Callable | None = None,
    backend: Backend | None = None,
    model: str | None = None,
    ledger: Ledger | None = None,
    result_column: str = "reduce_result",
    rate_limit: int | None = None,
) -> DataFrame:
    """One row (or one per group) with ``result_column``. Nulls are left out; no value at all gives a fixed message.

    ``expr`` is an aggregate expression and is computed by Spark. ``func`` takes the values of a numeric column as
    a series; known functions (max, min, sum, len, mean) are computed by Spark, and the model is asked for those
    groups only in which it fails. A function is called once for all values of a group; more than ``FUNCTION_VALUES``
    it gets in a file mapped into memory. To have parts computed side by side, give ``combine``: a function that makes
    one result of a list of results over parts (numbers or tuples of numbers).

    A model sees at most ``values_per_prompt`` values at once. A larger group is asked about in parts, and the answers
    are put together by what is asked: counts and totals are added, an average is a total over a number, the most
    frequent value is found among values with their exact numbers, and the largest, smallest, first or last is
    asked for again among the answers. For any other question ``combine`` says how: an instruction, asked of the
    answers over parts, or a function of a list of answers that may be applied level by level. Without it such a question
    is refused. A part that has no readable answer makes its group's result null, and is counted as an error if its
    call failed. The frame is computed at once where a model or a function is used.
    """
    _check(instruction, func, expr)
    groups = [F.col(f"`{g}`") for g in group_by]
    value = F.col(f"`{input_column}`")
    if expr is not None:
        grouped = df.groupBy(*groups).agg(F.count(value).alias("__n"), F.expr(expr).cast("string").alias(result_column))
        empty = F.when(F.col("__n") == 0, F.lit(EMPTY_REDUCTION)).otherwise(F.col(f"`{result_column}`"))
        return grouped.withColumn(result_column, empty).drop("__n")
    kind = kind_of(df, input_column)
    keys = [f"k{i}" for i in range(len(group_by))]
    key = F.col(f"`{order_by}`") if order_by else value
    base = reliable_checkpoint(
        df.select(*[g.alias(k) for g, k in zip(groups, keys)], key.alias("__o"), value.cast("string").alias("__v"))
    )
    everyone = base.groupBy(*keys).agg(F.count("__v").alias("n"))
    answers, failing = None, base
    if func is not None and kind == "numeric":
        applied = _reduce_by_function(base, keys, func, combine if callable(combine) else None)
        answers = applied.filter("not failed").select(*keys, "result")
        lost = applied.filter("failed").select(*keys)
        failing = None
        if instruction and not lost.isEmpty():
            renamed = lost.withColumnsRenamed({k: f"__{k}" for k in keys})
            failing = base.join(renamed, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left_semi") if keys else base
    elif not instruction:
        raise ValueError("a function needs a numeric column, or an instruction beside it")
    if failing is not None:
        asked = _reduce_by_model(failing, keys, instruction, kind, values_per_prompt, combine, backend, model, ledger, rate_limit)
        answers = asked if answers is None else answers.unionByName(asked)
    if keys:
        found = answers.withColumnsRenamed({k: f"__{k}" for k in keys})
        out = everyone.join(found, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left")
    else:
        out = everyone.crossJoin(_one_row(answers))  # one row each
    result = F.when(F.col("n") == 0, F.lit(EMPTY_REDUCTION)).otherwise(F.col("result"))
    return out.select(*[F.col(k).alias(g) for k, g in zip(keys, group_by)], result.alias(result_column))


def _one_row(answers: DataFrame) -> DataFrame:
    """The only answer, or null if there is none."""
    return answers.agg(F.first("result").alias("result"))


__all__ = [
    "EMPTY_REDUCTION",
    "Ledger",
    "decode_block_replies",
    "join_pairs",
    "limited",
    "sem_filter",
    "sem_join",
    "sem_map",
    "sem_mask",
    "sem_rank",
    "sem_reduce",
]
