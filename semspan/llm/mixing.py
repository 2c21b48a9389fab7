"""Mixing sources to target weights.

Method: Pfair scheduling. Every source's records, in a seeded order and repeated at most
``max_uses`` times, form a stream that is cut into blocks of ``block_tokens``. Block j of a source
of weight w may run from slot floor(j / w) and must run before ceil((j + 1) / w); of the blocks
that may run, the one of earliest deadline runs. With weights that sum to one every block
meets its window, so at any point of the mix each source is within one block of its share, taken as a whole number
of 1/``PERIOD``. Against the share as given, the place of a block can drift by up to half a slot in each period;
how much of a source is mixed does not drift, since its stream ends at its quota.

Weights are rounded to 1/``PERIOD``, so the schedule repeats after ``PERIOD`` slots: only that many
slots are ever simulated, and the slot of any block of a corpus of any size follows by
arithmetic. A record's place in its stream is a prefix sum in two levels (ranges of a hash,
then within a range), so no source, however large, is ordered in one task.

With T the tokens of all records of the sources, a source whose records, each used ``max_uses``
times, fall short of its share of T is not ``reachable``. The mix keeps the target shares: it is as
large as the scarcest source that has records allows, T at most. With ``keep_shares=False`` it has T
tokens, of which unreachable sources give all they have. The shares really reached are reported.

Results for odd inputs: sources match only as spelt; a null or unlisted source is left out; a text
without tokens is never placed; a source without records reaches nothing; null or negative
``max_uses`` count as 0, a null share as 0; of several lines of one source in the targets the first by
share and uses counts; repeated rows are records of their own.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semspan.llm import tokenizer as tk
from semspan.runtime import reliable_checkpoint

#: Slots after which the schedule repeats, and the unit of the weights.
PERIOD = 10_000
BLOCK_TOKENS = 8_192
#: Ranges of the order's hash whose sums give the first level of the prefix sum.
RANGES = 4_096


def pfair_slots(weights: dict[str, int], period: int = PERIOD) -> dict[str, list[int]]:
    """Slots of each source's blocks in one period; ``weights`` are whole numbers that sum to ``period``."""
    sources = sorted(s for s, n in weights.items() if n > 0)
    waiting = [(0, i, 0) for i in range(len(sources))]  # release, source, block
    ready: list[tuple[int, int, int]] = []
    slots: dict[str, list[int]] = {s: [] for s in sources}
    heapq.heapify(waiting)
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, i, j = heapq.heappop(waiting)
            n = weights[sources[i]]
            heapq.heappush(ready, (-(-(j + 1) * period // n), i, j))
        if not ready:
            continue
        _, i, j = heapq.heappop(ready)
        n = weights[sources[i]]
        slots[sources[i]].append(t)
        if j + 1 < n:
            heapq.heappush(waiting, ((j + 1) * period // n, i, j + 1))
    return slots


def whole_weights(shares: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Shares as whole numbers that sum to ``period``, by largest remainder, at least 1 for a positive share."""
    total = sum(shares.values())
    if sum(v > 0 for v in shares.values()) > period:
        raise ValueError(f"more than {period} sources have a share; take a longer period")
    if total <= 0:
        return {s: 0 for s in shares}
    exact = {s: v / total * period for s, v in shares.items()}
    whole = {s: max(int(v), 1) if v > 0 else 0 for s, v in exact.items()}
    order = sorted(shares, key=lambda s: (whole[s] - exact[s], s))
    k = 0
    while (rest := period - sum(whole.values())) != 0:
        s = order[k % len(order)] if rest > 0 else order[-1 - k % len(order)]
        if rest > 0 and whole[s] > 0:
            whole[s] += 1
        elif rest < 0 and whole[s] > 1:
            whole[s] -= 1
        k += 1
    return whole


def sized_records(
    docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """(id, source, tokens) of every record whose source has a target; written once, since encoding is the costly part."""
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{text_col}`").alias("text")
    )
    listed = rows.join(targets.select("source").distinct(), "source", "left_semi")
    return reliable_checkpoint(tk.count_tokens(listed, "id", "text", keep=["source"]))


def source_plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: records, tokens, quota (target_share of T), capacity and whether it is ``reachable``."""
    wanted = targets.filter("source is not null").groupBy("source").agg(
        F.min(
            F.struct(
                F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
                F.greatest(F.coalesce("max_uses", F.lit(0)), F.lit(0)).alias("max_uses"),
            )
        ).alias("t")
    )
    have = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("records"))
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total")).scalar()
    return (
        wanted.select("source", "t.*")
        .join(have, "source", "left")
        .na.fill(0, ["tokens", "records"])
        .withColumn("quota", F.col("target_share") * total)
        .withColumn("capacity", F.col("tokens") * F.col("max_uses"))
        .withColumn("reachable", F.col("capacity") >= F.col("quota"))
    )


def mix(
    sized: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = 7, keep_shares: bool = True
) -> DataFrame:
    """One row per use of a record: id, source, ``use`` from 1, tokens, ``slot`` and ``start`` (its place in its stream).

    Ordered by (slot, start) the rows are the mix.
    """
    # The targets are a small table of fixed size: one row per source.
    sources = source_plan(sized, targets).collect()
    weights = whole_weights({r["source"]: r["target_share"] for r in sources})
    scale = 1.0
    if keep_shares:
        scale = min([1.0, *(r["capacity"] / r["quota"] for r in sources if r["quota"] > 0 and r["capacity"] > 0)])
    quotas = [
        (r["source"], min(r["quota"] * scale, float(r["capacity"])), r["max_uses"], r["tokens"]) for r in sources
    ]
    slots = pfair_slots(weights)
    spark = sized.sparkSession
    table = spark.createDataFrame(
        [(s, weights[s], slots[s]) for s in slots] or [("", 1, [0])], "source string, per_period int, slots array<int>"
    )
    quota = spark.createDataFrame(
        quotas or [("", 0.0, 0, 0)], "source string, quota double, max_uses int, source_tokens long"
    )
    rounds = F.when(F.col("source_tokens") > 0, F.ceil(F.col("quota") / F.col("source_tokens"))).otherwise(0)
    uses = (
        sized.filter("tokens > 0")
        .join(quota, "source")
        .withColumn("rounds", F.least(F.col("max_uses").cast("long"), rounds.cast("long")))
        .filter("rounds > 0")
        .select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rounds"))).alias("use"))
        .withColumn("h", F.xxhash64("id", "use", F.lit(seed)))
        .withColumn("range", F.shiftright(F.col("h"), 52) + F.lit(RANGES // 2))
    )
    sums = uses.groupBy("source", "use", "range").agg(F.sum("tokens").alias("range_tokens"))
    before = Window.partitionBy("source", "use").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("range_start", F.coalesce(F.sum("range_tokens").over(before), F.lit(0))).drop("range_tokens")
    inside = Window.partitionBy("source", "use", "range").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        uses.join(starts, ["source", "use", "range"])
        .withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
        .withColumn("start", (F.col("use") - 1) * F.col("source_tokens") + F.col("range_start") + F.col("inside"))
        .filter("start < quota")
        .withColumn("block", F.floor(F.col("start") / block_tokens))
    )
    return placed.join(table, "source").select(
        "id",
        "source",
        F.col("use").cast("int").alias("use"),
        "tokens",
        (
            F.floor(F.col("block") / F.col("per_period")) * PERIOD
            + F.get("slots", (F.col("block") % F.col("per_period")).cast("int"))
        ).alias("slot"),
        "start",
    )


def mix_report(sized: DataFrame, targets: DataFrame, mixed: DataFrame) -> DataFrame:
    """Per source: target and reached share, records, uses and tokens of the mix, the most uses of a record."""
    used = (
        mixed.groupBy("source", "id")
        .agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
        .groupBy("source")
        .agg(F.sum("tokens").alias("mix_tokens"), F.sum("n").alias("uses"), F.max("n").alias("most_uses"))
    )
    total = used.agg(F.sum("mix_tokens").alias("total")).scalar()
    return (
        source_plan(sized, targets)
        .join(used, "source", "left")
        .na.fill(0, ["mix_tokens", "uses", "most_uses"])
        .select(
            "source",
            "target_share",
            "max_uses",
            "reachable",
            "records",
            "tokens",
            "mix_tokens",
            "uses",
            "most_uses",
            F.round(F.coalesce(F.col("mix_tokens") / total, F.lit(0.0)), 6).alias("reached_share"),
        )
    )


def short_sources(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source) whose blocks run out before its quota in the mix of full size; the exact sums confirm every one."""
    mixed = mix(sized, targets, keep_shares=False)
    reached = mixed.filter("slot is not null").groupBy("source").agg(F.sum("tokens").alias("mix_tokens"))
    planned = source_plan(sized, targets).join(reached, "source", "left").na.fill(0, ["mix_tokens"])
    return planned.filter("mix_tokens < quota and not reachable").select("source")
