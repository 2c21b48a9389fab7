"""One ranking from several differently scaled scores.

Method: within each group (a query) every scorer's values are standardised by median and
median absolute deviation, turned so that more is better, squashed by the logistic
function into (0, 1), and combined as a weighted geometric mean of the bounded values.
No scorer can dominate, however long its tail is.

Medians come from mergeable quantile summaries, so a group of any size is aggregated on
the map side and never sorted or gathered in one task; they are exact below
``ACCURACY`` values and within 1/ACCURACY of the rank beyond.

Results for odd inputs: of several deliveries of (group, item, scorer) the one with the
latest arrival counts, among equal arrivals the largest score; null and NaN scores, scores of
unknown scorers and rows without a key are left out and neither help nor decide; an item
without any score has no rank; a deviation of zero gives every value that differs from the median
one full step up or down, and the median the neutral 0.5; equal results rank by the item's id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values up to which a group's medians are exact.
ACCURACY = 100_000
#: Makes the median absolute deviation estimate a normal distribution's standard deviation.
MAD_SCALE = 1.4826


def latest(df: DataFrame, keys: list[str], arrival: str, values: list[str]) -> DataFrame:
    """One row per key: the values of the latest arrival (ties: the largest values, nulls last)."""
    order = F.struct(F.col(arrival), *[F.col(v) for v in values])
    return df.groupBy(*keys).agg(F.max(order).alias("__last")).select(*keys, *[F.col(f"__last.{v}").alias(v) for v in values])


def _median(x: Column) -> Column:
    """The mean of lower and upper median, from bounded summaries."""
    low = F.percentile_approx(x, 0.5, ACCURACY)
    high = -F.percentile_approx(-x, 0.5, ACCURACY)
    return (low + high) / 2


def fuse_scores(
    scores: DataFrame,
    directions: DataFrame,
    group_col: str = "query_id",
    item_col: str = "table_ids",
    scorer_col: str = "scorer",
    score_col: str = "scores",
    arrival_col: str = "loaded_at",
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """Columns ``group_col``, ``item_col``, ``fused`` (0 to 1), ``n_scores``; one row per ranked item.

    ``directions`` has (scorer, better), ``better`` being 'high' or 'low'.
    """
    rows = scores.select(
        F.col(f"`{group_col}`").alias("g"),
        F.col(f"`{item_col}`").alias("i"),
        F.col(f"`{scorer_col}`").alias("s"),
        F.col(f"`{score_col}`").cast("double").alias("x"),
        F.col(f"`{arrival_col}`").alias("t"),
    ).filter("g is not null and i is not null and s is not null")
    sign = directions.select(
        F.col("scorer").alias("s"), F.when(F.lower(F.trim("better")) == "low", -1.0).otherwise(1.0).alias("sign")
    ).dropDuplicates(["s"])
    current = latest(rows, ["g", "s", "i"], "t", ["x"]).filter("x is not null and not isnan(x)")
    current = current.join(sign, "s").select("g", "s", "i", (F.col("x") * F.col("sign")).alias("x"))
    centre = current.groupBy("g", "s").agg(_median(F.col("x")).alias("m"))
    placed = current.join(centre, ["g", "s"]).withColumn("d", F.col("x") - F.col("m"))
    spread = placed.groupBy("g", "s").agg(_median(F.abs("d")).alias("mad"))
    z = F.when(F.col("mad") > 0, F.col("d") / (F.col("mad") * MAD_SCALE)).otherwise(F.signum("d"))
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("s") == name, float(w)).otherwise(weight)
    # log of the logistic function, without overflow for large |z|
    log_bounded = -(F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))))
    return (
        placed.join(spread, ["g", "s"])
        .select("g", "i", weight.alias("w"), log_bounded.alias("l"))
        .groupBy("g", "i")
        .agg(F.sum(F.col("w") * F.col("l")).alias("l"), F.sum("w").alias("w"), F.count("*").alias("n_scores"))
        .filter("w > 0")
        .select(
            F.col("g").alias(group_col),
            F.col("i").alias(item_col),
            F.exp(F.col("l") / F.col("w")).alias("fused"),
            "n_scores",
        )
    )


def top_ranked(fused: DataFrame, k: int, group_col: str = "query_id", item_col: str = "table_ids") -> DataFrame:
    """The first ``k`` items of every group with their ``position``; the limit is pushed below the exchange."""
    order = Window.partitionBy(group_col).orderBy(F.desc(F.round("fused", 12)), F.asc(item_col))
    return fused.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)
