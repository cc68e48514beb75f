"""Numbering and order statistics over groups of any size.

A plain window puts a whole key into one task. Here rows are range-partitioned on (key, order), so one hot key
spreads over many tasks; each task numbers its own rows and the per-task totals (one row per task and key) are
added up afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemask.session import frozen


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str = "n") -> DataFrame:
    """Adds the 1-based position of each row within its key. `order` must not tie within a key.

    The rows are frozen once they are laid out: a position depends on the task that holds the row."""
    laid_out = frozen(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .select("*", F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().alias("_row"))
    )
    before = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        laid_out.groupBy(*keys, "_task")
        .agg(F.count(F.lit(1)).alias("_size"), F.min("_row").alias("_first"))
        .select(*keys, "_task", (F.coalesce(F.sum("_size").over(before), F.lit(0)) + 1 - F.col("_first")).alias("_shift"))
    )
    return (
        laid_out.join(shifts, [*keys, "_task"])
        .withColumn(out, F.col("_row") + F.col("_shift"))
        .drop("_task", "_row", "_shift")
    )


def running_total(df: DataFrame, keys: list[str], order: list[str], amount: str, out: str) -> DataFrame:
    """Adds the inclusive running sum of `amount` within each key, in `order` (unique within a key)."""
    laid_out = frozen(df.repartitionByRange(*keys, *order).withColumn("_task", F.spark_partition_id()))
    within = Window.partitionBy("_task", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        laid_out.groupBy("_task", *keys)
        .agg(F.sum(amount).alias("_sum"))
        .select("_task", *keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift"))
    )
    return (
        laid_out.withColumn("_within", F.sum(amount).over(within))
        .join(shifts, ["_task", *keys])
        .withColumn(out, F.col("_within") + F.col("_shift"))
        .drop("_task", "_within", "_shift")
    )


def numbered_in_key(df: DataFrame, keys: list[str], order: list[str], out: str = "n") -> DataFrame:
    """`numbered` for keys that are known to be small: a window over each. Rows with a null key drop out, as they do there."""
    return _keyed(df, keys).withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def running_total_in_key(df: DataFrame, keys: list[str], order: list[str], amount: str, out: str) -> DataFrame:
    """`running_total` for keys that are known to be small."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return _keyed(df, keys).withColumn(out, F.sum(amount).over(upto))


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropna(subset=[k for k in keys]) if keys else df


def nearest_rank_percentiles(df: DataFrame, column: str, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """One row: count, nearest-rank percentiles, max and integer mean of `column`; all null but the count when empty.

    Values are counted first, so duplicates never travel; the rank is then found by a distributed running count."""
    values = df.where(F.col(column).isNotNull())
    counts = values.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    totals = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("count"),
        F.max("v").alias("max"),
        (F.sum(F.col("v").cast("decimal(38,0)") * F.col("c"))).alias("_sum"),
    ).withColumn("mean", F.floor(F.col("_sum") / F.col("count")).cast("long"))
    ranked = running_total(counts, [], ["v"], "c", "upto")

    def at_rank(p: int) -> Column:
        rank = F.greatest(F.lit(1), F.floor((F.col("count") * p + 99) / 100))
        return F.max(F.when((F.col("upto") >= rank) & (F.col("upto") - F.col("c") < rank), F.col("v"))).alias(f"p{p}")

    picked = ranked.withColumn("count", totals.select("count").scalar()).agg(*[at_rank(p) for p in percents])
    shaped = totals.select(F.lit(0).alias("_k"), "*").join(picked.select(F.lit(0).alias("_k"), "*"), "_k")
    return shaped.select("count", *[f"p{p}" for p in percents], "max", "mean")


def nearest_rank_by(df: DataFrame, keys: list[str], column: str, percents: tuple[int, ...]) -> DataFrame:
    """`keys` and a column `p<n>` for each percentile of `column`; a key of any size is spread over many tasks."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    counts = frozen(counts)
    totals = counts.groupBy(*keys).agg(F.sum("c").alias("_count"))
    ranked = running_total(counts, keys, ["v"], "c", "upto").join(totals, keys)

    def at_rank(p: int) -> Column:
        rank = F.greatest(F.lit(1), F.floor((F.col("_count") * p + 99) / 100))
        return F.max(F.when((F.col("upto") >= rank) & (F.col("upto") - F.col("c") < rank), F.col("v"))).alias(f"p{p}")

    return ranked.groupBy(*keys).agg(*[at_rank(p) for p in percents])


def latest_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`: an aggregation with map-side partials, not a sort of the key's history."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(*df.columns)
