"""Joins whose common keys do not meet in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemask.session import frozen

SHARE = 1024  # a key is common if it holds more than one in so many rows; fewer than that many keys can
FEW = 4096  # rows of a key that a task takes without harm, however few rows there are in all


def common_keys(rows: DataFrame, keys: list[str], share: int = SHARE, few: int = 0) -> DataFrame:
    """Keys that hold more than a `share`-th of the rows, and more than `few`: fewer than `share` of them, counted with map-side partials."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    return counts.join(F.broadcast(total), (F.col("_n") * share > F.col("_all")) & (F.col("_n") > few)).select(*keys)


def by_size(rows: DataFrame, keys: list[str], small: Callable[[DataFrame], DataFrame], large: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`small` of the rows of all keys but the common ones, whose rows go to `large`. What `small` gathers of a key stays below a SHARE-th of the
    rows, or FEW; mostly no key is common, and `large`, which spreads a key over many tasks, is not run at all. `rows` should be at rest."""
    common = frozen(common_keys(rows.where(" and ".join(f"`{k}` is not null" for k in keys)), keys, SHARE, FEW))
    if common.isEmpty():
        return small(rows)
    common = F.broadcast(common)
    return small(rows.join(common, keys, "left_anti")).unionByName(large(rows.join(common, keys, "left_semi")))


def joined_spread(rows: DataFrame, found: DataFrame, keys: list[str], share: int = SHARE, at_rest: bool = False) -> DataFrame:
    """`rows` joined with `found`, which has at most one row per key (without null).

    The entries of common keys, fewer than `share` rows, go to all tasks, and the rows that hold such a key stay where they are; the other
    rows are shuffled, none of their keys being large. Rows are read three times, and frozen for that unless they are `at_rest`."""
    held = rows if at_rest else frozen(rows)
    common = frozen(common_keys(held, keys, share))
    entries = F.broadcast(found.join(F.broadcast(common), keys, "left_semi"))
    rest = held.join(F.broadcast(common), keys, "left_anti")
    return held.join(entries, keys).unionByName(rest.join(found, keys))
