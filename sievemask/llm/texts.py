"""Distinct texts as a table that joins by key without moving a text again, and joins whose hot keys do not meet in one task."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemask.llm.common import work_folder, written
from sievemask.session import shared_dir

HEAVY_SHARE = 1024  # a key is heavy if it holds more than one in so many rows: there are fewer such keys than that


def text_key(*parts: Column) -> Column:
    """128-bit digest of strings; no two lists of strings are written alike."""
    return F.unhex(F.md5(F.concat(*[x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p)]).cast("binary")))


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, dealt out by `key`: a join by `key` moves the other side only."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entry = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    df.write.bucketBy(buckets, key).option("path", work_folder(spark, name)).format("parquet").saveAsTable(entry)
    held = spark.table(entry)
    held.schema  # resolved: the plan knows the files from here on
    spark.sql(f"DROP TABLE {entry}")  # the entry of an external table; its files stay
    return held


def distinct_texts(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """rows: `by` (strings without null, the last of them `text`), id. One row per distinct `by`: tid, `by`, copies, id (one of its ids).
    Copies fold before the shuffle."""
    keyed = rows.withColumn("tid", text_key(*[F.col(c) for c in by]))
    firsts = [F.first(c).alias(c) for c in by]
    return bucketed(keyed.groupBy("tid").agg(*firsts, F.count(F.lit(1)).alias("copies"), F.max("id").alias("id")), "tid", name)


def heavy_keys(counts: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Keys that hold more than a `HEAVY_SHARE`-th of `total` rows, as a table of fewer than `HEAVY_SHARE` rows."""
    return written(counts.where(F.col(count) * HEAVY_SHARE > F.lit(total)).select(*keys), "heavy-keys")


def joined_by_share(rows: DataFrame, found: DataFrame, keys: list[str], heavy: DataFrame) -> DataFrame:
    """`rows` joined with `found`, which has at most one row per key. The few heavy keys' rows of `found` go to all tasks, and rows with
    these keys stay where they are; the others are shuffled, none of their keys being large."""
    hot = rows.join(F.broadcast(found.join(F.broadcast(heavy), keys, "left_semi")), keys)
    rest = rows.join(F.broadcast(heavy), keys, "left_anti").join(found, keys)
    return hot.unionByName(rest)


def discard(*tables: DataFrame) -> None:
    """Deletes the folders of tables that `written` or `bucketed` made, when nothing that is still to run reads them."""
    for df in tables:
        spark = df.sparkSession
        shared = shared_dir(spark).rstrip("/").removeprefix("file://").removeprefix("file:")
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            if shared in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
