"""Exact dedup: rows are grouped by a 128-bit hash of the text; texts inside a group are compared byte for byte.

The comparison is an aggregation: a group whose least and greatest text are the same holds one text. Equal texts fold
before the shuffle, so a text with millions of copies travels once per task. Only a group in which different texts met
under one hash (none is expected, ever) is grouped again by hash and text.

Defined cases: a null text counts as empty; a row with a null id takes part and stays only if its whole group has no
id; rows that repeat an id and its text stay or go together; an empty table gives no rows; further columns pass
through `deduplicated` untouched, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemask.llm.common import fresh, table, written


def md5_of(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def groups(texts: DataFrame, keep: str = "min") -> tuple[DataFrame, bool]:
    """texts: hash, id, text. One row per distinct text: hash, text, keep_id, group_size, and whether any hash stands for
    several texts. `text` is null where the hash says it all."""
    stays = (F.min if keep == "min" else F.max)("id").alias("keep_id")
    size = F.count(F.lit(1)).alias("group_size")
    folded = written(texts.groupBy("hash").agg(stays, size, (F.min("text") == F.max("text")).alias("alike")), "exact-groups")
    found = folded.where("alike").select("hash", F.lit(None).cast("string").alias("text"), "keep_id", "group_size")
    shared = folded.where(~F.col("alike")).select("hash")
    if shared.isEmpty():
        return found, False
    apart = texts.join(shared, "hash").groupBy("hash", "text").agg(stays, size)
    return written(found.unionByName(apart.select(*found.columns)), "exact-groups"), True


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hash_of=md5_of) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256. The `keep` (min or max) id of a group stays."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = docs.select(hash_of(text).alias("hash"), F.col(id_col).cast("long").alias("id"), text.alias("text"))
    found, collided = groups(hashed, keep)
    found = found.withColumnRenamed("text", "_text")
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    if collided:
        rows = hashed.join(found, "hash").where("_text is null or _text = text").select("id", digest, "keep_id", "group_size")
    else:  # texts stay where they are
        rows = hashed.select("hash", "id", digest).join(found, "hash")
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hash_of=md5_of) -> DataFrame:
    """The rows of `docs` that stay, with all their columns. They are found by (hash, id): no key is hot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found, _ = groups(docs.select(hash_of(text).alias("hash"), F.col(id_col).cast("long").alias("id"), text.alias("text")), keep)
    h, i, t = (fresh(docs, n) for n in ("hash", "id", "whole"))
    kept = found.select(F.col("hash").alias("k_hash"), F.col("keep_id").alias("k_id"), F.col("text").alias("k_text"))
    rows = docs.withColumns({h: hash_of(text), i: F.col(id_col).cast("long"), t: text})
    same = (F.col(h) == F.col("k_hash")) & F.col(i).eqNullSafe(F.col("k_id")) & (F.col("k_text").isNull() | (F.col("k_text") == F.col(t)))
    return rows.join(kept, same, "left_semi").select(*docs.columns)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(table(spark, sf_dir, "documents"), keep="max")


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

QUERIES = {"op8_exact_dedup": (op8_exact_dedup, OP8_SQL)}
