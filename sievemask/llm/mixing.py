"""Mixing sources to target weights by temperature, with DataFrame functions only.

A source's share p of all tokens becomes a weight p^a / sum(p^a). The exponent a is found by bisection on [0, 1]: the
smallest one whose mix has at most the target entropy (a share of the greatest, ln of the number of sources) and repeats no
source more often than the limit. Both conditions hold from some exponent on, so bisection applies. One job measures all
midpoints that seven steps could ask for; only those few rows reach the driver.

Weights become token budgets, and budgets become epochs: whole passes over a source, and a last one that takes blocks of
documents in the order of a seeded permutation while they fit. The block that does not fit is opened and its sub-blocks are
treated alike, 256 at a time. So a source of any size is cut by small sums, never by ordering its rows. The cut is exact to the
2^-24th part of a source, a single document for all but giant ones, and never exceeds the budget.

Defined cases: words are maximal runs of anything but white space; a null text has none; a null source is a source of its
own; a source without tokens has weight 0 and is emitted once; a null id is permuted like the id `null`; rows that repeat an
id move together; an empty table gives no rows; further columns pass through `mixed_documents` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievemask.llm.common import fresh, table, written

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS, STEPS, LEVELS = 4, 7, 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws("/", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def exponent(totals: DataFrame, entropy_share: float | None, max_repetition: float | None) -> float:
    """totals: source, tokens, share. With `max_repetition`, the least repeated source is taken once."""
    n = F.count(F.lit(1))
    z, s = F.sum("_w"), F.sum(F.col("_w") * F.ln("_w"))
    entropy = F.ln(z) - s / z  # of w / z
    spread = F.max(F.col("_w") / F.col("share")) / F.min(F.col("_w") / F.col("share"))
    fine = F.lit(True)
    if entropy_share is not None:
        fine = fine & (entropy <= entropy_share * F.ln(n))
    if max_repetition is not None:
        fine = fine & (spread <= max_repetition)
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        points = [low + (high - low) * k / 2**STEPS for k in range(1, 2**STEPS)]
        at = F.explode(F.array(*[F.lit(p) for p in points])).alias("_a")
        tried = totals.where("tokens > 0").select("share", at).withColumn("_w", F.pow("share", F.col("_a")))
        good = {r["_a"] for r in tried.groupBy("_a").agg(fine.alias("fine")).where("fine").collect()}
        for _ in range(STEPS):
            middle = (low + high) / 2
            low, high = (low, middle) if middle in good else (middle, high)
    return high


def budgets(rows: DataFrame, entropy_share: float | None = 0.98, max_repetition: float | None = 2.0, budget_tokens: int | None = None) -> DataFrame:
    """rows: id, source, tokens. One row per source: source, tokens, weight, budget, epochs (whole ones), rest (tokens of the last).

    Without `budget_tokens`, the budget is the least with which every document is taken at least once."""
    totals = written(rows.groupBy("source").agg(F.sum("tokens").alias("tokens")), "source-tokens")
    total = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    shared = totals.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    a = exponent(shared, entropy_share, max_repetition)
    powers = shared.where("tokens > 0").withColumn("_w", F.pow("share", F.lit(a)))
    z, cover = powers.agg(F.sum("_w"), F.max(F.col("share") / F.col("_w"))).first()
    z, cover = z or 1.0, cover or 1.0
    budget = float(budget_tokens) if budget_tokens is not None else total * cover * z
    weight = F.when(F.col("tokens") > 0, F.pow("share", F.lit(a)) / z).otherwise(0.0)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("long")
    planned = (
        shared.withColumn("weight", weight)
        .withColumn("budget", F.round(F.col("weight") * budget).cast("long"))
        .withColumn("epochs", whole)
        .withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0).cast("long"))
        .select("source", "tokens", "weight", "budget", "epochs", "rest")
    )
    return written(planned, "source-budgets")


def cuts(rows: DataFrame, planned: DataFrame, seed: int) -> DataFrame:
    """`planned` with `cut`: documents whose key in the last epoch begins with less are taken once more. Null: none are."""
    slim = planned.where("rest > 0").select(F.col("source").alias("_source"), "epochs", "rest")
    open_ = slim.withColumn("cut", F.lit(""))
    same = F.col("source").eqNullSafe(F.col("_source"))
    for level in range(LEVELS):
        width = 2 * level
        key = order_key(seed, F.col("epochs"), F.col("id"))
        inside = rows.join(open_, same).withColumn("_key", key).where(F.substring("_key", 1, width) == F.col("cut") if level else F.lit(True))
        blocks = inside.groupBy("_source", "epochs", "rest", F.substring("_key", 1, width + 2).alias("_block")).agg(F.sum("tokens").alias("_tokens"))
        upto = F.sum("_tokens").over(Window.partitionBy("_source").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0))
        # At most 256 rows of a source are in its window.
        crossing = blocks.withColumn("_upto", upto).where("_upto > rest")
        first = crossing.groupBy("_source", "epochs").agg(F.min_by(F.struct("_block", (F.col("rest") - F.col("_upto") + F.col("_tokens")).alias("rest")), "_block").alias("_first"))
        open_ = written(first.select("_source", "epochs", F.col("_first.rest").alias("rest"), F.col("_first._block").alias("cut")), "open-blocks")
    return planned.join(open_.select("_source", "cut"), same, "left").drop("_source")


def copies(planned: DataFrame, seed: int) -> Column:
    """How often a row with the columns epochs, cut and id is taken."""
    last = F.substring(order_key(seed, F.col("epochs"), F.col("id")), 1, 2 * LEVELS) < F.col("cut")
    return F.col("epochs") + F.coalesce(last, F.lit(False)).cast("long")


def _slim(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return written(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("tokens")), "document-tokens")


def mixed(
    docs: DataFrame, entropy_share: float | None = 0.98, max_repetition: float | None = 2.0, budget_tokens: int | None = None, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row for each time a document is taken: doc_id, source, epoch, block (0 to 255: its place in that epoch), n_tokens."""
    rows = _slim(docs, id_col, text_col, source_col)
    planned = written(cuts(rows, budgets(rows, entropy_share, max_repetition, budget_tokens), seed), "source-cuts")
    by_source = planned.select(F.col("source").alias("_source"), "epochs", "cut")
    taken = rows.join(by_source, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_n", copies(planned, seed)).where("_n > 0")
    each = taken.select("id", "source", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("epoch"))
    block = F.conv(F.substring(order_key(seed, F.col("epoch"), F.col("id")), 1, 2), 16, 10).cast("long")
    return each.select(F.col("id").alias("doc_id"), "source", "epoch", block.alias("block"), F.col("tokens").alias("n_tokens"))


def mixed_documents(
    docs: DataFrame, entropy_share: float | None = 0.98, max_repetition: float | None = 2.0, budget_tokens: int | None = None, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The rows of `docs`, each as often as it is taken. Texts are not shuffled: a row only meets its source's cut."""
    rows = _slim(docs, id_col, text_col, source_col)
    planned = written(cuts(rows, budgets(rows, entropy_share, max_repetition, budget_tokens), seed), "source-cuts")
    whole = fresh(docs, "whole")
    each = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"))
    by_source = planned.select(F.col("source").alias("_source"), "epochs", "cut")
    taken = each.join(by_source, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_n", copies(planned, seed)).where("_n > 0")
    return taken.select(whole, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_i")).select(f"{whole}.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


_KEY = "md5(concat_ws('/', '17', {e}::VARCHAR, coalesce(doc_id::VARCHAR, 'null')))"
OP2_SQL = f"""
WITH RECURSIVE r AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n FROM documents),
s AS (SELECT source, sum(n)::BIGINT AS tokens, sum(n) / greatest((SELECT sum(n) FROM r), 1)::DOUBLE AS p FROM r GROUP BY source),
ps AS (SELECT list(p) AS ps FROM s WHERE tokens > 0),
bis(i, low, high) AS (
    SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
    UNION ALL
    SELECT i + 1, CASE WHEN good THEN low ELSE middle END, CASE WHEN good THEN middle ELSE high END FROM (
        SELECT *, ln(list_sum(ws)) - list_sum(list_transform(ws, lambda w: w * ln(w))) / list_sum(ws) <= 0.98 * ln(len(ps))
                  AND list_max(list_transform(ps, lambda p: pow(p, middle) / p)) / list_min(list_transform(ps, lambda p: pow(p, middle) / p)) <= 2.0 AS good
        FROM (SELECT i, low, high, ps, (low + high) / 2 AS middle, list_transform(ps, lambda p: pow(p, (low + high) / 2)) AS ws FROM bis, ps WHERE i < 28))),
a AS (SELECT high AS a FROM bis WHERE i = 28),
z AS (SELECT sum(pow(p, a)) AS z, max(p / pow(p, a)) AS cover FROM s, a WHERE tokens > 0),
b AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN round(pow(p, a) / z * ((SELECT sum(n) FROM r) * cover * z))::BIGINT ELSE 0 END AS budget FROM s, a, z),
e AS (SELECT source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS epochs, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM b),
k AS (SELECT r.*, epochs, rest, substr({_KEY.format(e="epochs")}, 1, 6) AS k FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source),
c AS (SELECT source, k, sum(sum(n)) OVER (PARTITION BY source ORDER BY k) <= any_value(rest) AND any_value(rest) > 0 AS more FROM k GROUP BY source, k),
t AS (SELECT k.doc_id, k.source, k.n, unnest(range(epochs + more::INT)) AS epoch FROM k JOIN c ON k.source IS NOT DISTINCT FROM c.source AND k.k = c.k)
SELECT doc_id, source, epoch, ('0x' || substr({_KEY.format(e="epoch")}, 1, 2))::BIGINT AS block, n AS n_tokens FROM t
"""

QUERIES = {"op2_mixing": (op2_mixing, OP2_SQL)}
