"""Queries for scoring: orders as samples, their line items as gold and predicted spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievemask.functions.spans import overlap
from sievemask.operators import scoring as S
from sievemask.plans.common import big, table
from sievemask.schemas import PREDICTED, SPAN


def samples_and_records(spark, sf):
    """A sample per order with line items; every seventh is a hard negative without gold.

    A line item is a gold span; its prediction is shifted by at most two characters, and may have another type, an
    unmapped label, or be missing. Some records failed and some samples have none."""
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"),
        F.struct(
            (F.col("l_linenumber") * 20).alias("start"), (F.col("l_linenumber") * 20 + 10).alias("end"),
            F.element_at(F.array(F.lit("PAN"), F.lit("PHONE"), F.lit("EMAIL")), F.col("l_linenumber") % 3 + 1).alias("entity"),
        ).alias("g"),
        F.when(
            F.col("l_returnflag") != "R",
            F.struct(
                (F.col("l_linenumber") * 20 + F.col("l_suppkey") % 3).cast("int").alias("start"),
                (F.col("l_linenumber") * 20 + 10 + F.col("l_partkey") % 2).cast("int").alias("end"),
                F.when(F.col("l_tax") > 0.06, "IFSC").when(
                    F.col("l_linestatus") == "F",
                    F.element_at(F.array(F.lit("PAN"), F.lit("PHONE"), F.lit("EMAIL")), F.col("l_linenumber") % 3 + 1),
                ).when(F.col("l_discount") > 0.05, "PAN").alias("mapped"),
                F.when(
                    (F.col("l_tax") <= 0.06) & (F.col("l_linestatus") != "F") & (F.col("l_discount") <= 0.05),
                    F.concat(F.lit("X_"), F.col("l_linenumber").cast("string")),
                ).alias("unmapped"),
            ),
        ).alias("p"),
    )
    # A group is one order's lines.
    spans = lines.groupBy("k").agg(
        F.sort_array(F.collect_list("g")).alias("gold"), F.sort_array(F.collect_list("p")).alias("predicted")
    )
    o = table(spark, sf, "orders").join(spans, F.col("o_orderkey") == F.col("k"), "left")
    decoy = F.element_at(F.array(F.lit("PAN"), F.lit("IFSC"), F.lit("EMAIL")), (F.col("o_custkey") % 3 + 1).cast("int"))
    negative = F.col("o_orderkey") % 7 == 0
    none = lambda t: F.array().cast(f"array<{t}>")
    samples = o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.lit("").alias("text"),
        F.struct(
            F.when(negative, "hard_negative").otherwise("positive").alias("kind"),
            F.when(~negative, F.coalesce("gold", none(SPAN))).alias("spans"), F.when(negative, decoy).alias("decoy"),
        ).alias("labels"),
        F.element_at(F.array(*[F.lit(x) for x in ("en", "hi-Latn", "hi-Deva", "mixed")]), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("lang"),
        F.element_at(F.array(*[F.lit(x) for x in ("easy", "medium", "hard")]), (F.col("o_custkey") % 3 + 1).cast("int")).alias("difficulty"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "handwritten").otherwise("template").alias("source"),
        F.lit("1").alias("generator_version"),
    )
    failed = F.col("o_orderpriority") == "5-LOW"
    records = o.where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").cast("string").alias("sample_id"), F.when(failed, "failed").otherwise("detected").alias("status"),
        F.when(~failed, F.coalesce("predicted", none(PREDICTED))).alias("predicted"),
        F.when(~failed, big(F.round(F.col("o_totalprice") * 100))).alias("elapsed_ns"),
        F.when(~failed, big(F.round(F.col("o_totalprice") * 100)) + F.col("o_custkey")).alias("wall_ns"),
        F.when(failed, "boom").alias("message"),
    )
    return samples, records


Q_BASE = """
o AS (SELECT *, o_orderkey % 7 = 0 AS negative, o_orderpriority = '5-LOW' AS failed, o_orderstatus <> 'P' AS recorded,
  (['en', 'hi-Latn', 'hi-Deva', 'mixed'])[(o_orderkey % 4 + 1)::INT] AS lang, (['easy', 'medium', 'hard'])[(o_custkey % 3 + 1)::INT] AS difficulty,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'handwritten' ELSE 'template' END AS source,
  (['PAN', 'IFSC', 'EMAIL'])[(o_custkey % 3 + 1)::INT] AS decoy FROM orders),
l AS (SELECT o.*, l_linenumber * 20 AS gs, l_linenumber * 20 + 10 AS ge, (['PAN', 'PHONE', 'EMAIL'])[(l_linenumber % 3 + 1)::INT] AS gt,
  l_returnflag <> 'R' AND NOT failed AS predicted, l_linenumber * 20 + l_suppkey % 3 AS ps, l_linenumber * 20 + 10 + l_partkey % 2 AS pe,
  CASE WHEN l_tax > 0.06 THEN 'IFSC' WHEN l_linestatus = 'F' THEN (['PAN', 'PHONE', 'EMAIL'])[(l_linenumber % 3 + 1)::INT]
    WHEN l_discount > 0.05 THEN 'PAN' END AS mapped, 'X_' || l_linenumber AS label
  FROM lineitem JOIN o ON l_orderkey = o_orderkey WHERE recorded),
-- Every prediction meets at most the gold span of its own line: lines are twenty characters apart.
facts AS (SELECT o_orderkey, lang, difficulty, source, gt AS entity, mode, 'g' AS side, NOT negative AS counts,
    predicted AND mapped = gt AND (mode = 'relaxed' OR (gs = ps AND ge = pe)) AS hit FROM l, (VALUES ('strict'), ('relaxed')) AS x(mode)
  UNION ALL SELECT o_orderkey, lang, difficulty, source, mapped, mode, 'p', predicted AND mapped IS NOT NULL,
    NOT negative AND mapped = gt AND (mode = 'relaxed' OR (gs = ps AND ge = pe)) FROM l, (VALUES ('strict'), ('relaxed')) AS x(mode)),
counted AS (SELECT *, CASE WHEN side = 'g' AND coalesce(hit, false) THEN 1 ELSE 0 END AS tp,
  CASE WHEN side = 'p' AND NOT coalesce(hit, false) THEN 1 ELSE 0 END AS fp,
  CASE WHEN side = 'g' AND NOT coalesce(hit, false) THEN 1 ELSE 0 END AS fn FROM facts WHERE counts)"""


def _scored(spark, sf):
    return S.joined(*samples_and_records(spark, sf))


def counts_by_sample(spark, sf):
    return S.sample_counts(_scored(spark, sf)).select("sample_id", "entity", "mode", big("tp").alias("tp"), big("fp").alias("fp"), big("fn").alias("fn"))


Q_BY_SAMPLE = f"WITH {Q_BASE} SELECT o_orderkey::VARCHAR AS sample_id, entity, mode, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM counted GROUP BY 1, 2, 3"


def score_totals(spark, sf):
    return S.with_rates(S.totals(_scored(spark, sf))).select(
        "dimension", "value", "mode", big("tp").alias("tp"), big("fp").alias("fp"), big("fn").alias("fn"), "precision", "recall", "f1"
    )


_Q_DIMS = "SELECT mode, {v} AS value, '{d}' AS dimension, tp, fp, fn FROM counted"
Q_TOTALS = f"""WITH {Q_BASE},
every AS (SELECT lang, difficulty, source, mode, 0 AS tp, 0 AS fp, 0 AS fn FROM o, (VALUES ('strict'), ('relaxed')) AS x(mode) WHERE recorded),
rows AS (SELECT mode, '' AS value, 'micro' AS dimension, tp, fp, fn FROM counted UNION ALL SELECT mode, entity, 'entity', tp, fp, fn FROM counted
  UNION ALL SELECT mode, lang, 'lang', tp, fp, fn FROM counted UNION ALL SELECT mode, difficulty, 'difficulty', tp, fp, fn FROM counted
  UNION ALL SELECT mode, source, 'source', tp, fp, fn FROM counted
  UNION ALL SELECT mode, lang, 'lang', tp, fp, fn FROM every UNION ALL SELECT mode, difficulty, 'difficulty', tp, fp, fn FROM every
  UNION ALL SELECT mode, source, 'source', tp, fp, fn FROM every),
s AS (SELECT dimension, value, mode, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM rows GROUP BY 1, 2, 3)
SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END AS f1 FROM s"""


def entity_rates(spark, sf):
    t = S.entity_table(S.totals(_scored(spark, sf)))
    return t.select("entity", big("gold").alias("gold"), *[c for c in t.columns if c not in ("entity", "gold")])


Q_ENTITY = f"""WITH {Q_BASE}, s AS (SELECT entity, mode, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM counted GROUP BY 1, 2),
r AS (SELECT entity, mode, tp, fn, CASE WHEN tp + fp > 0 THEN (tp / (tp + fp))::DOUBLE END AS p, CASE WHEN tp + fn > 0 THEN (tp / (tp + fn))::DOUBLE END AS r,
  CASE WHEN 2 * tp + fp + fn > 0 THEN (2 * tp / (2 * tp + fp + fn))::DOUBLE END AS f1 FROM s)
SELECT a.entity, (b.tp + b.fn)::BIGINT AS gold, a.p AS strict_p, a.r AS strict_r, a.f1 AS strict_f1, b.p AS relaxed_p, b.r AS relaxed_r, b.f1 AS relaxed_f1
FROM r a JOIN r b ON a.entity = b.entity AND a.mode = 'strict' AND b.mode = 'relaxed'"""


def decoy_flags(spark, sf):
    return S.hard_negatives(_scored(spark, sf)).select("decoy", *[big(c).alias(c) for c in ("samples", "flagged_as_decoy_type", "flagged_any")])


Q_PER_ORDER = """per AS (SELECT o_orderkey, bool_or(predicted AND mapped = decoy) AS as_decoy, bool_or(predicted) AS any_flag FROM l GROUP BY 1),
neg AS (SELECT decoy, count(*) AS samples, count(*) FILTER (as_decoy) AS flagged_as_decoy_type, count(*) FILTER (any_flag) AS flagged_any
  FROM o LEFT JOIN per USING (o_orderkey) WHERE negative AND recorded GROUP BY 1)"""
Q_DECOYS = f"WITH {Q_BASE}, {Q_PER_ORDER} SELECT * FROM neg"


def decoy_rate(spark, sf):
    return S.hard_negative_rate(S.hard_negatives(_scored(spark, sf))).select(big("samples").alias("samples"), big("flagged").alias("flagged"), "rate")


Q_DECOY_RATE = f"WITH {Q_BASE}, {Q_PER_ORDER} SELECT sum(samples)::BIGINT AS samples, sum(flagged_as_decoy_type)::BIGINT AS flagged, (sum(flagged_as_decoy_type) / sum(samples))::DOUBLE AS rate FROM neg"


def loose_labels(spark, sf):
    return S.unmapped_labels(_scored(spark, sf)).select("label", big("predictions").alias("predictions"), big("overlapping_gold").alias("overlapping_gold"))


Q_LOOSE = f"WITH {Q_BASE} SELECT label, count(*) AS predictions, count(*) FILTER (NOT negative) AS overlapping_gold FROM l WHERE predicted AND mapped IS NULL GROUP BY 1"


def sample_coverage(spark, sf):
    samples, records = samples_and_records(spark, sf)
    c = S.coverage(samples, records)
    return c.select(*[big(x).alias(x) for x in ("evaluated", "missing", "failed")])


Q_COVERAGE = f"WITH {Q_BASE} SELECT count(*) FILTER (recorded) AS evaluated, count(*) FILTER (NOT recorded) AS missing, count(*) FILTER (recorded AND failed) AS failed FROM o"


def samples_without_records(spark, sf):
    return S.missing_samples(*samples_and_records(spark, sf))


def records_that_do_not_fit(spark, sf):
    """Records of every order, some twice, against the samples of even orders."""
    samples, records = samples_and_records(spark, sf)
    twice = records.where(F.col("sample_id").cast("long") % 10 == 0)
    return S.record_problems(samples.where(F.col("id").cast("long") % 2 == 0), records.unionByName(twice))


Q_MISFITS = f"""WITH {Q_BASE} SELECT o_orderkey::VARCHAR AS sample_id, 'unknown sample' AS problem FROM o WHERE recorded AND o_orderkey % 2 = 1
UNION ALL SELECT o_orderkey::VARCHAR, 'repeated record' FROM o WHERE recorded AND o_orderkey % 10 = 0"""


def detection_latency(spark, sf):
    _, records = samples_and_records(spark, sf)
    t = S.latency(records)
    return t.select("clock", *[big(c).alias(c) for c in ("count", "p50", "p95", "p99", "max", "mean")])


Q_LATENCY = """WITH t AS (SELECT 'tool' AS clock, round(o_totalprice * 100)::BIGINT AS ns FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'
  UNION ALL SELECT 'wall', round(o_totalprice * 100)::BIGINT + o_custkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'),
r AS (SELECT *, row_number() OVER (PARTITION BY clock ORDER BY ns) AS i, count(*) OVER (PARTITION BY clock) AS n FROM t)
SELECT clock, count(*) AS count, max(ns) FILTER (i = (50 * n + 99) // 100) AS p50, max(ns) FILTER (i = (95 * n + 99) // 100) AS p95,
  max(ns) FILTER (i = (99 * n + 99) // 100) AS p99, max(ns) AS max, (sum(ns) // count(*))::BIGINT AS mean FROM r GROUP BY 1"""


def summary_of_run(spark, sf):
    t = S.run_summary(*samples_and_records(spark, sf))
    return t.select(
        *[big(c).alias(c) for c in ("evaluated", "missing", "failed", "tool_p50_ns", "tool_p95_ns", "wall_p50_ns")],
        "samples", "strict_f1", "relaxed_f1", "relaxed_p", "relaxed_r", "hard_negative_rate",
    )


Q_SUMMARY = f"""WITH {Q_BASE}, {Q_PER_ORDER}, lat AS ({Q_LATENCY}),
s AS (SELECT mode, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM counted GROUP BY 1),
c AS (SELECT count(*) FILTER (recorded) AS evaluated, count(*) FILTER (NOT recorded) AS missing, count(*) FILTER (recorded AND failed) AS failed FROM o)
SELECT evaluated, missing, failed, (SELECT p50 FROM lat WHERE clock = 'tool') AS tool_p50_ns, (SELECT p95 FROM lat WHERE clock = 'tool') AS tool_p95_ns,
  (SELECT p50 FROM lat WHERE clock = 'wall') AS wall_p50_ns, evaluated || ' of ' || (evaluated + missing) AS samples,
  (SELECT (2 * tp / (2 * tp + fp + fn))::DOUBLE FROM s WHERE mode = 'strict') AS strict_f1, (SELECT (2 * tp / (2 * tp + fp + fn))::DOUBLE FROM s WHERE mode = 'relaxed') AS relaxed_f1,
  (SELECT (tp / (tp + fp))::DOUBLE FROM s WHERE mode = 'relaxed') AS relaxed_p, (SELECT (tp / (tp + fn))::DOUBLE FROM s WHERE mode = 'relaxed') AS relaxed_r,
  (SELECT (sum(flagged_as_decoy_type) / sum(samples))::DOUBLE FROM neg) AS hard_negative_rate FROM c"""


def summaries_of_runs(spark, sf):
    """Runs of all customers in one job: an order's record belongs to the run of its customer."""
    samples, records = samples_and_records(spark, sf)
    owner = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("sample_id"), F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("run_id"))
    t = S.run_summaries(samples, records.join(owner, "sample_id"))
    return t.select("run_id", *[big(c).alias(c) for c in ("evaluated", "missing", "failed", "tool_p50_ns", "tool_p95_ns", "wall_p50_ns")], "strict_f1", "relaxed_f1", "relaxed_p", "relaxed_r", "hard_negative_rate")


Q_SUMMARIES = f"""WITH {Q_BASE}, per AS (SELECT o_orderkey, bool_or(predicted AND mapped = decoy) AS as_decoy FROM l GROUP BY 1),
t AS (SELECT o_custkey AS k, round(o_totalprice * 100)::BIGINT AS tool, round(o_totalprice * 100)::BIGINT + o_custkey AS wall FROM o WHERE recorded AND NOT failed),
rk AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY tool) AS i, row_number() OVER (PARTITION BY k ORDER BY wall) AS j, count(*) OVER (PARTITION BY k) AS n FROM t),
lat AS (SELECT k, max(tool) FILTER (i = greatest(1, (50 * n + 99) // 100)) AS a, max(tool) FILTER (i = greatest(1, (95 * n + 99) // 100)) AS b, max(wall) FILTER (j = greatest(1, (50 * n + 99) // 100)) AS c FROM rk GROUP BY 1),
m AS (SELECT o_custkey AS k, mode, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM counted JOIN o USING (o_orderkey) GROUP BY 1, 2),
e AS (SELECT o_custkey AS k, count(*) AS evaluated, count(*) FILTER (failed) AS failed, count(*) FILTER (negative) AS negatives, count(*) FILTER (negative AND as_decoy) AS flagged
  FROM o LEFT JOIN per USING (o_orderkey) WHERE recorded GROUP BY 1)
SELECT 'r' || e.k AS run_id, evaluated, (SELECT count(*) FROM orders) - evaluated AS missing, e.failed AS failed, lat.a AS tool_p50_ns, lat.b AS tool_p95_ns, lat.c AS wall_p50_ns,
  (2 * s.tp / nullif(2 * s.tp + s.fp + s.fn, 0))::DOUBLE AS strict_f1, (2 * r.tp / nullif(2 * r.tp + r.fp + r.fn, 0))::DOUBLE AS relaxed_f1,
  (r.tp / nullif(r.tp + r.fp, 0))::DOUBLE AS relaxed_p, (r.tp / nullif(r.tp + r.fn, 0))::DOUBLE AS relaxed_r, (flagged / nullif(negatives, 0))::DOUBLE AS hard_negative_rate
FROM e LEFT JOIN m s ON s.k = e.k AND s.mode = 'strict' LEFT JOIN m r ON r.k = e.k AND r.mode = 'relaxed' LEFT JOIN lat ON lat.k = e.k"""


def overlap_lengths(spark, sf):
    line = table(spark, sf, "lineitem")
    a = F.struct((F.col("l_partkey") % 50).alias("start"), (F.col("l_partkey") % 50 + 10).alias("end"))
    b = F.struct((F.col("l_suppkey") % 50).alias("start"), (F.col("l_suppkey") % 50 + 7).alias("end"))
    return line.select(overlap(a, b).alias("overlap")).groupBy("overlap").agg(big(F.count(F.lit(1))).alias("n")).select(big("overlap").alias("overlap"), "n")


Q_OVERLAP = """SELECT greatest(0, least(l_partkey % 50 + 10, l_suppkey % 50 + 7) - greatest(l_partkey % 50, l_suppkey % 50))::BIGINT AS overlap, count(*) AS n
FROM lineitem GROUP BY 1"""


def crowded_matches(spark, sf):
    """Spans of an order that overlap several others: the greedy one-to-one choice decides."""
    line = table(spark, sf, "lineitem")
    spans = line.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct((F.col("l_partkey") % 40).cast("int").alias("start"), (F.col("l_partkey") % 40 + 12).cast("int").alias("end"), F.lit("PAN").alias("entity")))).alias("gold"),
        F.sort_array(F.collect_list(F.struct((F.col("l_suppkey") % 40).cast("int").alias("start"), (F.col("l_suppkey") % 40 + 9).cast("int").alias("end"), F.lit("PAN").alias("entity")))).alias("found"),
    )
    m = S.match_spans(F.col("gold"), F.col("found"))
    return spans.select("l_orderkey", F.explode(m).alias("m")).groupBy("l_orderkey").agg(
        *[big(F.sum(f"m.{c}")).alias(c) for c in ("gold", "predicted", "strict", "relaxed")]
    )


# The greedy choice as a recursion: take the best pair left, drop every pair that shares a side with it.
Q_CROWDED = """
WITH RECURSIVE g AS (SELECT l_orderkey AS k, l_partkey % 40 AS s, l_partkey % 40 + 12 AS e, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 40) AS i FROM lineitem),
p AS (SELECT l_orderkey AS k, l_suppkey % 40 AS s, l_suppkey % 40 + 9 AS e, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 40) AS i FROM lineitem),
pairs AS (SELECT g.k, list({'o': -(least(g.e, p.e) - greatest(g.s, p.s)), 'g': g.i, 'p': p.i} ORDER BY -(least(g.e, p.e) - greatest(g.s, p.s)), g.i, p.i) AS ps
  FROM g JOIN p ON g.k = p.k AND least(g.e, p.e) > greatest(g.s, p.s) GROUP BY 1),
walk AS (SELECT k, ps, 0 AS n FROM pairs UNION ALL
  SELECT k, list_filter(ps, lambda x: x.g <> ps[1].g AND x.p <> ps[1].p), n + 1 FROM walk WHERE len(ps) > 0),
best AS (SELECT k, max(n) AS relaxed FROM walk GROUP BY 1)
SELECT l_orderkey, count(*) AS gold, count(*) AS predicted, 0::BIGINT AS strict, coalesce(max(relaxed), 0)::BIGINT AS relaxed
FROM lineitem LEFT JOIN best ON k = l_orderkey GROUP BY 1"""

QUERIES = {
    "counts_by_sample": (counts_by_sample, Q_BY_SAMPLE),
    "score_totals": (score_totals, Q_TOTALS),
    "entity_rates": (entity_rates, Q_ENTITY),
    "decoy_flags": (decoy_flags, Q_DECOYS),
    "decoy_rate": (decoy_rate, Q_DECOY_RATE),
    "loose_labels": (loose_labels, Q_LOOSE),
    "sample_coverage": (sample_coverage, Q_COVERAGE),
    "samples_without_records": (samples_without_records, f"WITH {Q_BASE} SELECT o_orderkey::VARCHAR AS sample_id FROM o WHERE NOT recorded"),
    "records_that_do_not_fit": (records_that_do_not_fit, Q_MISFITS),
    "detection_latency": (detection_latency, Q_LATENCY),
    "summary_of_run": (summary_of_run, Q_SUMMARY),
    "summaries_of_runs": (summaries_of_runs, Q_SUMMARIES),
    "overlap_lengths": (overlap_lengths, Q_OVERLAP),
    "crowded_matches": (crowded_matches, Q_CROWDED),
}
