"""Queries for stored samples, stored runs and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievemask.operators import reports as R
from sievemask.plans.common import big, scratch, table
from sievemask.session import frozen
from sievemask.sources import runs as RS
from sievemask.sources import samples as SRC


def runs(spark, sf):
    """A run per customer."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.concat(F.lit("r"), k.cast("string")).alias("run_id"),
        F.concat(F.lit("2024-01-"), F.lpad((k * 7 % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z")).alias("started_at"), F.lit("1").alias("harness_version"),
        F.struct(
            F.when(k % 10 == 0, "none").otherwise(F.lower("c_mktsegment")).alias("name"), F.lit("1.0").alias("version"), F.lit("abc").alias("commit"),
            F.when(k % 3 == 0, "alt").otherwise("default").alias("config"),
        ).alias("tool"),
        F.struct(F.lit("linux").alias("os"), F.lit("x86").alias("arch"), F.lit("cpu").alias("cpu"), (k % 64 + 1).cast("int").alias("cores"), F.lit(1024).alias("memory_mb")).alias("hardware"),
        F.struct(
            F.when(k % 2 == 0, "detection").otherwise("restore").alias("kind"), F.when(k % 2 == 0, F.concat(F.lit("v"), (k % 4).cast("string"))).alias("dataset_version"),
            F.when(k % 2 == 0, F.concat(F.lit("f"), (k % 6).cast("string"))).alias("dataset_fingerprint"), F.when(k % 2 == 1, F.concat(F.lit("d"), (k % 5).cast("string"))).alias("driver"),
        ).alias("suite"),
    )


Q_RUNS = """
runs AS (SELECT c_custkey AS k, 'r' || c_custkey AS run_id, '2024-01-' || lpad((c_custkey * 7 % 28 + 1)::VARCHAR, 2, '0') || 'T00:00:00Z' AS started_at,
  CASE WHEN c_custkey % 10 = 0 THEN 'none' ELSE lower(c_mktsegment) END AS tool, CASE WHEN c_custkey % 3 = 0 THEN 'alt' ELSE 'default' END AS config,
  CASE WHEN c_custkey % 2 = 0 THEN 'detection' ELSE 'restore' END AS kind,
  CASE WHEN c_custkey % 2 = 0 THEN 'v' || c_custkey % 4 ELSE 'd' || c_custkey % 5 END AS target FROM customer)"""


def latest_runs(spark, sf):
    return R.latest_runs(runs(spark, sf)).select("suite_kind", "target", R.tool_label().alias("tool"), "run_id", "started_at")


Q_LATEST = f"""WITH {Q_RUNS}, w AS (SELECT *, row_number() OVER (PARTITION BY kind, target, tool, config ORDER BY started_at DESC, run_id DESC) AS i FROM runs)
SELECT kind AS suite_kind, target, CASE WHEN config = 'default' THEN tool ELSE tool || ' (' || config || ')' END AS tool, run_id, started_at FROM w WHERE i = 1"""


def run_listing(spark, sf):
    return R.run_listing(runs(spark, sf))


Q_LISTING = f"""WITH {Q_RUNS} SELECT run_id, started_at, tool || ' (' || config || ')' AS tool, '1.0' AS version, 'abc' AS "commit",
'linux x86, cpu, ' || (k % 64 + 1) || ' cores, 1024 MB' AS hardware FROM runs"""


def restores(spark, sf):
    """Scenario outcomes from orders: the customer is the run, the order the scenario."""
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    failure = lambda c: F.struct(F.lit(c).alias("check"), F.concat(F.lit(c[:2]), k.cast("string")).alias("detail"))
    both = F.array(failure("no_leak_upstream"), failure("restored_exact"))
    return table(spark, sf, "orders").select(
        F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("run_id"), k.cast("string").alias("scenario_id"),
        F.struct(
            F.when(s == "F", "fail").when(s == "O", "pass").otherwise("not_applicable").alias("status"),
            F.when(s == "F", F.when(k % 2 == 0, both).otherwise(F.slice(both, 1, 1))).alias("failures"), F.lit("").alias("upstream_excerpt"), F.lit("").alias("client_excerpt"),
            F.when(s == "P", "n/a here").alias("reason"),
        ).alias("outcome"),
    )


def outcome_counts(spark, sf):
    t = R.outcome_counts(restores(spark, sf))
    return t.select("run_id", *[big(c).alias(c) for c in ("passed", "failed", "not_applicable")])


Q_COUNTS = """SELECT 'r' || o_custkey AS run_id, count(*) FILTER (o_orderstatus = 'O') AS passed, count(*) FILTER (o_orderstatus = 'F') AS failed,
count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS not_applicable FROM orders GROUP BY 1"""


def scenario_matrix(spark, sf):
    """Customers as scenarios, priorities as runs; the outcome is the one of the customer's first order."""
    first = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min_by("o_orderstatus", "o_orderkey").alias("s"))
    rows = first.select(
        F.col("o_custkey").cast("string").alias("scenario_id"), F.substring("o_orderpriority", 1, 1).alias("run_id"),
        F.struct(F.when(F.col("s") == "F", "fail").when(F.col("s") == "O", "pass").otherwise("not_applicable").alias("status")).alias("outcome"),
    )
    m = R.scenario_matrix(rows, list("12345"))
    return m.select("scenario_id", *[F.col(f"`{c}`").alias(f"run_{c}") for c in "12345"])


Q_MATRIX = """WITH f AS (SELECT o_custkey, o_orderpriority[1] AS p, arg_min(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1, 2),
l AS (SELECT o_custkey, p, CASE s WHEN 'F' THEN 'FAIL' WHEN 'O' THEN 'pass' ELSE 'n/a' END AS o FROM f)
SELECT o_custkey::VARCHAR AS scenario_id, coalesce(max(o) FILTER (p = '1'), '–') AS run_1, coalesce(max(o) FILTER (p = '2'), '–') AS run_2, coalesce(max(o) FILTER (p = '3'), '–') AS run_3, coalesce(max(o) FILTER (p = '4'), '–') AS run_4, coalesce(max(o) FILTER (p = '5'), '–') AS run_5 FROM l GROUP BY 1"""


def failure_list(spark, sf):
    return R.failure_list(restores(spark, sf))


Q_FAILURES = """SELECT 'r' || o_custkey AS run_id, o_orderkey::VARCHAR AS scenario_id, 'no_leak_upstream' AS "check", 'no' || o_orderkey AS detail FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'r' || o_custkey, o_orderkey::VARCHAR, 'restored_exact', 're' || o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0"""


def control_summary(spark, sf):
    t = R.control_summary(restores(spark, sf), runs(spark, sf).withColumn("suite", F.struct(F.col("suite.kind").alias("kind"), F.coalesce("suite.driver", F.lit("none")).alias("driver"))))
    return t.select("driver", "run_id", big("scenarios_run").alias("scenarios_run"), big("other_failures").alias("other_failures"))


Q_CONTROL = f"""WITH {Q_RUNS} SELECT CASE WHEN kind = 'restore' THEN target ELSE 'none' END AS driver, run_id, count(*) FILTER (o_orderstatus <> 'P') AS scenarios_run,
count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 2 = 0) AS other_failures FROM runs JOIN orders ON o_custkey = k WHERE tool = 'none' GROUP BY 1, 2"""


def dataset_conflicts(spark, sf):
    manifests = table(spark, sf, "customer").select(
        F.concat(F.lit("v"), F.col("c_custkey").cast("string")).alias("version"), F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("fingerprint")
    ).where("version <> 'v2'")
    return RS.dataset_conflicts(runs(spark, sf), manifests)


Q_CONFLICTS = f"""WITH {Q_RUNS} SELECT run_id, target AS dataset_version, 'f' || k % 6 AS recorded, CASE WHEN k % 4 = 0 THEN 'f0' END AS found FROM runs WHERE kind = 'detection' AND NOT (k % 4 = 0 AND k % 6 = 0)"""


def _conversation_samples(spark, sf):
    span = F.struct(F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit("PERSON_NAME").alias("entity"))
    return table(spark, sf, "conversations").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text",
        F.struct(F.lit("positive").alias("kind"), F.array(span).alias("spans"), F.lit(None).cast("string").alias("decoy")).alias("labels"),
        F.lit("en").alias("lang"), F.lit("easy").alias("difficulty"), F.lit("template").alias("source"), F.lit("1").alias("generator_version"), "conv_id", "turn",
    )


def read_back_samples(spark, sf):
    """Sample lines with blank, broken and over-complete ones among them, read strictly and leniently."""
    s = _conversation_samples(spark, sf)
    line = F.to_json(F.struct(*[c for c in s.columns if c not in ("conv_id", "turn")]), {"ignoreNullFields": "false"})
    k = (F.col("conv_id") * 10 + F.col("turn")) % 9
    broken = (
        F.when(k == 1, F.substring(line, F.lit(1), F.length(line) - 5)).when(k == 2, F.regexp_replace(line, r"\}\z", ',"extra":1}'))
        .when(k == 3, F.replace(line, F.lit('"start":0,'), F.lit('"start":0,"stop":1,'))).when(k == 4, F.lit("   ")).otherwise(line)
    )
    path = scratch(spark, "samples")
    s.select(broken.alias("value")).write.mode("overwrite").text(path)
    parts = []
    for mode, strict in (("strict", True), ("lenient", False)):
        good, bad = SRC.read_samples(spark, path, strict)
        parts.append(good.select(F.lit(mode).alias("mode"), F.lit("good").alias("reason"), F.col("id")))
        parts.append(bad.select(F.lit(mode).alias("mode"), "reason", F.lit(None).cast("string").alias("id")))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return rows.groupBy("mode", "reason").agg(big(F.count(F.lit(1))).alias("n"), big(F.countDistinct("id")).alias("ids"))


Q_READ = """WITH s AS (SELECT conv_id || '/' || turn AS id, (conv_id * 10 + turn) % 9 AS k FROM conversations WHERE (conv_id * 10 + turn) % 9 <> 4),
r AS (SELECT 'strict' AS mode, CASE k WHEN 1 THEN 'does not parse' WHEN 2 THEN 'unknown fields: extra' WHEN 3 THEN 'unknown fields: labels.spans[].stop' ELSE 'good' END AS reason, id FROM s
  UNION ALL SELECT 'lenient', CASE k WHEN 1 THEN 'does not parse' ELSE 'good' END, id FROM s)
SELECT mode, reason, count(*) AS n, count(DISTINCT CASE WHEN reason = 'good' THEN id END) AS ids FROM r GROUP BY 1, 2"""


def first_rejected_lines(spark, sf):
    """The first line of each file that does not parse or knows too much, by its number in the file; files are read in many splits."""
    s = _conversation_samples(spark, sf)
    line = F.to_json(F.struct(*[c for c in s.columns if c not in ("conv_id", "turn")]), {"ignoreNullFields": "false"})
    k = (F.col("conv_id") * 10 + F.col("turn")) % 50
    broken = F.when(k == 33, F.substring(line, F.lit(1), F.length(line) - 5)).when(k == 44, F.regexp_replace(line, r"\}\z", ',"extra":1}')).when(k % 5 == 2, F.lit("  ")).otherwise(line)
    path = scratch(spark, "files") + "/lines"
    rows = s.select((F.col("conv_id") % 4).alias("part"), "conv_id", "turn", broken.alias("value"))
    rows.repartition(4, "part").sortWithinPartitions("part", "conv_id", "turn").select("part", "value").write.partitionBy("part").text(path)
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "16k")  # so that small files have many splits too
    try:
        _, bad = SRC.read_samples(spark, f"{path}/part=*")
        first = frozen(SRC.first_rejected(bad))
    finally:
        spark.conf.set(size, before)
    return first.select(big(F.regexp_extract("file", r"part=(\d+)/", 1)).alias("part"), "line_no", "reason")


Q_FIRST_REJECTED = """WITH r AS (SELECT conv_id % 4 AS part, (conv_id * 10 + turn) % 50 AS k, row_number() OVER (PARTITION BY conv_id % 4 ORDER BY conv_id, turn) AS line_no FROM conversations),
b AS (SELECT part, line_no, CASE k WHEN 33 THEN 'does not parse' ELSE 'unknown fields: extra' END AS reason FROM r WHERE k IN (33, 44))
SELECT part, line_no, reason FROM b QUALIFY row_number() OVER (PARTITION BY part ORDER BY line_no) = 1"""


def written_dataset(spark, sf):
    """A dataset written, checked, written again unchanged, and refused when changed."""
    s = _conversation_samples(spark, sf)
    path = scratch(spark, "dataset")
    first = SRC.write_dataset(s, path, "v1", 42, 1, "1")
    again = SRC.write_dataset(s.repartition(3), path, "v1", 42, 1, "1")
    try:
        SRC.write_dataset(s.withColumn("text", F.concat("text", F.lit("!"))), path, "v1", 42, 1, "1")
        refused = False
    except SRC.VersionConflict:
        refused = True
    return SRC.check_dataset(spark, path).select(
        "version", big("sample_count").alias("sample_count"), "ok", F.lit(first).alias("first"), F.lit(again).alias("again"), F.lit(refused).alias("refused")
    )


def order_fingerprint(spark, sf):
    return SRC.fingerprint(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")).select(big("sample_count").alias("sample_count"), "fingerprint")


Q_FINGERPRINT = """WITH h AS (SELECT sha256('{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS h FROM orders),
s AS (SELECT count(*) AS n, """ + ", ".join(f"sum(('0x' || substr(h, {1 + 12 * i}, 12))::BIGINT)::VARCHAR AS s{i}" for i in range(5)) + """ FROM h)
SELECT n AS sample_count, sha256(n || '/' || s0 || '/' || s1 || '/' || s2 || '/' || s3 || '/' || s4) AS fingerprint FROM s"""


def _detection_records(spark, sf):
    k = F.col("o_orderkey")
    ok = k % 5 != 0
    span = lambda m, u: F.struct(F.lit(1).alias("start"), F.lit(4).alias("end"), F.lit(m).cast("string").alias("mapped"), F.lit(u).cast("string").alias("unmapped"))
    return table(spark, sf, "orders").select(
        k.cast("string").alias("sample_id"), F.when(ok, "detected").otherwise("failed").alias("status"),
        F.when(ok, F.when(k % 2 == 0, F.array(span("PAN", None))).otherwise(F.array(span(None, "ORG"), span("PAN", None)))).alias("predicted"),
        F.when(ok, k * 2).alias("elapsed_ns"), F.when(ok, k * 3).alias("wall_ns"), F.when(~ok, "boom").alias("message"), "o_orderpriority",
    )


def stored_runs(spark, sf):
    """Runs of all customers, and records of five of them (one per order priority), written in one job each and loaded again."""
    base = scratch(spark, "results")
    run_id = F.concat(F.lit("r"), ((F.substring("o_orderpriority", 1, 1).cast("int") - 1) * 2).cast("string"))
    RS.store_runs(runs(spark, sf), base)
    RS.store_records(_detection_records(spark, sf).withColumn("run_id", run_id), base)
    back = RS.load_detections(spark, base)
    meta = RS.load_runs(spark, base).select("run_id", "started_at")
    sums = back.groupBy("run_id").agg(
        big(F.count(F.lit(1))).alias("records"), big(F.count_if(F.col("status") == "failed")).alias("failed"), big(F.sum("elapsed_ns")).alias("elapsed"), big(F.sum("wall_ns")).alias("wall"),
        big(F.sum(F.size(F.filter(F.coalesce("predicted", F.array().cast("array<struct<start:int,end:int,mapped:string,unmapped:string>>")), lambda p: p["unmapped"] == "ORG")))).alias("org"),
        F.max("message").alias("message"),
    )
    return meta.join(sums, "run_id", "left")


def stored_restores(spark, sf):
    """Restore outcomes of five runs written and loaded again."""
    base = scratch(spark, "results")
    rows = restores(spark, sf)
    RS.store_restores(rows.withColumn("run_id", F.concat(F.lit("p"), (F.col("scenario_id").cast("long") % 5).cast("string"))), base)
    back = RS.load_restores(spark, base)
    return back.groupBy("run_id", F.col("outcome.status").alias("status")).agg(
        big(F.count(F.lit(1))).alias("n"), big(F.sum(F.coalesce(F.size("outcome.failures"), F.lit(0)))).alias("failures"), F.max("outcome.reason").alias("reason")
    )


Q_STORED_RESTORES = """SELECT 'p' || o_orderkey % 5 AS run_id, CASE o_orderstatus WHEN 'F' THEN 'fail' WHEN 'O' THEN 'pass' ELSE 'not_applicable' END AS status, count(*) AS n,
sum(CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END ELSE 0 END)::BIGINT AS failures,
max(CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'n/a here' END) AS reason FROM orders GROUP BY 1, 2"""


Q_STORED = f"""WITH {Q_RUNS}, o AS (SELECT 'r' || ((o_orderpriority[1])::INT - 1) * 2 AS run_id, o_orderkey FROM orders),
s AS (SELECT run_id, count(*) AS records, count(*) FILTER (o_orderkey % 5 = 0) AS failed, sum(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey * 2 END)::BIGINT AS elapsed,
  sum(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey * 3 END)::BIGINT AS wall, count(*) FILTER (o_orderkey % 5 <> 0 AND o_orderkey % 2 = 1) AS org, 'boom' AS message FROM o GROUP BY 1)
SELECT run_id, started_at, records, failed, elapsed, wall, org, message FROM runs LEFT JOIN s USING (run_id)"""


def appended_records(spark, sf):
    """Records appended as a batch and from a stream, to one place."""
    source, out, mark = (scratch(spark, f"append-{x}") for x in ("in", "out", "mark"))
    records = _detection_records(spark, sf).drop("o_orderpriority")
    records.where("status = 'failed'").write.mode("overwrite").parquet(source)
    RS.append_records(records.where("status = 'detected'"), out + "/batch")
    RS.append_records(spark.readStream.schema(records.schema).parquet(source), out + "/stream", mark)
    return spark.read.schema(records.schema).parquet(out + "/batch", out + "/stream").groupBy("status").agg(big(F.count(F.lit(1))).alias("n"), big(F.sum("elapsed_ns")).alias("elapsed"))


Q_APPENDED = "SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'detected' END AS status, count(*) AS n, sum(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey * 2 END)::BIGINT AS elapsed FROM orders GROUP BY 1"

QUERIES = {
    "latest_runs": (latest_runs, Q_LATEST),
    "run_listing": (run_listing, Q_LISTING),
    "outcome_counts": (outcome_counts, Q_COUNTS),
    "scenario_matrix": (scenario_matrix, Q_MATRIX),
    "failure_list": (failure_list, Q_FAILURES),
    "control_summary": (control_summary, Q_CONTROL),
    "dataset_conflicts": (dataset_conflicts, Q_CONFLICTS),
    "read_back_samples": (read_back_samples, Q_READ),
    "first_rejected_lines": (first_rejected_lines, Q_FIRST_REJECTED),
    "written_dataset": (written_dataset, "SELECT 'v1' AS version, count(*) AS sample_count, true AS ok, true AS first, false AS again, true AS refused FROM conversations"),
    "order_fingerprint": (order_fingerprint, Q_FINGERPRINT),
    "stored_runs": (stored_runs, Q_STORED),
    "stored_restores": (stored_restores, Q_STORED_RESTORES),
    "appended_records": (appended_records, Q_APPENDED),
}
