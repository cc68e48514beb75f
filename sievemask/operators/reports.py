"""Report tables over stored runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemask.operators.ranking import latest_per

CONTROL_TOOL = "none"


def with_target(runs: DataFrame) -> DataFrame:
    """Adds what a run was aimed at: a dataset version, or a driver."""
    return runs.withColumn(
        "target",
        F.when(F.col("suite.kind") == "detection", F.col("suite.dataset_version")).otherwise(F.col("suite.driver")),
    ).withColumn("suite_kind", F.col("suite.kind")).withColumn("tool_name", F.col("tool.name")).withColumn("tool_config", F.col("tool.config"))


def tool_label(name: str = "tool.name", config: str = "tool.config"):
    return F.when(F.col(config) == "default", F.col(name)).otherwise(
        F.concat(F.col(name), F.lit(" ("), F.col(config), F.lit(")"))
    )


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each (suite, target, tool, configuration)."""
    return latest_per(
        with_target(runs), ["suite_kind", "target", "tool_name", "tool_config"], ["started_at", "run_id"]
    )


def outcome_counts(restores: DataFrame) -> DataFrame:
    """Pass, fail and not-applicable counts per run."""
    status = F.col("outcome.status")
    return restores.groupBy("run_id").agg(
        F.count_if(status == "pass").alias("passed"), F.count_if(status == "fail").alias("failed"),
        F.count_if(status == "not_applicable").alias("not_applicable"),
    )


def outcome_label():
    status = F.col("outcome.status")
    return F.when(status == "pass", "pass").when(status == "fail", "FAIL").otherwise("n/a")


def scenario_matrix(restores: DataFrame, run_ids: list[str]) -> DataFrame:
    """Scenario by run; a dash where a run has no record. The runs are columns, so the caller names them."""
    wide = restores.groupBy("scenario_id").pivot("run_id", run_ids).agg(F.first(outcome_label()))
    return wide.na.fill("–", run_ids)


def failure_list(restores: DataFrame) -> DataFrame:
    return restores.where("outcome.status = 'fail'").select(
        "run_id", "scenario_id", F.explode("outcome.failures").alias("f")
    ).select("run_id", "scenario_id", "f.check", "f.detail")


def control_summary(restores: DataFrame, runs: DataFrame) -> DataFrame:
    """Per control run: scenarios run, and failures other than the leaks that are bound to happen."""
    other = F.size(F.filter("outcome.failures", lambda f: f["check"] != "no_leak_upstream"))
    control = runs.where(F.col("tool.name") == CONTROL_TOOL).select("run_id", F.col("suite.driver").alias("driver"))
    return (
        restores.join(control, "run_id")
        .groupBy("driver", "run_id")
        .agg(
            F.count_if(F.col("outcome.status") != "not_applicable").alias("scenarios_run"),
            F.sum(F.when(F.col("outcome.status") == "fail", F.coalesce(other, F.lit(0))).otherwise(0)).alias("other_failures"),
        )
    )


def run_listing(runs: DataFrame) -> DataFrame:
    hardware = F.concat(
        F.col("hardware.os"), F.lit(" "), F.col("hardware.arch"), F.lit(", "), F.col("hardware.cpu"), F.lit(", "),
        F.col("hardware.cores").cast("string"), F.lit(" cores, "), F.col("hardware.memory_mb").cast("string"), F.lit(" MB"),
    )
    return runs.select(
        "run_id", "started_at", F.concat(F.col("tool.name"), F.lit(" ("), F.col("tool.config"), F.lit(")")).alias("tool"),
        F.col("tool.version").alias("version"), F.col("tool.commit").alias("commit"), hardware.alias("hardware"),
    ).orderBy("run_id")
