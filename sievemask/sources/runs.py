"""Run folders: `<results>/<run id>/{meta,detections,restores}` as JSON, read as three tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievemask.schemas import DETECTIONS, PREDICTED, RESTORES, RUNS

# Detection records as they are stored: a result that is either `detected` or `failed`.
STORED_DETECTION = (
    "sample_id string, result struct<status:string,"
    "predicted:array<struct<start:int,end:int,entity:struct<mapped:string,unmapped:string>>>,"
    "elapsed_ns:long,wall_ns:long,message:string>"
)


def _schema(fields: str | StructType) -> StructType:
    return fields if isinstance(fields, StructType) else StructType.fromDDL(fields)


def flat_records(stored: DataFrame) -> DataFrame:
    """Stored detection records with the tagged result spread over nullable columns."""
    predicted = F.transform(
        "result.predicted",
        lambda p: F.struct(
            p["start"].alias("start"), p["end"].alias("end"), p["entity"]["mapped"].alias("mapped"),
            p["entity"]["unmapped"].alias("unmapped"),
        ),
    )
    kept = [c for c in stored.columns if c not in ("sample_id", "result")]
    return stored.select(
        *kept, "sample_id", F.col("result.status").alias("status"), predicted.cast(f"array<{PREDICTED}>").alias("predicted"),
        "result.elapsed_ns", "result.wall_ns", "result.message",
    )


def stored_records(records: DataFrame, *kept: str) -> DataFrame:
    """The inverse of `flat_records`."""
    predicted = F.transform(
        "predicted",
        lambda p: F.struct(
            p["start"].alias("start"), p["end"].alias("end"),
            F.struct(p["mapped"].alias("mapped"), p["unmapped"].alias("unmapped")).alias("entity"),
        ),
    )
    return records.select(
        *kept, "sample_id", F.struct("status", predicted.alias("predicted"), "elapsed_ns", "wall_ns", "message").alias("result")
    )


def store_runs(runs: DataFrame, results: str) -> None:
    runs.write.mode("append").json(f"{results}/meta")


def store_records(records: DataFrame, results: str) -> None:
    """Detection records of many runs at once: a partition for each `run_id`."""
    shaped = stored_records(records.select("sample_id", "status", "predicted", "elapsed_ns", "wall_ns", "message", "run_id"), "run_id")
    shaped.write.mode("append").partitionBy("run_id").json(f"{results}/detections")


def store_restores(outcomes: DataFrame, results: str) -> None:
    outcomes.write.mode("append").partitionBy("run_id").json(f"{results}/restores")


def _of_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records below `path`, with the run they belong to. A filter on `run_id` reads only that run's files."""
    whole = StructType([f for f in _schema(schema).fields if f.name != "run_id"]).add("run_id", "string")
    return spark.read.schema(whole).json(path)


def load_runs(spark: SparkSession, results: str) -> DataFrame:
    """Every run, oldest first."""
    return spark.read.schema(RUNS).json(f"{results}/meta").orderBy("started_at", "run_id")


def load_detections(spark: SparkSession, results: str) -> DataFrame:
    return flat_records(_of_runs(spark, f"{results}/detections", STORED_DETECTION))


def load_restores(spark: SparkSession, results: str) -> DataFrame:
    return _of_runs(spark, f"{results}/restores", RESTORES)


def dataset_conflicts(runs: DataFrame, manifests: DataFrame) -> DataFrame:
    """Detection runs whose recorded dataset is missing or has another fingerprint now."""
    known = manifests.select(F.col("version").alias("dataset_version"), F.col("fingerprint").alias("found"))
    used = runs.where("suite.kind = 'detection'").select(
        "run_id", F.col("suite.dataset_version").alias("dataset_version"), F.col("suite.dataset_fingerprint").alias("recorded")
    )
    return used.join(known, "dataset_version", "left").where("found is null or found <> recorded").select(
        "run_id", "dataset_version", "recorded", "found"
    )


def append_records(records: DataFrame, path: str, checkpoint: str | None = None):
    """Appends records to a run: a batch append, or for a streaming DataFrame a checkpointed one that drains what
    is available."""
    if records.isStreaming:
        query = (
            records.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start(path)
        )
        query.awaitTermination()
        return query
    return records.write.mode("append").parquet(path)


__all__ = [
    "DETECTIONS", "append_records", "dataset_conflicts", "flat_records", "load_detections", "load_restores",
    "load_runs", "store_records", "store_restores", "store_runs", "stored_records",
]
