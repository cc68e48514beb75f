"""Detection over tables: built-in recognizers as columns, plug-in detectors as Arrow batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemask.functions import recognizers
from sievemask.functions.spans import unfolded
from sievemask.schemas import PREDICTED, TOOL_ENTITY


def with_spans(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Adds the detected spans; works the same on a streaming DataFrame."""
    return df.withColumn(out, recognizers.detect(F.col(text)))


def span_rows(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One slim row per detected span. Texts without any hit drop out at the scan."""
    return unfolded(df.where(recognizers.may_hold(F.col(text))), keys, recognizers.detect(F.col(text)), "s").select(*keys, "s.*")


def candidate_rows(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per checked match before overlaps are resolved."""
    found = unfolded(df.where(recognizers.may_hold(F.col(text))), keys, recognizers.candidates(F.col(text)), "s")
    return found.select(*keys, "s.start", "s.end", "s.label", "s.value")


def map_labels(spans: DataFrame, entity_map: DataFrame, label: str = "label") -> DataFrame:
    """Adds `mapped` (the entity type) and `unmapped` (the label, when the map does not know it).

    `entity_map` is `(label, entity)`; the join strategy is left to the optimizer, which knows its size."""
    known = entity_map.select(F.col("label").alias(label), F.col("entity").alias("mapped"))
    return spans.join(known, label, "left").withColumn(
        "unmapped", F.when(F.col("mapped").isNull(), F.col(label))
    )


def builtin_records(samples: DataFrame) -> DataFrame:
    """Detection records of the built-in recognizers, labels already mapped. A column expression cannot fail
    for one row, so every status is `detected`."""
    lookup = F.create_map(*[F.lit(x) for pair in recognizers.LABEL_ENTITY.items() for x in pair])
    predicted = F.transform(
        recognizers.detect(F.col("text")),
        lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), lookup[s["label"]].alias("mapped"),
            F.lit(None).cast("string").alias("unmapped"),
        ),
    )
    return samples.select(
        F.col("id").alias("sample_id"), F.lit("detected").alias("status"), predicted.alias("predicted")
    )


def detect_with(df: DataFrame, key: str, detector: Callable[[str], list[dict]], text: str = "text") -> DataFrame:
    """Runs a user's detector over `(key, text)` in Arrow batches.

    A text the detector fails on becomes a `failed` row with the message; the others are unaffected. `elapsed_ns`
    is the detector's own time for the text, `wall_ns` includes the handling around it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, value in zip(batch[key], batch[text]):
                begun = time.perf_counter_ns()
                entities, message = None, None
                try:
                    found = detector(value)
                    elapsed = time.perf_counter_ns() - begun
                    entities = [
                        {"start": int(e["start"]), "end": int(e["end"]), "label": e["label"], "score": e.get("score")}
                        for e in found
                    ]
                except Exception as error:  # noqa: BLE001 - any failure of foreign code is this row's result
                    elapsed, message = None, f"{type(error).__name__}: {error}"
                wall = time.perf_counter_ns() - begun if message is None else None
                rows.append((k, "failed" if message else "detected", entities, elapsed, wall, message))
            yield pd.DataFrame(rows, columns=[key, "status", "entities", "elapsed_ns", "wall_ns", "message"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInPandas(
        run,
        f"{key} {kind}, status string, entities array<{TOOL_ENTITY}>, elapsed_ns long, wall_ns long, message string",
    )


def mapped_records(records: DataFrame, entity_map: DataFrame, key: str) -> DataFrame:
    """Turns `entities` of `detect_with` into `predicted`, keeping unknown labels as `unmapped`.

    Labels are joined with the map, whatever its size, and regrouped per record; a group holds the entities of one text. A label that the
    map lists twice fails the query."""
    rest = ["status", "elapsed_ns", "wall_ns", "message"]

    def predicted(e: Column, mapped: Column) -> Column:
        return F.struct(
            e["start"].alias("start"), e["end"].alias("end"), mapped.alias("mapped"),
            F.when(mapped.isNull(), e["label"]).alias("unmapped"),
        )

    entities = F.coalesce(F.col("entities"), F.array().cast(f"array<{TOOL_ENTITY}>"))
    twice = F.raise_error(F.concat(F.lit("the map lists a label twice: "), "label")).cast("string")
    known = entity_map.groupBy("label").agg(F.count(F.lit(1)).alias("_n"), F.min("entity").alias("entity"))
    known = known.select("label", F.when(F.col("_n") > 1, twice).otherwise(F.col("entity")).alias("entity"))
    rows = records.select(key, F.posexplode(entities).alias("pos", "e")).withColumn("label", F.col("e.label"))
    joined = rows.join(known, "label", "left").groupBy(key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", predicted(F.col("e"), F.col("entity")).alias("p")))), lambda x: x["p"]
        ).alias("predicted")
    )
    none = F.array().cast(f"array<{PREDICTED}>")
    return records.join(joined, key, "left").select(key, "status", F.coalesce("predicted", none).alias("predicted"), *rest[1:])


def first_samples(samples: DataFrame, order: str, limit: int | None) -> DataFrame:
    """The first `limit` samples by `order` (a top-k over partitions), or all of them."""
    return samples if limit is None else samples.orderBy(order).limit(limit)
