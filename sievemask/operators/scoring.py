"""Scoring detections against labelled samples.

Gold and predicted spans meet in one row per sample (slim rows: no text), are matched inside the row, and leave as
one compact row per cluster of touching spans. Everything after that is counting with map-side partials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemask.functions import metrics
from sievemask.functions.spans import clustered, empty, overlap
from sievemask.operators.ranking import nearest_rank_by, nearest_rank_percentiles
from sievemask.schemas import PREDICTED, SPAN

MATCHED = "struct<entity:string,gold:int,predicted:int,strict:int,relaxed:int>"


def _pairs(cluster: Column, fits) -> Column:
    golds = F.filter(cluster, lambda x: x["gold"])
    preds = F.filter(cluster, lambda x: ~x["gold"])
    return F.sort_array(
        F.flatten(
            F.transform(
                golds,
                lambda g: F.transform(
                    F.filter(preds, lambda p: fits(g, p)),
                    lambda p: F.struct((-overlap(g, p)).alias("rank"), g["i"].alias("g"), p["i"].alias("p")),
                ),
            )
        )
    )


def _one_to_one(pairs: Column) -> Column:
    """How many pairs survive when each gold and each predicted span is used once, best pairs first."""
    ints = empty("int")
    return F.aggregate(
        pairs,
        F.struct(ints.alias("g"), ints.alias("p")),
        lambda used, x: F.when(
            F.array_contains(used["g"], x["g"]) | F.array_contains(used["p"], x["p"]), used
        ).otherwise(
            F.struct(
                F.concat(used["g"], F.array(x["g"])).alias("g"), F.concat(used["p"], F.array(x["p"])).alias("p")
            )
        ),
        lambda used: F.size(used["g"]),
    )


def match_spans(gold: Column, predicted: Column) -> Column:
    """Matches two span arrays (`start,end,entity`) per entity type.

    Returns one `(entity, gold, predicted, strict, relaxed)` per cluster of same-type spans that touch, the last
    two being true positives: strict needs equal bounds, relaxed any overlap, larger overlaps first (ties: order
    of the gold, then of the predicted spans)."""

    def marked(spans: Column, is_gold: bool) -> Column:
        return F.transform(
            spans,
            lambda s, i: F.struct(
                s["entity"].alias("entity"), s["start"].alias("start"), s["end"].alias("end"),
                F.lit(is_gold).alias("gold"), i.alias("i"),
            ),
        )

    def settle(cluster: Column) -> Column:
        golds = F.size(F.filter(cluster, lambda x: x["gold"]))
        preds = F.size(cluster) - golds
        same = lambda g, p: (g["start"] == p["start"]) & (g["end"] == p["end"])
        meets = lambda g, p: overlap(g, p) > 0
        both = (golds > 0) & (preds > 0)
        return F.array(
            F.struct(
                cluster[0]["entity"].alias("entity"), golds.alias("gold"), preds.alias("predicted"),
                F.when(both, _one_to_one(_pairs(cluster, same))).otherwise(0).alias("strict"),
                F.when(both, _one_to_one(_pairs(cluster, meets))).otherwise(0).alias("relaxed"),
            )
        )

    return clustered(
        F.sort_array(F.concat(marked(gold, True), marked(predicted, False))),
        MATCHED,
        settle,
        # Spans are sorted by type first, so the greatest (type, end) is the furthest end of the span's own type, if it has one.
        lambda s: F.struct(s["entity"].alias("entity"), s["end"].alias("end")),
        lambda s, furthest: (s["entity"] != furthest["entity"]) | (s["start"] > furthest["end"]),
        F.struct(F.lit("").alias("entity"), F.lit(-1).alias("end")),
        "struct<entity:string,end:int>",
    )


def record_problems(samples: DataFrame, records: DataFrame) -> DataFrame:
    """Records that must not be scored: unknown sample ids and repeated records."""
    unknown = records.join(samples.select(F.col("id").alias("sample_id")), "sample_id", "left_anti").select(
        "sample_id", F.lit("unknown sample").alias("problem")
    ).distinct()
    repeated = (
        records.groupBy("sample_id").count().where("count > 1")
        .select("sample_id", F.lit("repeated record").alias("problem"))
    )
    return unknown.unionByName(repeated)


def joined(samples: DataFrame, records: DataFrame, *keys: str) -> DataFrame:
    """One slim row per evaluated sample (and per value of `keys`, columns of the records, such as a run). A failed detection
    predicts nothing, so all its gold spans are missed."""
    gold = samples.select(
        F.col("id").alias("sample_id"), "lang", "difficulty", "source",
        F.when(F.col("labels.kind") == "positive", F.col("labels.spans")).otherwise(empty(SPAN)).alias("gold"),
        F.when(F.col("labels.kind") == "hard_negative", F.col("labels.decoy")).alias("decoy"),
    )
    failed = F.col("status") != "detected"
    found = records.select(
        *keys, "sample_id", "status",
        F.when(failed, empty(PREDICTED)).otherwise(F.col("predicted")).alias("predicted"),
    )
    return gold.join(found, "sample_id").withColumn(
        "mapped",
        F.transform(
            F.filter("predicted", lambda p: p["mapped"].isNotNull()),
            lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["mapped"].alias("entity")),
        ),
    )


def _long(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of both modes as rows `(mode, tp, fp, fn)`."""
    return counts.select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(mode).alias("mode"), F.col(mode).alias("tp"),
                        (F.col("predicted") - F.col(mode)).alias("fp"), (F.col("gold") - F.col(mode)).alias("fn"),
                    )
                    for mode in ("strict", "relaxed")
                ]
            )
        ).alias("c"),
    ).select(*keys, "c.*")


def _sums(prefix: str = "") -> list[Column]:
    return [
        F.coalesce(F.sum(f"{prefix}{c}"), F.lit(0)).cast("long").alias(c)
        for c in ("gold", "predicted", "strict", "relaxed")
    ]


def matched(scored: DataFrame) -> DataFrame:
    """`joined` rows exploded to one row per cluster; samples without spans keep one empty row, so that every
    slice they belong to exists."""
    return scored.select(
        "sample_id", "lang", "difficulty", "source",
        F.explode_outer(match_spans(F.col("gold"), F.col("mapped"))).alias("m"),
    )


def sample_counts(scored: DataFrame) -> DataFrame:
    """tp/fp/fn per sample, entity and mode."""
    per = (
        matched(scored).where("m is not null").groupBy("sample_id", F.col("m.entity").alias("entity")).agg(*_sums("m."))
    )
    return _long(per, ["sample_id", "entity"])


def totals(scored: DataFrame) -> DataFrame:
    """`(dimension, value, mode, tp, fp, fn)`: micro totals, by entity, and by language, difficulty and source.

    One pass: clusters are first folded to at most entities x slices rows, and only that is grouped five ways."""
    compact = matched(scored).groupBy(F.col("m.entity").alias("entity"), "lang", "difficulty", "source").agg(
        *_sums("m.")
    )
    sets = compact.groupingSets(
        [[], ["entity"], ["lang"], ["difficulty"], ["source"]], "entity", "lang", "difficulty", "source"
    ).agg(
        *_sums(),
        *[F.grouping(c).alias(f"_{c}") for c in ("entity", "lang", "difficulty", "source")],
    )
    dimension, value = F.lit("micro"), F.lit("")
    for c in ("entity", "lang", "difficulty", "source"):
        dimension = F.when(F.col(f"_{c}") == 0, c).otherwise(dimension)
        value = F.when(F.col(f"_{c}") == 0, F.col(c)).otherwise(value)
    named = sets.select(
        dimension.alias("dimension"), value.alias("value"), "gold", "predicted", "strict", "relaxed"
    ).where("value is not null")
    return _long(named, ["dimension", "value"])


def with_rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "*", metrics.precision(tp, fp).alias("precision"), metrics.recall(tp, fn).alias("recall"),
        metrics.f1(tp, fp, fn).alias("f1"),
    )


def hard_negatives(scored: DataFrame) -> DataFrame:
    """Per decoy type: texts, texts flagged as that type, texts flagged at all (mapped or not)."""
    return scored.where("decoy is not null").groupBy("decoy").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(F.exists("mapped", lambda m: m["entity"] == F.col("decoy"))).alias("flagged_as_decoy_type"),
        F.count_if(F.size("predicted") > 0).alias("flagged_any"),
    )


def hard_negative_rate(negatives: DataFrame) -> DataFrame:
    return negatives.agg(
        F.sum("samples").alias("samples"), F.sum("flagged_as_decoy_type").alias("flagged"),
        metrics.ratio(F.sum("flagged_as_decoy_type"), F.sum("samples")).alias("rate"),
    )


def unmapped_labels(scored: DataFrame) -> DataFrame:
    """Per label the entity map does not know: predictions, and how many overlap a gold span."""
    loose = scored.select(
        "gold", F.explode(F.filter("predicted", lambda p: p["mapped"].isNull())).alias("p")
    )
    touches = F.exists("gold", lambda g: (g["start"] < F.col("p.end")) & (F.col("p.start") < g["end"]))
    return loose.groupBy(F.col("p.unmapped").alias("label")).agg(
        F.count(F.lit(1)).alias("predictions"), F.count_if(touches).alias("overlapping_gold")
    )


def coverage(samples: DataFrame, records: DataFrame) -> DataFrame:
    """How many samples were evaluated, have no record, or failed."""
    known = records.groupBy("sample_id").agg(F.max((F.col("status") != "detected").cast("int")).alias("failed"))
    return (
        samples.select(F.col("id").alias("sample_id"))
        .join(known, "sample_id", "left")
        .agg(
            F.count("failed").alias("evaluated"),
            F.count_if(F.col("failed").isNull()).alias("missing"),
            F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"),
        )
    )


def missing_samples(samples: DataFrame, records: DataFrame) -> DataFrame:
    return samples.select(F.col("id").alias("sample_id")).join(records.select("sample_id"), "sample_id", "left_anti")


def latency(records: DataFrame) -> DataFrame:
    """Nearest-rank percentiles of tool and wall time over successful detections."""
    ok = records.where("status = 'detected'")
    parts = [
        nearest_rank_percentiles(ok, c).select(F.lit(name).alias("clock"), "*")
        for name, c in (("tool", "elapsed_ns"), ("wall", "wall_ns"))
    ]
    return parts[0].unionByName(parts[1])


def entity_table(counts: DataFrame) -> DataFrame:
    """Per entity: gold count and precision, recall, F1 of both modes side by side."""
    wide = counts.where("dimension = 'entity'").groupBy("value")

    def of(mode: str, c: str) -> Column:
        return F.max(F.when(F.col("mode") == mode, F.col(c)))

    rates = []
    for mode in ("strict", "relaxed"):
        tp, fp, fn = (of(mode, c) for c in ("tp", "fp", "fn"))
        rates += [
            metrics.precision(tp, fp).alias(f"{mode}_p"), metrics.recall(tp, fn).alias(f"{mode}_r"),
            metrics.f1(tp, fp, fn).alias(f"{mode}_f1"),
        ]
    return wide.agg((of("relaxed", "tp") + of("relaxed", "fn")).alias("gold"), *rates).withColumnRenamed(
        "value", "entity"
    )


def run_summary(samples: DataFrame, records: DataFrame) -> DataFrame:
    """The one-row summary of a run: coverage, micro rates, hard-negative rate, latency."""
    scored = joined(samples, records)
    micro = with_rates(totals(scored)).where("dimension = 'micro'")

    def of(mode: str, c: str) -> Column:
        return F.max(F.when(F.col("mode") == mode, F.col(c)))

    rates = micro.agg(
        of("strict", "f1").alias("strict_f1"), of("relaxed", "f1").alias("relaxed_f1"),
        of("relaxed", "precision").alias("relaxed_p"), of("relaxed", "recall").alias("relaxed_r"),
    )
    times = latency(records).groupBy().agg(
        F.max(F.when(F.col("clock") == "tool", F.col("p50"))).alias("tool_p50_ns"),
        F.max(F.when(F.col("clock") == "tool", F.col("p95"))).alias("tool_p95_ns"),
        F.max(F.when(F.col("clock") == "wall", F.col("p50"))).alias("wall_p50_ns"),
    )
    row = coverage(samples, records)
    for part in (rates, hard_negative_rate(hard_negatives(scored)).select(F.col("rate").alias("hard_negative_rate")), times):
        row = row.withColumn("_k", F.lit(0)).join(part.withColumn("_k", F.lit(0)), "_k").drop("_k")
    samples_text = F.when(
        F.col("missing") > 0,
        F.concat_ws(" of ", F.col("evaluated").cast("string"), (F.col("evaluated") + F.col("missing")).cast("string")),
    ).otherwise(F.col("evaluated").cast("string"))
    return row.withColumn("samples", samples_text)


def run_summaries(samples: DataFrame, records: DataFrame, run: str = "run_id") -> DataFrame:
    """The summary of every run in one job: one row per run of `records`, scored against the same samples.

    A run's rows are folded before they are shuffled; percentiles come from counted values."""
    scored = joined(samples, records, run)
    spans = (
        scored.select(run, F.explode(match_spans(F.col("gold"), F.col("mapped"))).alias("m")).groupBy(run).agg(*_sums("m."))
    )
    flagged = F.exists("mapped", lambda m: m["entity"] == F.col("decoy"))
    texts = scored.groupBy(run).agg(
        F.count(F.lit(1)).alias("evaluated"), F.count_if(F.col("status") != "detected").alias("failed"),
        F.count("decoy").alias("_negatives"), F.count_if(F.col("decoy").isNotNull() & flagged).alias("_flagged"),
    )
    ok = records.where("status = 'detected'")
    tool = nearest_rank_by(ok, [run], "elapsed_ns", (50, 95)).withColumnsRenamed({"p50": "tool_p50_ns", "p95": "tool_p95_ns"})
    wall = nearest_rank_by(ok, [run], "wall_ns", (50,)).withColumnsRenamed({"p50": "wall_p50_ns"})
    every = texts.join(spans, run, "left").join(tool, run, "left").join(wall, run, "left")
    whole = samples.agg(F.count(F.lit(1)).alias("n")).scalar()

    def of(mode: str) -> tuple[Column, Column, Column]:
        tp = F.coalesce(F.col(mode), F.lit(0))
        return tp, F.coalesce(F.col("predicted"), F.lit(0)) - tp, F.coalesce(F.col("gold"), F.lit(0)) - tp

    strict, relaxed = of("strict"), of("relaxed")
    return every.select(
        run, "evaluated", (whole - F.col("evaluated")).alias("missing"), "failed",
        metrics.f1(*strict).alias("strict_f1"), metrics.f1(*relaxed).alias("relaxed_f1"),
        metrics.precision(relaxed[0], relaxed[1]).alias("relaxed_p"), metrics.recall(relaxed[0], relaxed[2]).alias("relaxed_r"),
        metrics.ratio(F.col("_flagged"), F.col("_negatives")).alias("hard_negative_rate"), "tool_p50_ns", "tool_p95_ns", "wall_p50_ns",
    )
