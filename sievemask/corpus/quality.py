"""Checking and describing a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemask.functions.identifiers import is_valid
from sievemask.functions.spans import empty
from sievemask.functions.text import has_edge_space, is_blank, quoted, slice_span


def span_problems(samples: DataFrame) -> DataFrame:
    """`(id, pos, problem)` for every problem of a labelled span, found inside the sample's row."""
    text = F.col("text")
    size = F.length(text)

    def broken(s: Column) -> Column:
        return (s["start"] >= s["end"]) | (s["end"] > size)

    # A span out of bounds is reported and then ignored, so the next one is compared with the last good end.
    sweep = F.aggregate(
        F.coalesce("labels.spans", empty("struct<start:int,end:int,entity:string>")),
        F.struct(F.lit(0).alias("until"), empty("boolean").alias("late")),
        lambda acc, s: F.struct(
            F.when(broken(s), acc["until"]).otherwise(s["end"]).alias("until"),
            F.concat(acc["late"], F.array(~broken(s) & (s["start"] < acc["until"]))).alias("late"),
        ),
        lambda acc: acc["late"],
    )
    shape = F.concat(F.lit("span "), F.col("s.start").cast("string"), F.lit(".."), F.col("s.end").cast("string"))
    covered = slice_span(text, F.col("s.start"), F.col("s.end"))
    bad = broken(F.col("s"))
    found = F.array_compact(
        F.array(
            F.when(bad, F.concat(shape, F.lit(" is not inside 0.."), size.cast("string"))),
            F.when(~bad & F.col("late"), F.concat(shape, F.lit(" begins before the last one ends"))),
            F.when(~bad & has_edge_space(covered), F.concat(F.lit("blank edge: "), quoted(covered))),
            F.when(
                ~bad & ~F.coalesce(is_valid(F.col("s.entity"), covered), F.lit(True)),
                F.concat(F.lit("fails the check of "), F.col("s.entity"), F.lit(": "), quoted(covered)),
            ),
        )
    )
    return (
        samples.where("labels.kind = 'positive'")
        .withColumn("_late", sweep)
        .select("id", "text", F.posexplode(F.arrays_zip(F.col("labels.spans").alias("s"), F.col("_late").alias("late"))).alias("pos", "z"))
        .select("id", "text", "pos", "z.s", "z.late")
        .select("id", "pos", F.explode(found).alias("problem"))
    )


def validate(samples: DataFrame) -> DataFrame:
    """`(id, problem)` for every problem; no rows mean the corpus is consistent."""
    twice = samples.groupBy("id").count().where("count > 1").select("id", F.lit("id used twice").alias("problem"))
    blank = samples.where(is_blank(F.col("text"))).select("id", F.lit("blank text").alias("problem"))
    return twice.unionByName(blank).unionByName(span_problems(samples).select("id", "problem"))


def stats(samples: DataFrame) -> DataFrame:
    """`(measure, value, n)` composition counts in one pass over the samples.

    Each sample is folded into its few facts first; the facts are counted with map-side partials."""
    positive = F.col("labels.kind") == "positive"

    def fact(measure: str, value: Column | None = None) -> Column:
        return F.struct(F.lit(measure).alias("measure"), (F.lit("") if value is None else value).alias("value"))

    facts = F.concat(
        F.array(fact("samples"), fact("by_lang", F.col("lang")), fact("by_difficulty", F.col("difficulty")), fact("by_source", F.col("source"))),
        F.when(positive, F.array(fact("positive_samples"))).otherwise(F.array(fact("hard_negatives"), fact("hard_negatives_by_decoy", F.col("labels.decoy")))),
        F.when(positive & (F.size("labels.spans") == 0), F.array(fact("empty_samples"))).otherwise(empty("struct<measure:string,value:string>")),
        F.when(positive, F.transform("labels.spans", lambda s: fact("spans_by_entity", s["entity"]))).otherwise(empty("struct<measure:string,value:string>")),
    )
    return samples.select(F.explode(facts).alias("f")).groupBy("f.measure", "f.value").agg(F.count(F.lit(1)).alias("n"))


def not_carried_over(old: DataFrame, new: DataFrame) -> DataFrame:
    """Samples of `old` that `new` does not hold unchanged; empty means `new` contains `old`.

    A multiset difference of slim (id, digest) rows: one shuffle, no text in it."""
    content = F.sha2(F.to_json(F.struct("text", "labels", "lang", "difficulty", "source")), 256).alias("content")
    return old.select("id", content).exceptAll(new.select("id", content)).select("id")
