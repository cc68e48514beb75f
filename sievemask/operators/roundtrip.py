"""Replaying scripted conversations against the built-in masker, set-based.

Inputs do not depend on replies, so all of them are masked first; placeholders are then found, replies rendered
with what was known at their turn, and the replies restored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemask.operators.alignment import (
    alignment_rows, conversation_turns, first_placeholders, missing_slot, render_chunk, with_alignment,
)
from sievemask.operators.holdback import restored_chunks
from sievemask.operators.vault import mask, unmask
from sievemask.schemas import TOOL_CALL
from sievemask.session import frozen


def replies(aligned: DataFrame, learned: DataFrame) -> DataFrame:
    """Adds `rendered` (chunks as the upstream sends them) and `script_error` to aligned turns."""
    # At most one entry per slot of the scenario, which is a row of its own already.
    known = learned.groupBy("conv_id").agg(F.collect_list(F.struct("slot", "text", "since")).alias("_known"))
    so_far = F.map_from_entries(
        F.transform(
            F.filter(F.coalesce("_known", F.array().cast("array<struct<slot:int,text:string,since:int>>")), lambda k: k["since"] <= F.col("turn")),
            lambda k: F.struct(k["slot"], k["text"]),
        )
    )
    problem = F.col("aligned.problem")
    unknown = missing_slot(F.col("reply.chunks"), F.col("_map"))
    error = F.when(problem.isNotNull(), problem).when(
        unknown.isNotNull(), F.concat(F.lit("slot not learned: "), unknown.cast("string"))
    )
    return (
        aligned.join(known, "conv_id", "left")
        .withColumn("_map", so_far)
        .withColumn("script_error", error)
        .withColumn(
            "rendered",
            F.when(F.col("script_error").isNull(), F.transform("reply.chunks", lambda c: render_chunk(c, F.col("_map")))),
        )
        .drop("_known", "_map")
    )


def replay(scenarios: DataFrame) -> dict[str, DataFrame]:
    """Masks, replays and restores every scenario.

    Returns `payloads`, `alignments`, `script_errors` and `observations`, the tables the audit reads."""
    turns = conversation_turns(scenarios).select(
        F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "*"
    )
    masked, vault = mask(turns)
    aligned = frozen(with_alignment(masked))
    alignments = alignment_rows(aligned)
    done = frozen(replies(aligned, first_placeholders(alignments)))
    fine = done.where("script_error is null and reply.kind <> 'http_error'")
    whole = fine.where("not stream").select("session", "seq", F.array_join("rendered", "").alias("text"))
    plain = unmask(whole, vault, "restored", "seq").select("session", "seq", "restored")
    pieces = fine.where("stream").select(
        "session", F.col("seq").alias("turn"), F.col("seq").cast("string").alias("stream"),
        F.posexplode("rendered").alias("seq", "chunk"), F.size("rendered").alias("_n"),
    ).withColumn("is_final", F.col("seq") == F.col("_n") - 1).drop("_n")
    streamed = (
        restored_chunks(pieces, vault, "turn")
        .groupBy("session", F.col("turn").alias("seq"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "restored"))), lambda x: x["restored"]), "").alias("restored"))
    )
    restored = plain.unionByName(streamed)
    none = F.array().cast(f"array<{TOOL_CALL}>")
    is_call = F.col("reply.kind") == "tool_call"
    is_error = F.col("script_error").isNotNull() | (F.col("reply.kind") == "http_error")
    got = F.coalesce("restored", F.lit(""))
    call = F.array(F.struct(F.col("reply.call_id").alias("id"), F.col("reply.name").alias("name"), got.alias("arguments")))
    observations = done.join(restored, ["session", "seq"], "left").select(
        "conv_id", "turn",
        F.when(is_error, "errored").otherwise("completed").alias("kind"),
        F.when(is_error, None).when(is_call, "").otherwise(got).alias("text"),
        F.when(is_error, None).when(is_call, call).otherwise(none).alias("tool_calls"),
        F.when(F.col("script_error").isNotNull(), F.col("script_error")).when(is_error, F.col("reply.body")).alias("message"),
        F.when(F.col("script_error").isNull() & is_error, F.col("reply.status")).alias("http_status"),
    )
    return {
        "payloads": done.select("conv_id", F.col("turn").alias("seq"), F.to_json(F.array("masked")).alias("body")),
        "alignments": alignments,
        "script_errors": done.where("script_error is not null").select(
            "conv_id", "turn", F.concat(F.lit("turn "), F.col("turn").cast("string"), F.lit(": "), "script_error").alias("message")
        ),
        "observations": observations,
    }
