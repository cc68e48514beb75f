"""Reversible masking: a vault table of placeholders per session, masking and restoring by joins.

Messages are `(session, seq, text, ...)` with `seq` the message's place in its session. Only slim span rows are
numbered and joined; a text travels only when it may hold something to replace. A value or placeholder that many messages share
does not gather them: `joined_spread` leaves its rows where they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemask.functions import recognizers
from sievemask.functions.spans import pattern_spans, splice, unfolded
from sievemask.operators.detection import span_rows
from sievemask.operators.ranking import numbered
from sievemask.operators.spreading import joined_spread
from sievemask.session import frozen

# The placeholder's shape, as a pattern and as a token pattern that covers a whole text.
PLACEHOLDER = r"\[[A-Z_]+_[0-9]+\]"


def placeholder(label: Column, n: Column) -> Column:
    return F.concat(F.lit("["), label, F.lit("_"), n.cast("string"), F.lit("]"))


def session_spans(messages: DataFrame) -> DataFrame:
    """`(session, seq, start, end, label, value)` of everything detected, kept so it is computed once."""
    return frozen(span_rows(messages.select("session", "seq", "text"), ["session", "seq"]))


def build_vault(spans: DataFrame, make: Callable[[Column, Column], Column] = placeholder) -> DataFrame:
    """`(session, label, value, seq, start, n, placeholder)`: distinct values numbered by first appearance.

    Repeats are folded map-side before the shuffle, so a value mentioned a billion times costs one row per task.
    `make(label, n)` shapes the placeholder; pass a column function of your own to swap in other stand-ins."""
    first = (
        spans.groupBy("session", "label", "value")
        .agg(F.min(F.struct("seq", "start")).alias("at"))
        .select("session", "label", "value", "at.seq", "at.start")
    )
    return numbered(first, ["session", "label"], ["seq", "start"]).withColumn(
        "placeholder", make(F.col("label"), F.col("n"))
    )


def extended_vault(spans: DataFrame, known: DataFrame) -> DataFrame:
    """Vault rows for values `known` does not hold yet, numbered after the highest number in use."""
    fresh = build_vault(spans.join(known.select("session", "label", "value"), ["session", "label", "value"], "left_anti"))
    used = known.groupBy("session", "label").agg(F.max("n").alias("_used"))
    shifted = F.col("n") + F.coalesce(F.col("_used"), F.lit(0))
    return (
        fresh.join(used, ["session", "label"], "left")
        .withColumn("n", shifted)
        .withColumn("placeholder", placeholder(F.col("label"), F.col("n")))
        .drop("_used")
    )


def with_replacements(messages: DataFrame, replaced: DataFrame, touched: Column, out: str) -> DataFrame:
    """Splices `(session, seq, start, end, replacement)` into the texts.

    Texts that `touched` rules out pass through without a shuffle; the others meet their replacements by key."""
    per_message = replaced.groupBy("session", "seq").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "replacement"))).alias("_r")
    )
    edited = (
        messages.where(touched)
        .join(per_message, ["session", "seq"], "left")
        .withColumn(out, F.when(F.col("_r").isNull(), F.col("text")).otherwise(splice(F.col("text"), F.col("_r"))))
        .drop("_r")
    )
    untouched = messages.where(~F.coalesce(touched, F.lit(False))).withColumn(out, F.col("text"))
    return edited.unionByName(untouched)


def mask_with(messages: DataFrame, spans: DataFrame, vault: DataFrame, out: str = "masked") -> DataFrame:
    """Texts with the placeholders of their spans; `spans` are those of `session_spans`, which are at rest."""
    entries = vault.select("session", "label", "value", F.col("placeholder").alias("replacement"))
    replaced = joined_spread(spans, entries, ["session", "label", "value"], at_rest=True).select("session", "seq", "start", "end", "replacement")
    return with_replacements(messages, replaced, recognizers.may_hold(F.col("text")), out)


def mask(messages: DataFrame, out: str = "masked") -> tuple[DataFrame, DataFrame]:
    """Masks every message; returns the messages with `out`, and the vault."""
    spans = session_spans(messages)
    vault = build_vault(spans)
    return mask_with(messages, spans, vault, out), vault


def unmask(
    messages: DataFrame,
    vault: DataFrame,
    out: str = "unmasked",
    known_by: str | None = None,
    pattern: str = PLACEHOLDER,
) -> DataFrame:
    """Puts values back in one pass; placeholders the session does not know stay. Restored values are not
    looked at again.

    Placeholders are cut from the text as slim rows and joined on (session, placeholder), so the size of a
    session's vault never matters to a single row. With `known_by`, only vault entries whose first `seq` is not
    after that column of the message count. `pattern` describes the placeholders the vault was built with."""
    holds = F.col("text").rlike(pattern)
    extra = [known_by] if known_by and known_by != "seq" else []
    tokens = unfolded(messages.where(holds), ["session", "seq", *extra], pattern_spans(F.col("text"), pattern), "p").select(
        "session", "seq", *extra, "p.start", "p.end", F.col("p.value").alias("placeholder")
    )
    entries = vault.select("session", "placeholder", F.col("value").alias("replacement"), F.col("seq").alias("_since"))
    found = joined_spread(tokens, entries, ["session", "placeholder"])
    if known_by:
        found = found.where(F.col("_since") <= F.col(known_by))
    return with_replacements(messages, found.select("session", "seq", "start", "end", "replacement"), holds, out)


def redact(df: DataFrame, text: str = "text", out: str = "redacted") -> DataFrame:
    """Irreversible masking with `<LABEL>`: a projection, no vault."""
    r = F.transform(
        recognizers.detect(F.col(text)),
        lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"),
            F.concat(F.lit("<"), s["label"], F.lit(">")).alias("replacement"),
        ),
    )
    return df.withColumn("_spans", r).withColumn(out, splice(F.col(text), F.col("_spans"))).drop("_spans")
