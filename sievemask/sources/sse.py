"""Captured server-sent-event bodies as rows of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemask.functions.spans import unfolded
from sievemask.functions.text import SPACE
from sievemask.operators.ranking import numbered, numbered_in_key, running_total, running_total_in_key
from sievemask.operators.spreading import by_size

EVENT = "struct<name:string,data:string>"


def _event(block: Column, emit_tail: bool) -> Column:
    """`struct<name,data,n_names,n_data>` of the lines of a block."""
    lines = F.split(block, "\n", -1)
    names = F.filter(lines, lambda x: x.startswith("event:"))
    data = F.filter(lines, lambda x: x.startswith("data:"))
    name = F.regexp_replace(F.substring(F.try_element_at(names, F.lit(-1)), 7, 1 << 30), rf"\A[{SPACE}]+|[{SPACE}]+\z", "")
    strip = r"\A +" if emit_tail else r"\A "
    return F.struct(
        name.alias("name"),
        F.array_join(F.transform(data, lambda x: F.regexp_replace(F.substring(x, 6, 1 << 30), strip, "")), "\n").alias("data"),
        F.size(names).alias("n_names"), F.size(data).alias("n_data"),
    )


def _counts(e: Column, emit_tail: bool) -> Column:
    return (e["n_data"] > 0) if emit_tail else ((e["n_data"] > 0) | (e["n_names"] > 0))


def events_of(body: Column, emit_tail: bool = False) -> Column:
    """`array<struct<name,data>>` of one captured body.

    A blank line ends an event; a block that is not ended is dropped unless `emit_tail`. The strict form strips
    one space after `data:` and keeps an event with only a name; the tail form is line-based: it strips all
    spaces and needs data."""
    blocks = F.split(F.replace(body, F.lit("\r"), F.lit("")), "\n\n", -1)
    ended = blocks if emit_tail else F.slice(blocks, F.lit(1), F.size(blocks) - 1)
    kept = F.filter(F.transform(ended, lambda b: _event(b, emit_tail)), lambda e: _counts(e, emit_tail))
    return F.transform(kept, lambda e: F.struct(e["name"].alias("name"), e["data"].alias("data")))


def event_rows(bodies: DataFrame, keys: list[str], body: str = "body", emit_tail: bool = False) -> DataFrame:
    return unfolded(bodies, keys, events_of(F.col(body), emit_tail), "e", "pos").select(*keys, "pos", "e.name", "e.data")


def pieced_event_rows(pieces: DataFrame, keys: list[str], order: str, piece: str = "piece", emit_tail: bool = False) -> DataFrame:
    """The same rows for bodies that were captured in pieces, cut anywhere: `keys` name a body, `order` numbers its pieces.

    Nothing gathers a long body: those that hold more than a small share of all pieces are spread over many tasks, each of the others is one
    task's. Two line ends close a block, taken in pairs from the left, so all a piece has to know of those before it is
    whether a line end is left over: pieces with other characters say so themselves, and pieces of line ends only add to it, which a
    running total carries on. Another running total numbers the blocks; the parts of one block then meet by that number."""

    return by_size(pieces, keys, lambda rows: _pieced(rows, keys, order, piece, emit_tail, False), lambda rows: _pieced(rows, keys, order, piece, emit_tail, True))


def _pieced(pieces: DataFrame, keys: list[str], order: str, piece: str, emit_tail: bool, spread: bool) -> DataFrame:
    total, number = (running_total, numbered) if spread else (running_total_in_key, numbered_in_key)
    text = F.replace(F.coalesce(F.col(piece), F.lit("")), F.lit("\r"), F.lit(""))
    rows = pieces.select(*keys, F.col(order).alias("_at"), text.alias("_text")).where("_text <> ''")
    ends = F.length(F.regexp_extract("_text", r"(\n*)\z", 1))
    # Pieces that hold more than line ends begin a stretch; inside a stretch line ends add up.
    marked = rows.withColumn("_ends", ends).withColumn("_begins", (F.length("_text") > F.col("_ends")).cast("long"))
    stretched = total(marked, keys, ["_at"], "_begins", "_stretch")
    summed = total(stretched, [*keys, "_stretch"], ["_at"], "_ends", "_upto")
    # What the stretch held before this piece; a piece that begins one looks at the end of the stretch before.
    if spread:
        closing = summed.groupBy(*keys, (F.col("_stretch") + 1).alias("_stretch")).agg(F.max("_upto").alias("_before"))
        known = summed.join(closing, [*keys, "_stretch"], "left")
    else:
        known = summed.withColumn("_before", F.lag("_upto").over(Window.partitionBy(*keys).orderBy("_at")))
    over = F.when(F.col("_begins") == 1, F.coalesce("_before", F.lit(0))).otherwise(F.col("_upto") - F.col("_ends")) % 2
    whole = F.concat(F.repeat(F.lit("\n"), over.cast("int")), F.col("_text"))
    left = F.col("_upto") % 2
    parts = F.split(F.substring("_whole", F.lit(1), F.length("_whole") - left), "\n\n", -1)
    cut = known.withColumn("_whole", whole).withColumn("_parts", parts).withColumn("_closed", (F.size("_parts") - 1).cast("long"))
    placed = total(cut.select(*keys, "_at", "_parts", "_closed"), keys, ["_at"], "_closed", "_all")
    part = placed.select(*keys, "_at", (F.col("_all") - F.col("_closed")).alias("_first"), "_closed", F.posexplode("_parts").alias("_j", "_part"))
    # A block's group holds the parts of one event.
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_j", "_part"))), lambda x: x["_part"]), "")
    blocks = part.groupBy(*keys, (F.col("_first") + F.col("_j")).alias("_block")).agg(joined.alias("_text"), F.max(F.col("_j") < F.col("_closed")).alias("_ended"))
    made = blocks.where(F.lit(emit_tail) | F.col("_ended")).withColumn("_e", _event(F.col("_text"), emit_tail)).where(_counts(F.col("_e"), emit_tail))
    return number(made, keys, ["_block"], "_n").select(*keys, (F.col("_n") - 1).cast("int").alias("pos"), F.col("_e.name").alias("name"), F.col("_e.data").alias("data"))
