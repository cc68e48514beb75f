"""Near-duplicate documents by SetSketch registers over word shingles.

A document's shingles are a set of 64-bit hashes. Each of REGISTERS registers keeps the least of the set's exponentially
distributed hash values, on an exponential scale of base BASE and truncated to 16 bits: registers of a union are the greater ones
of its parts, and registers of similar sets agree. ROWS neighbouring registers make a band; documents that agree in a whole band
are candidates (a pair of similarity 0.8 is missed with a probability of 3e-6). Candidates are estimated by the joint likelihood of how
many registers are greater, equal and less, given the exact set sizes; what may reach the threshold is then verified on the full sets.

Nothing is done for each pair of a group:

1. Documents with equal sets are one class, found by a fingerprint of 128 bits.
2. In each band group, the classes are compared with the group's least and greatest member only.
3. The links found make components. Where a band group still holds several, members outside its largest component are
   compared with one member of that, chosen by hash for each band group; HUB_ROUNDS times.
4. Where a band group holds several components even then, its classes are joined across components by their rarest shingles. Sets of
   n and m >= n shingles that reach the threshold t have 2t/(1+t) n in common or more, so in any one order of shingles the first
   n - 2t/(1+t) n + 1 of the smaller set and the first m - tm + 1 of the larger share one, early enough for the rest to suffice. In order of
   frequency among these classes, versions of a template that do not reach the threshold differ in just those shingles, so
   they do not meet: nothing is made for their pairs.
5. All verified links make the final components.

So every pair of candidates is either compared, already connected, or shown to be under the threshold by its exact sets. Sets are rebuilt
from the texts of documents in question; a bit map, sized by their number up to `MAP_BITS`, keeps most other texts out of the shuffle.

Defined cases: a text without words, or null, has no shingles and links with nothing; with fewer words than a shingle has, the whole
sequence is the one shingle; a row without id links with nothing and stays; rows that repeat an id are one document (all of them
carry its component); an empty table gives no rows; further columns pass through `deduplicated` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievemask.llm.common import fresh, mixed, runs, table, text_slices, words, written
from sievemask.llm.components import components
from sievemask.llm.texts import heavy_keys, joined_by_share

BANDS, ROWS, HUB_ROUNDS = 32, 5, 1
REGISTERS = BANDS * ROWS
MAP_BITS = 1 << 27
BASE, RATE, TOP = 1.001, 20.0, 65534
SLACK = 0.15  # an estimate this far below the threshold is still verified: four standard errors or more
_PLUS = np.uint64(0x9E3779B97F4A7C15)
_FLIPS = mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64) * _PLUS)
_TIMES = mixed(_FLIPS) | np.uint64(1)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of adjacent texts, sorted within each, and where each text's begin (and the end).

    `first`: the first word of each text, and the total."""
    counts = np.diff(first)
    acc = np.full(len(hashes), np.uint64(width))
    for j in range(min(width, len(hashes))):  # with fewer words in all, no text has a shingle of `width`
        acc[: len(hashes) - j] = mixed(acc[: len(hashes) - j] * _PLUS + hashes[j:])
    parts, sizes = [], []
    for a, n in zip(first[:-1].tolist(), counts.tolist(), strict=True):
        if n >= width:
            part = np.sort(acc[a : a + n - width + 1])
            part = part[np.concatenate(([True], part[1:] != part[:-1]))]
        elif n:
            whole = np.full(1, np.uint64(n))
            for h in hashes[a : a + n]:
                whole = mixed(whole * _PLUS + h)
            part = whole
        else:
            part = hashes[:0]
        parts.append(part)
        sizes.append(len(part))
    return (np.concatenate(parts) if parts else hashes[:0]), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def registers(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SetSketch registers, a row for each of the sets that begin at `starts` (none is empty)."""
    out = np.empty((len(starts), REGISTERS), np.float64)
    buffer = np.empty_like(sets)
    for i in range(REGISTERS):
        np.bitwise_xor(sets, _FLIPS[i], out=buffer)
        np.multiply(buffer, _TIMES[i], out=buffer)
        out[:, i] = (np.minimum.reduceat(buffer, starts) >> np.uint64(11)).astype(np.float64)
    least = -np.log1p(-(out + 0.5) * 2.0**-53) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, TOP).astype(np.uint16)


def estimates(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity of the pairs of rows of a and b: the most likely one on a grid, given the sets' sizes."""
    over, under = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)

    def p(x):
        return -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)

    more, less = np.clip(p(u - v * j), 1e-12, 1), np.clip(p(v - u * j), 1e-12, 1)
    likelihood = over * np.log(more) + under * np.log(less) + (a.shape[1] - over - under) * np.log(np.clip(1 - more - less, 1e-12, 1))
    return np.take_along_axis(j, likelihood.argmax(1)[:, None], 1)[:, 0]


def _sets(docs: DataFrame, width: int, schema: str, make) -> DataFrame:
    """docs: id, text, then others. Rows that `make` builds from (columns of a slice, sets, offsets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in text_slices(batch.column(1), 1 << 19):
                hashes, _, _, first = words(data, offsets)
                yield make(batch.slice(at, len(offsets) - 1), *shingles(hashes, first, width))

    return docs.mapInArrow(run, schema)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """docs: id, text. One row each: id, n (set size), print (fingerprint of the set) and registers, both null for empty sets."""

    def make(rows: pa.RecordBatch, sets: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff(starts)
        some = np.flatnonzero(sizes)
        prints, regs = [None] * len(sizes), [None] * len(sizes)
        if len(some):
            begin = starts[:-1][some]
            halves = np.stack([np.add.reduceat(mixed(sets ^ _FLIPS[k]), begin) for k in (0, 1)], axis=1)
            found = registers(sets, begin)
            for k, i in enumerate(some.tolist()):
                prints[i], regs[i] = halves[k].tobytes(), found[k].tobytes()
        columns = [rows.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(regs, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["id", "n", "print", "regs"])

    return _sets(docs, width, "id long, n long, print binary, regs binary", make)


def _flat(rows: pa.RecordBatch, sets: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """A row for each shingle of each document."""
    ids = rows.column(0).cast(pa.int64()).take(pa.array(np.repeat(np.arange(len(starts) - 1), np.diff(starts)), pa.int64()))
    return pa.RecordBatch.from_arrays([ids, pa.array(sets.view(np.int64))], ["rep", "s"])


def _band_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    weights = mixed(np.arange(REGISTERS, dtype=np.uint64) + _PLUS).reshape(BANDS, ROWS) | np.uint64(1)
    for f in frames:
        if len(f):
            regs = np.frombuffer(b"".join(f["regs"]), np.uint16).reshape(len(f), BANDS, ROWS).astype(np.uint64)
            keys = mixed((regs * weights).sum(2) + weights[:, 0])
            yield pd.DataFrame({"key": keys.ravel().view(np.int64), "band": np.tile(np.arange(BANDS, dtype=np.int32), len(f)), "rep": np.repeat(f["rep"].to_numpy(), BANDS)})


def _likely(rows: DataFrame, threshold: float) -> DataFrame:
    """rows: a, b, n_a, n_b, regs_a, regs_b. The pairs (a, b) whose sizes and estimate allow the threshold."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 1024):
                g = f.iloc[at : at + 1024]
                a, b = (np.frombuffer(b"".join(g[c]), np.uint16).reshape(len(g), REGISTERS) for c in ("regs_a", "regs_b"))
                yield g[["a", "b"]][estimates(a, b, g["n_a"].to_numpy(float), g["n_b"].to_numpy(float)) >= threshold - SLACK]

    close = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9
    return rows.where(close).mapInPandas(run, "a long, b long")


def _held(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of docs (id, text) whose id may be in `wanted` (id), by a bit map of eight bits or more for each, up to MAP_BITS."""
    size = min(MAP_BITS, max(1 << 16, 1 << (8 * wanted.count()).bit_length()))
    place = F.pmod(F.xxhash64("id"), F.lit(size))
    word, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    bits = wanted.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return docs.join(F.broadcast(bits), word == F.col("_word")).where(F.col("_bits").bitwiseAND(bit) != 0).drop("_word", "_bits")


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, text of the documents in `wanted`; of rows that repeat an id, the least text."""
    return _held(docs, wanted).join(wanted, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))


def verified(pairs: DataFrame, docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """pairs: a, b (once each), docs: id, text. The pairs whose full sets reach the threshold.

    A document's set travels once for each of its partners as `a`, so the hubs should be `b`."""
    percent = round(100 * threshold)
    sides = written(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "asked")
    texts = written(_texts_of(docs, sides), "asked-texts")

    def make(rows: pa.RecordBatch, sets: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        made = [sets[s:e].tobytes() for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(made, pa.binary())], ["id", "whole"])

    def sets_of(side: str) -> DataFrame:
        mine = texts.join(pairs.select(F.col(side).alias("id")).distinct(), "id", "left_semi")
        return _sets(mine, width, "id long, whole binary", make).select(F.col("id").alias(side), F.col("whole").alias(f"set_{side}"))

    met = pairs.join(sets_of("a"), "a").join(sets_of("b"), "b").select("a", "b", "set_a", "set_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(q, p)
                common = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                same.append(100 * common >= percent * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    return met.mapInArrow(compare, "a long, b long")


def _rare_pairs(open_: DataFrame, docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """open_: rep, component, n. Pairs (a, b) of different components that share one of their rarest shingles where sets that reach the
    threshold have to."""
    p = round(100 * threshold)
    flat = written(_sets(_texts_of(docs, open_.select(F.col("rep").alias("id"))), width, "rep long, s long", _flat), "open-shingles")
    counts = written(flat.groupBy("s").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "shingle-counts")
    shared = joined_by_share(flat, counts, ["s"], heavy_keys(counts, ["s"], "f", flat.count()))
    # Shingles of one set only come first in its order and meet nothing; they are not here, but counted.
    own = Window.partitionBy("rep")
    alone = F.col("n") - F.count(F.lit(1)).over(own)
    ranked = shared.join(open_, "rep").withColumn("at", alone + F.row_number().over(own.orderBy("f", "s")))
    probe = written(ranked.where(F.col("at") <= F.col("n") - F.ceil(F.lit(p) * F.col("n") / 100) + 1).select("s", "rep", "component", "n", "at"), "rare-shingles")
    index = probe.where(F.col("at") <= F.col("n") - F.ceil(F.lit(2 * p) * F.col("n") / (100 + p)) + 1)
    index = index.select("s", *[F.col(c).alias(f"{c}_y") for c in ("rep", "component", "n", "at")])
    smaller = (F.col("n_y") < F.col("n")) | ((F.col("n_y") == F.col("n")) & (F.col("rep_y") < F.col("rep")))
    close = (F.col("n_y") * 100 >= F.col("n") * p) & (F.col("component_y") != F.col("component"))
    enough = (1 + F.least(F.col("n") - F.col("at"), F.col("n_y") - F.col("at_y"))) * (100 + p) >= (F.col("n") + F.col("n_y")) * p
    met = probe.join(index, "s").where(smaller & close & enough)
    return met.select(F.greatest("rep", "rep_y").alias("a"), F.least("rep", "rep_y").alias("b")).distinct()


def linked(docs: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id (least id reachable, its own included), kept (it is that id)."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = written(signatures(texts, width), "signatures")
    known = signed.where("print is not null and id is not null")
    reps = written(known.groupBy("print").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs")), "classes")

    entries = reps.select("rep", "regs").mapInPandas(_band_rows, "key long, band int, rep long")
    groups = written(entries.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("size > 1"), "band-groups")
    members = written(entries.join(groups, "key"), "band-members")

    to_hubs = members.select(F.col("rep").alias("a"), F.explode(F.array("lo", "hi")).alias("b")).where("a <> b")
    # The least member is a hub for the greatest, not the other way round.
    stars = to_hubs.select(F.when(F.col("a") < F.col("b"), F.col("b")).otherwise(F.col("a")).alias("x"), F.least("a", "b").alias("y"), "a", "b")
    once = stars.groupBy("x", "y").agg(F.min_by(F.struct("a", "b"), "b").alias("e")).select("e.a", "e.b")

    def with_registers(pairs: DataFrame) -> DataFrame:
        side = {s: reps.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("regs").alias(f"regs_{s}")) for s in ("a", "b")}
        return pairs.join(side["a"], "a").join(side["b"], "b")

    def new_pairs(pairs: DataFrame, tried: DataFrame, name: str) -> DataFrame:
        known = tried.select(F.greatest("a", "b").alias("_x"), F.least("a", "b").alias("_y"))
        return written(pairs.join(known, (F.greatest("a", "b") == F.col("_x")) & (F.least("a", "b") == F.col("_y")), "left_anti"), name)

    def open_members(rows: DataFrame, labels: DataFrame) -> DataFrame:
        """Rows of the band groups that hold several components, with their components."""
        placed = rows.drop("component").join(labels.withColumnRenamed("v", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        placed = written(placed, "band-components")
        ends = placed.groupBy("key").agg(F.min("component").alias("_l"), F.max("component").alias("_h")).where("_l <> _h")
        return written(placed.join(ends.select("key"), "key", "left_semi"), "open-members")

    tried = written(_likely(with_registers(once), threshold), "star-pairs")
    links = written(verified(tried, texts, width, threshold), "star-links")
    labels = components(links)
    members = open_members(members.drop("lo", "hi"), labels)
    for turn in range(HUB_ROUNDS):
        chosen = F.min_by("rep", F.xxhash64("rep", "key", F.lit(turn))).alias("hub")
        parts = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("_n"), chosen)
        largest = written(parts.groupBy("key").agg(F.max(F.struct("_n", "component", "hub")).alias("_top")), "hubs")
        outside = members.join(largest, "key").where(F.col("component") != F.col("_top.component"))
        pairs = outside.select(F.col("rep").alias("a"), F.col("_top.hub").alias("b")).distinct()
        pairs = written(_likely(with_registers(new_pairs(pairs, tried, "hub-pairs")), threshold), "hub-likely")
        found = written(verified(pairs, texts, width, threshold), "hub-links")
        tried = tried.unionByName(pairs)
        if found.isEmpty():
            break
        links = links.unionByName(found)
        labels = components(links)
        members = open_members(members, labels)

    open_ = written(members.select("rep", "component").distinct().join(reps.select("rep", "n"), "rep"), "open-classes")
    final = labels
    if not open_.isEmpty():
        crossing = new_pairs(_rare_pairs(open_, texts, width, threshold), tried, "crossing-pairs")
        rest = written(_likely(with_registers(crossing), threshold), "crossing-likely")
        if not rest.isEmpty():
            final = components(links.unionByName(written(verified(rest, texts, width, threshold), "crossing-links")))

    of_class = reps.join(final.withColumnRenamed("v", "rep"), "rep", "left").select("print", F.coalesce("component", "rep").alias("component_id"))
    of_class = written(of_class, "class-components")
    rows = signed.select("id", "n", "print").where("print is not null and id is not null").join(of_class, "print").select("id", "n", "component_id")
    alone = signed.where("print is null or id is null").select("id", "n", F.col("id").alias("component_id"))
    return rows.unionByName(alone).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def deduplicated(docs: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, one document of each component, with all their columns."""
    gone = written(linked(docs, width, threshold, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct(), "near-copies")
    mine = fresh(docs, "mine")
    return docs.withColumn(mine, F.col(id_col).cast("long")).join(gone, F.col(mine) == F.col("_gone"), "left_anti").select(*docs.columns)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"), width=2)


QUERIES = {"op1_minhash_dedup": (op1_minhash_dedup, None)}
