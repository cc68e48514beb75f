"""Hard negatives by threshold joins over an inverted index with norm bounds.

For each anchor the `positives` best rows of its label are found, then for each positive the first `negatives` rows of other labels
whose score lies between `low` and `high` hundredths of the positive's. Both are searches for the best rows of a window of scores, and
both run in rounds: all rows that reach an anchor's threshold are found by a join; an anchor whose windows are full, or whose threshold is
at the lower end of its windows, is done; the others go into the next round with a lower threshold, the last of which excludes nothing.

The join. Dimensions are in one order, weak ones (of small mean square) first. A row's first dimensions whose norm, times an anchor's, cannot
reach the threshold are left out of the index: a row that shares none of its indexed dimensions with an anchor cannot reach it. Postings
of the others give partial scores; partial score plus the product of what remains of both norms bounds the score, and only pairs whose
bound reaches the threshold are finished. The index is kept in blocks of `BLOCK` rows of one label, sorted by norm, so whole blocks fall to the
bound of their greatest norm; anchors are the stated query set, in groups of `GROUP` of one label. A hot label has more blocks.

Scores are integers and exact: in floating point while every partial sum stays below 2^53, in Python integers beyond. They travel as
fixed-width big-endian keys, which sort as numbers do.

First thresholds come from the scores against `SAMPLE` rows (least hash of id): they decide how many rounds there are, not what is found.

Defined cases: rows without id, label or vector, or with a null or non-finite component, take no part; vectors of different lengths are
compared over the components both have; of rows that repeat an id, the one with the least label, then vector, stays; an anchor without
other rows of its label gives no rows; scores beyond 64 bits are ranked exactly and returned as the nearest 64-bit number; an empty
table gives no rows; further columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from sievemask.llm.common import table, written
from sievemask.llm.integers import BIG_KEY, as_float, as_floats, clipped, key_of, number_of, whole

BLOCK, GROUP, SAMPLE, SHARDS = 4096, 512, 1024, 64
QUANTILES = (0.99, 0.9, 0.5, 0.0)  # of the sample, for positives
DEPTHS = (0.25, 0.5, 1.0)  # of the way down from the lowest upper end to the lowest lower end, for negatives
SLOT = "struct<slot:int,positive:long,score:binary>"
ANCHOR = f"anchor long, label long, point binary, slots array<{SLOT}>"
FOUND = "anchor long, slot int, positive long, positive_score binary, found long, score binary"


class Space:
    """What all tasks know of the vectors: the order of dimensions, their number, and how they are stored."""

    def __init__(self, width: int, order: np.ndarray, big: bool, kind: str):
        self.width, self.order, self.big, self.kind = width, order, big, kind

    def pack(self, vectors, scale: int) -> list[bytes]:
        out = []
        for v in vectors:
            row = np.zeros(self.width, np.float64)
            row[: len(v)] = v
            row = row[self.order]
            out.append(row.tobytes() if self.big else whole(row, scale, False).astype(self.kind).tobytes())
        return out

    def load(self, blob: bytes, scale: int) -> np.ndarray:
        """Rows of integers: as doubles, which are exact, or as Python integers."""
        if self.big:
            return whole(np.frombuffer(blob, np.float64), scale, True).reshape(-1, self.width)
        return np.frombuffer(blob, self.kind).reshape(-1, self.width).astype(np.float64)


def _lengths(points: np.ndarray) -> np.ndarray:
    """Norms of the first 0, 1, ... dimensions of each row."""
    with np.errstate(over="ignore"):
        squares = as_floats(points) ** 2
        return np.sqrt(np.concatenate([np.zeros((len(points), 1)), np.cumsum(squares, axis=1)], axis=1))


def reaching(queries: np.ndarray, rows: np.ndarray, limits: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, rows, scores) of all pairs whose score is the query's limit or more."""
    q_norms, x_norms = _lengths(queries), _lengths(rows)
    with np.errstate(all="ignore"):
        rates = np.where(limits > -np.inf, limits * (1 - 1e-9) - 1, -np.inf) / np.maximum(q_norms[:, -1], 1e-300)
        least = rates.min() if len(rates) else -np.inf
        left_out = (x_norms < least).sum(axis=1)  # the norm of that many dimensions less one stays under every anchor's rate
        left_out = np.maximum(left_out - 1, 0)
        indexed = np.flatnonzero(~(x_norms[:, -1] < least))
        if not len(indexed):
            return
        x, cut = rows[indexed], left_out[indexed]
        posted = np.where(np.arange(x.shape[1])[None, :] >= cut[:, None], x, 0)
        partial = queries @ posted.T
        rest = q_norms[:, cut] * x_norms[indexed, cut][None, :]
        known = as_floats(partial)
        bound = known + rest + 1e-9 * (np.abs(known) + rest) + 1
        for i in range(len(queries)):
            hits = np.flatnonzero(~(bound[i] < limits[i]))
            if len(hits):
                scores = partial[i, hits] + (np.where(np.arange(x.shape[1])[None, :] < cut[hits, None], x[hits], 0) @ queries[i] if cut[hits].any() else 0)
                fit = np.flatnonzero(np.array(scores >= limits[i], bool)) if limits[i] > -np.inf else np.arange(len(hits))
                if len(fit):
                    yield i, indexed[hits[fit]], scores[fit]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[int]:
    """Places of the k best: highest score, then smallest id."""
    among = np.arange(len(scores))
    if scores.dtype != object and len(scores) > 4 * k:
        among = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return sorted(among.tolist(), key=lambda i: (-scores[i], ids[i]))[:k]


def mined(
    rows: DataFrame, is_anchor: Column, id_col: str, label_col: str, vector_col: str, scale: int = 256, positives: int = 5, negatives: int = 3,
    low: int = 50, high: int = 95,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. `is_anchor` is a condition on the column `id`."""
    finite = F.forall(vector_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    usable = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    plain = usable.select(F.col(id_col).cast("long").alias("id"), F.struct(F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v")).alias("r"))
    vectors = plain.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.label", "r.v")

    def energies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            total: dict[int, list[float]] = {}
            for v in f["v"]:
                for i, x in enumerate(np.abs(np.asarray(v, np.float64)).tolist()):
                    t = total.setdefault(i, [0.0, 0.0])
                    t[0], t[1] = t[0] + min(x, 1e100) ** 2, max(t[1], x)
            yield pd.DataFrame([(i, *t) for i, t in total.items()], columns=["dim", "energy", "most"]).astype({"dim": "int32"})

    measured = vectors.mapInPandas(energies, "dim int, energy double, most double").groupBy("dim").agg(F.sum("energy").alias("energy"), F.max("most").alias("most"))
    dims = sorted(measured.collect(), key=lambda r: r["dim"])  # a row for each dimension
    most = max((int(r["most"]) + 1) * scale for r in dims) if dims else 0
    width = max(1, len(dims))
    order = np.argsort([r["energy"] for r in dims], kind="stable") if dims else np.zeros(1, np.int64)
    big = most * most * width >= 2**53
    space = Space(width, order, big, "float64" if big else "int16" if most < 2**15 else "int32" if most < 2**31 else "int64")
    score_bytes = BIG_KEY if big else 8

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            points = space.pack(f["v"], scale)
            norms = _lengths(space.load(b"".join(points), scale))[:, -1] if len(f) else []
            yield pd.DataFrame({"id": f["id"], "label": f["label"], "point": points, "norm": norms})

    points = written(vectors.mapInPandas(packed, "id long, label long, point binary, norm double"), "points")
    sample = points.select("point").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    seen = space.load(b"".join(bytes(r["point"]) for r in sample), scale) if sample else np.zeros((0, width))

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, made, held = TaskContext.get().partitionId() << 32, 0, None
        for f in _with_end(frames):
            last = f is None
            f = held if last else f if held is None else pd.concat([held, f], ignore_index=True)
            held = None
            if f is None or not len(f):
                continue
            ends = [0, *(np.flatnonzero(np.diff(f["label"].to_numpy())) + 1).tolist(), len(f)]
            for a, b in zip(ends, ends[1:], strict=False):
                for at in range(a, b, BLOCK):
                    part = f.iloc[at : min(at + BLOCK, b)]
                    if not last and b == len(f) and at + BLOCK >= b:  # more may follow
                        held = part
                        continue
                    made += 1
                    whole = {"block": [base + made], "label": [part["label"].iloc[0]], "norm": [part["norm"].max()], "shard": [(base + made) % SHARDS]}
                    yield pd.DataFrame({**whole, "ids": [part["id"].to_numpy(np.int64).tobytes()], "points": [b"".join(part["point"])]})

    laid_out = points.repartitionByRange("label", "norm", "id").sortWithinPartitions("label", "norm", "id")
    index = written(laid_out.mapInPandas(blocks, "block long, label long, norm double, shard int, ids binary, points binary"), "index")

    def limits_of(queries: np.ndarray, slots: list, step: int, same: bool) -> np.ndarray:
        """The threshold of each anchor in a round."""
        if same:
            if QUANTILES[step] == 0.0 or not len(seen):
                return np.full(len(queries), -np.inf)
            scores = np.sort(as_floats(queries @ seen.T), axis=1)
            return np.where(np.isfinite(scores), scores, -np.inf)[:, int(QUANTILES[step] * (scores.shape[1] - 1))]
        out = np.empty(len(queries))
        for i, some in enumerate(slots):
            ends = [_window(number_of(s["score"]), low, high) for s in some]
            top, bottom = min(e[1] for e in ends), min(e[0] for e in ends)
            out[i] = as_float(bottom if DEPTHS[step] == 1.0 else max(bottom, top - int(DEPTHS[step] * 100) * (top - bottom) // 100))
        return np.where(np.isnan(out) | np.isposinf(out), -np.inf, out)  # without a threshold that a double can hold, none

    def groups(step: int, same: bool):
        def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            base, count = TaskContext.get().partitionId() << 32, 0
            for f in frames:
                for label, part in f.groupby("label", sort=False):
                    for at in range(0, len(part), GROUP):
                        some = part.iloc[at : at + GROUP]
                        queries = space.load(b"".join(some["point"]), scale)
                        slots = [[_as_dict(s) for s in x] for x in some["slots"]]
                        limits = limits_of(queries, slots, step, same)
                        with np.errstate(all="ignore"):
                            rates = limits / np.maximum(_lengths(queries)[:, -1], 1e-300)
                            need = float(np.where(np.isnan(rates), -np.inf, rates).min())
                        count += 1
                        yield pd.DataFrame(
                            {"grp": [base + count], "g_label": [label], "need": [need], "anchors": [some["anchor"].to_numpy(np.int64).tobytes()],
                             "queries": [b"".join(some["point"])], "limits": [limits.tobytes()], "slots": [slots]}
                        )

        return made

    def scored(k: int, same: bool):
        def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for r in f.itertuples():
                    anchors, ids = np.frombuffer(r.anchors, np.int64), np.frombuffer(r.ids, np.int64)
                    queries, held = space.load(r.queries, scale), space.load(r.points, scale)
                    out = []
                    for i, places, scores in reaching(queries, held, np.frombuffer(r.limits, np.float64)):
                        for slot in r.slots[i]:
                            s = _as_dict(slot)
                            if same:
                                fit = np.flatnonzero(ids[places] != anchors[i])
                            else:
                                bottom, top = _window(number_of(s["score"]), low, high)
                                fit = np.flatnonzero(np.array((scores >= bottom) & (scores <= top), bool))
                            best = fit[_best(scores[fit], ids[places[fit]], k)] if len(fit) else []
                            out += [(anchors[i], s["slot"], s["positive"], s["score"], ids[places[j]], key_of(scores[j], score_bytes)) for j in best]
                    if out:
                        yield pd.DataFrame(out, columns=["anchor", "slot", "positive", "positive_score", "found", "score"])

        return made

    def search(anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """The first k rows of each anchor's windows, over all rounds: anchor, slot, positive, positive_score, found, score, place."""
        steps = len(QUANTILES if same else DEPTHS)
        done = []
        for step in range(steps):
            asked = written(anchors.repartitionByRange("label", "anchor").sortWithinPartitions("label", "anchor").mapInPandas(
                groups(step, same), f"grp long, g_label long, need double, anchors binary, queries binary, limits binary, slots array<array<{SLOT}>>"
            ), "anchor-groups")
            slim = asked.select("grp", "g_label", "need", F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1))).alias("shard"))
            rings = index.select("block", "label", "norm", "shard")
            kind = F.col("label") == F.col("g_label") if same else F.col("label") != F.col("g_label")
            reach = ~(F.col("norm") * (1 + 1e-9) + 1 < F.col("need"))
            pairs = slim.join(rings, "shard").where(kind & reach).select("grp", "block")
            met = pairs.join(asked, "grp").join(index.select("block", "ids", "points"), "block").select("anchors", "queries", "limits", "slots", "ids", "points")
            place = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "found"))
            best = written(met.mapInPandas(scored(k, same), FOUND).withColumn("place", place).where(F.col("place") <= k), "best")
            if step == steps - 1:
                done.append(best)
                break
            full = best.groupBy("anchor", "slot").agg(F.max("place").alias("n")).where(F.col("n") == k).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
            filled = written(anchors.select("anchor", F.size("slots").alias("slots")).join(full, "anchor").where("n = slots").select("anchor"), "filled")
            done.append(best.join(filled, "anchor", "left_semi"))
            anchors = written(anchors.join(filled, "anchor", "left_anti"), "anchors")
            if anchors.isEmpty():
                break
        out = done[0]
        for more in done[1:]:
            out = out.unionByName(more)
        return out

    one = F.array(F.struct(F.lit(0).alias("slot"), F.lit(None).cast("long").alias("positive"), F.lit(None).cast("binary").alias("score"))).cast(f"array<{SLOT}>")
    anchors = points.where(is_anchor).select(F.col("id").alias("anchor"), "label", "point", one.alias("slots"))
    near = search(anchors, positives, True)
    slots = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct((F.col("place") - 1).alias("slot"), F.col("found").alias("positive"), "score"))).cast(f"array<{SLOT}>").alias("slots"))
    found = search(written(anchors.drop("slots").join(slots, "anchor"), "anchors"), negatives, False)

    def numbers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for c in ("positive_score", "negative_score"):
                f[c] = pd.Series([clipped(number_of(k)) for k in f[c]], dtype="int64")
            yield f

    named = found.select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("place").cast("int").alias("rank"), F.col("found").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
    return named.mapInPandas(numbers, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def _with_end(frames):
    yield from frames
    yield None


def _as_dict(s) -> dict:
    return s.asDict() if hasattr(s, "asDict") else s


def _window(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest score s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(rows.withColumn("label", label), F.col("id") % 50 == 0, "vec_id", "label", "embedding")


OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

QUERIES = {"op13_hard_negatives": (op13_hard_negatives, OP13_SQL)}
