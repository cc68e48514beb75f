"""Exact top-k search by inner product with a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance from it. Sorted by that key, the vectors of a cell fall into
annuli of at most `BLOCK` rows, each one row of the index with its least and greatest distance. A hot cell, or one vector
repeated a million times, only makes more annuli (ties are ordered by id).

A query first meets its own annulus; its k-th best score there is a floor t. By the triangle inequality a vector at distance
d(x,p) from pivot p is at least |d(q,p) - d(x,p)| from q, and |q-x|^2 = |q|^2 + |x|^2 - 2qx, so qx >= t needs
|d(q,p) - d(x,p)|^2 <= |q|^2 + max|x|^2 - 2t. That is an interval of distances in each cell: the annuli that touch it are
searched, all others are done with. Up to `GROUP` queries that are neighbours by (cell, distance) travel together.

Distances are doubles, in units of the greatest component where components are huge, and intervals are widened by what rounding may
take. Scores are exact: in floating point while every partial sum stays below 2^53, in 64-bit or Python integers beyond.

Pivots are PIVOTS rows, those with the least hash of their id: a bounded sample that fits the index, which holds every row.

Defined cases: vectors that are null or hold a null or non-finite component, and rows without id, take no part; vectors
of different lengths are compared over the components both have; rows that repeat an id and its vector count once; a query
with fewer than k candidates gets them all, an empty table gives no rows; scores beyond 64 bits are ranked exactly and returned as
the nearest 64-bit number; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from sievemask.llm.common import table, written
from sievemask.llm.integers import BIG_KEY, as_float, clipped, key_of, number_of, whole

PIVOTS, BLOCK, GROUP = 64, 2048, 256
BLOCK_SCHEMA = "block long, cell int, near double, far double, norm double, n int, ids binary, points binary"
GROUP_SCHEMA = "grp long, q_n int, q_ids binary, q_points binary, q_floor binary, visits array<struct<cell:int,low:double,high:double>>"


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v: the vectors that take part."""
    ok = F.forall(vector_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & ok).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


class Space:
    """How vectors are stored and measured: as small integers if they fit, else as doubles that become Python integers."""

    def __init__(self, width: int, most: int, scale: int):
        self.width, self.scale = width, scale
        self.exact, self.big = most * most * width < 2**53, most * most * width >= 2**63
        self.kind = "float64" if self.big else "int16" if most < 2**15 else "int32" if most < 2**31 else "int64"
        self.unit = max(1, most)
        self.score_bytes = BIG_KEY if self.big else 8

    def pack(self, vectors) -> np.ndarray:
        out = np.zeros((len(vectors), self.width), np.float64)
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        return out if self.big else whole(out, self.scale, False).astype(self.kind)

    def load(self, blob: bytes) -> np.ndarray:
        flat = np.frombuffer(blob, self.kind)
        return (whole(flat, self.scale, True) if self.big else flat).reshape(-1, self.width)

    def measured(self, points: np.ndarray) -> np.ndarray:
        """Integer points as doubles, in units."""
        if not self.big:
            return points.astype(np.float64)
        return np.array([(p * 2**60 // self.unit) / 2.0**60 for p in points.ravel().tolist()]).reshape(points.shape)

    def of_score(self, score) -> float:
        """A score in square units, rounded down."""
        return np.nextafter(as_float(int(score) * 2**64 // self.unit**2) / 2.0**64, -np.inf) if self.big else np.nextafter(float(score), -np.inf)

    def products(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Inner products as integers."""
        if self.big:
            return a @ b.T
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if self.exact else a.astype(np.int64) @ b.astype(np.int64).T


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * x @ p.T
    return np.sqrt(np.maximum(squares, 0))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id."""
    if len(scores) > 4 * k and scores.dtype != object:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        among = np.flatnonzero(scores >= least)
    else:
        among = np.arange(len(scores))
    return np.array(sorted(among.tolist(), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)


def top_k(rows: DataFrame, is_query, id_col: str, vector_col: str, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score. `is_query` turns a numpy array of ids into flags."""
    vectors = whole_vectors(rows, id_col, vector_col)
    size = vectors.agg(F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x))))).first()
    space = Space(max(1, size[0] or 1), (int(size[1] or 0) + 1) * scale, scale)
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()
    pivots = space.measured(space.load(space.pack([r["v"] for r in sample]).tobytes()))
    apart = 4e-7 * float(np.sqrt((pivots * pivots).sum(1)).max()) if len(pivots) else 0.0

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            points = space.pack(f["v"])
            if not len(points):
                continue
            away = _distances(space.measured(space.load(points.tobytes())), pivots)
            cell = away.argmin(1)
            flat = [p.tobytes() for p in points]
            yield pd.DataFrame({"cell": cell.astype(np.int32), "away": away[np.arange(len(f)), cell], "id": f["id"], "point": flat})

    def annuli(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, made, held = TaskContext.get().partitionId() << 32, 0, None
        for f in frames:
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            f = f.drop_duplicates(["cell", "away", "id", "point"], ignore_index=True)
            ends = np.flatnonzero(np.diff(f["cell"].to_numpy())) + 1
            held, out = None, []
            bounds = [0, *ends.tolist(), len(f)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                for at in range(a, b, BLOCK):
                    part = f.iloc[at : min(at + BLOCK, b)]
                    if b == len(f) and at + BLOCK >= b:  # more may follow
                        held = part
                    elif len(part):
                        out.append(packed(part, base + made))
                        made += 1
            if out:
                yield pd.DataFrame(out)
        if held is not None and len(held):
            yield pd.DataFrame([packed(held, base + made)])

    def packed(part: pd.DataFrame, block: int) -> dict:
        points = b"".join(part["point"])
        norm = float(np.sqrt((space.measured(space.load(points)) ** 2).sum(1)).max())
        return {
            "block": block, "cell": int(part["cell"].iloc[0]), "near": float(part["away"].min()), "far": float(part["away"].max()), "norm": norm,
            "n": len(part), "ids": part["id"].to_numpy(np.int64).tobytes(), "points": points,
        }

    laid_out = vectors.mapInPandas(keyed, "cell int, away double, id long, point binary").repartitionByRange("cell", "away", "id").sortWithinPartitions("cell", "away", "id")
    index = written(laid_out.mapInPandas(annuli, BLOCK_SCHEMA), "annuli")
    norms = {r["cell"]: r["norm"] for r in index.groupBy("cell").agg(F.max("norm").alias("norm")).collect()}  # a row for each pivot

    def asked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each query: where it stands, and what its own annulus says its k-th best score is at least."""
        for f in frames:
            for r in f.itertuples():
                ids = np.frombuffer(r.ids, np.int64)
                chosen = np.flatnonzero(is_query(ids))
                if not len(chosen):
                    continue
                points = space.load(r.points)
                scores = space.products(points[chosen], points)
                floors = np.full(len(chosen), -np.inf)
                for j, own in enumerate(chosen):
                    others = np.flatnonzero(ids != ids[own])
                    if len(others) >= k:
                        floors[j] = space.of_score(scores[j][others[_best(scores[j][others], ids[others], k)[-1]]])
                away = _distances(space.measured(points[chosen]), pivots[[r.cell]])[:, 0]
                step = len(r.points) // len(ids)
                flat = [r.points[i * step : (i + 1) * step] for i in chosen.tolist()]
                yield pd.DataFrame({"cell": np.int32(r.cell), "away": away, "id": ids[chosen], "floor": floors, "point": flat})

    def grouped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, made = TaskContext.get().partitionId() << 32, 0
        for f in frames:
            for at in range(0, len(f), GROUP):
                part = f.iloc[at : at + GROUP]
                blob, floors = b"".join(part["point"]), part["floor"].to_numpy()
                q = space.measured(space.load(blob))
                squares, away = (q * q).sum(1), _distances(q, pivots)
                visits = []
                for cell, norm in norms.items():
                    reach = squares + norm * norm - 2 * floors
                    slack = 1e-3 + apart + 4e-7 * (np.sqrt(squares) + norm)
                    reach = np.where(reach >= -1e-6 * (1 + squares + norm * norm), np.sqrt(np.maximum(reach, 0)) * (1 + 1e-9) + slack, -np.inf)
                    some = reach >= 0
                    if some.any():
                        d, s = away[some, cell], reach[some]
                        visits.append({"cell": cell, "low": float((d - s).min()), "high": float((d + s).max())})
                made += 1
                yield pd.DataFrame([(base + made, len(part), part["id"].to_numpy(np.int64).tobytes(), blob, floors.tobytes(), visits)], columns=["grp", "q_n", "q_ids", "q_points", "q_floor", "visits"])

    laid = index.select("block", "cell", "ids", "points").mapInPandas(asked, "cell int, away double, id long, floor double, point binary")
    queries = written(laid.repartitionByRange("cell", "away", "id").sortWithinPartitions("cell", "away", "id").mapInPandas(grouped, GROUP_SCHEMA), "query-groups")
    visits = queries.select("grp", F.explode("visits").alias("v")).select("grp", "v.*")
    rings = index.select("block", F.col("cell").alias("_cell"), "near", "far")
    pairs = visits.join(rings, (F.col("cell") == F.col("_cell")) & (F.col("far") >= F.col("low")) & (F.col("near") <= F.col("high"))).select("grp", "block")
    met = pairs.join(queries.drop("visits"), "grp").join(index.select("block", "ids", "points"), "block")

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                ids, q_ids = np.frombuffer(r.ids, np.int64), np.frombuffer(r.q_ids, np.int64)
                scores = space.products(space.load(r.q_points), space.load(r.points))
                measured = scores if not space.big else np.array([[space.of_score(x) for x in row] for row in scores.tolist()])
                floors = np.frombuffer(r.q_floor, np.float64)
                out = []
                for j in range(r.q_n):
                    fit = np.flatnonzero((measured[j] >= floors[j]) & (ids != q_ids[j]))
                    if len(fit):
                        best = fit[_best(scores[j][fit], ids[fit], k)]
                        out.append(pd.DataFrame({"query_id": q_ids[j], "vec_id": ids[best], "score": [key_of(x, space.score_bytes) for x in scores[j][best]]}))
                if out:
                    yield pd.concat(out, ignore_index=True)

    found = met.select("q_n", "q_ids", "q_points", "q_floor", "ids", "points").mapInPandas(scored, "query_id long, vec_id long, score binary")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    def numbers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(score=pd.Series([clipped(number_of(x)) for x in f["score"]], dtype="int64"))

    return best.mapInPandas(numbers, "query_id long, rank int, vec_id long, score long")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), lambda ids: ids % 100 == 0, "vec_id", "embedding")


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INT AS rank, vec_id, score FROM r WHERE n <= 10
"""

QUERIES = {"op7_topk": (op7_topk, OP7_SQL)}
