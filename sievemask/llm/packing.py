"""Packing tokenized documents into sequences: order-preserving dynamic programming over window cuts.

Documents of a task follow each other in their order. Cuts may fall at document ends (free), at sentence or line ends, and, where
none is near, inside a sentence; the last two cost something. A plan's cost is padding, plus the price of its cuts, plus a
price for each sequence. With f(j) the least cost up to boundary j at token t(j),

    f(j) = price(j) + SEQUENCE + min over i, t(j) - t(i) <= 2048, of f(i) + 2048 - (t(j) - t(i))

f(i) + t(i) is all that depends on i, so a monotone queue holds the window's minimum: each boundary enters and leaves once. A
window whose length is a power of two needs no padding; those eleven transitions are looked up besides.

Memory is bounded by CHUNK tokens and one document: a plan ends with a document after at most that many.

Defined cases: a null or empty text is the closing id alone; a document longer than a sequence spreads over several; rows
that repeat an id are packed each on its own; a null id stays null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from sievemask.llm.common import table
from sievemask.llm.tokens import default_path, encoder

WINDOW, CHUNK, END_ID = 2048, 1 << 19, 1
SENTENCE_PRICE, INSIDE_PRICE, SEQUENCE_PRICE = 6.0, 24.0, 64.0
GAP = 64  # tokens without a boundary after which cuts inside a sentence are offered
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, with 0 first, and their prices. No gap is wider than GAP; the tail may be cut anywhere."""
    total = len(ids)
    price = np.full(total + 1, np.inf)
    ends = np.flatnonzero(sentence_end[ids]) + 1
    price[ends] = SENTENCE_PRICE
    price[doc_ends] = 0
    price[0] = 0
    known = np.flatnonzero(np.isfinite(price))
    for a, b in zip(known[:-1][np.diff(known) > GAP].tolist(), known[1:][np.diff(known) > GAP].tolist(), strict=True):
        price[a + GAP : b : GAP] = INSIDE_PRICE
    tail = price[max(0, total - window) :]
    tail[~np.isfinite(tail)] = INSIDE_PRICE
    places = np.flatnonzero(np.isfinite(price))
    return places, price[places]


def cuts(places: np.ndarray, prices: np.ndarray, window: int = WINDOW) -> list[int]:
    """The places of a cheapest plan's cuts, 0 and the end included. Of equal plans, the one with later cuts."""
    n = len(places)
    exact: dict[int, list[int]] = {}
    size = 1
    while size <= window:
        at = np.searchsorted(places, places - size)
        hit = np.flatnonzero((places >= size) & (places[np.minimum(at, n - 1)] == places - size))
        for j, i in zip(hit.tolist(), at[hit].tolist(), strict=True):
            exact.setdefault(j, []).append(i)
        size *= 2
    t, price = places.tolist(), prices.tolist()
    cost, came = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, n):
        while t[j] - t[queue[0][1]] > window:
            queue.popleft()
        key, best = queue[0]
        least = key + window - t[j]
        for i in exact.get(j, ()):
            if cost[i] < least:
                least, best = cost[i], i
        cost[j], came[j] = least + price[j] + SEQUENCE_PRICE, best
        key = cost[j] + t[j]
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    path, j = [t[-1]], n - 1
    while j > 0:
        j = came[j]
        path.append(t[j])
    return path[::-1]


def _pieces(docs: list[tuple[int | None, bytes]], sentence_end: np.ndarray, first_sequence: int, window: int) -> tuple[list, int]:
    data = b"".join(d for _, d in docs)
    ids = np.frombuffer(data, "<u4")
    doc_ends = np.cumsum([len(d) // 4 for _, d in docs])
    doc_starts = np.concatenate(([0], doc_ends[:-1]))
    path = np.array(cuts(*boundaries(ids, doc_ends, sentence_end, window), window))
    starts = np.union1d(path[:-1], doc_starts)
    lengths = np.diff(np.append(starts, len(ids)))
    doc = np.searchsorted(doc_starts, starts, side="right") - 1
    window_of = np.searchsorted(path, starts, side="right") - 1
    view = memoryview(data)
    crcs = [zlib.crc32(view[4 * a : 4 * (a + b)]) for a, b in zip(starts.tolist(), lengths.tolist(), strict=True)]
    names = [docs[i][0] for i in doc.tolist()]
    return [names, starts - doc_starts[doc], lengths, crcs, (doc_ends - doc_starts)[doc], first_sequence + window_of, starts - path[window_of]], len(path) - 1


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Nothing is shuffled."""
    path = tokenizer_path or default_path()
    end = np.array([END_ID], "<u4").tobytes()
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        sentence_end = encode.sentence_ends()
        sequence, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                data = encode.ids(text.as_py() or "") + end
                if held and size + len(data) // 4 > CHUNK:
                    columns, n = _pieces(held, sentence_end, sequence, window)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)
                    sequence, held, size = sequence + n, [], 0
                held.append((name.as_py(), data))
                size += len(data) // 4
        if held:
            columns, _ = _pieces(held, sentence_end, sequence, window)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(pack, SCHEMA)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


QUERIES = {"op5_packing": (op5_packing, None)}
