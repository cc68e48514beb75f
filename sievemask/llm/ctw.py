"""Language-model scores by context-tree weighting over binary-decomposed bytes.

The model reads the token sequence: words in lower case (A-Z) with one space between, and an end symbol. A byte is eight binary
decisions, each a node of a 255-node tree; for every node there is a context tree over the DEPTH preceding bytes. At each
depth a Krichevsky-Trofimov estimator has the node's zeros and ones in that context; a node's weighted probability is half its
own block probability and half the product of its children's, so all depths are mixed. Block probabilities depend on
counts alone, so the trees are built from counts of (context, byte) of the whole training text, whatever their order. A context
that training has never seen predicts like its longest seen suffix.

Nothing grows on the driver or in one task but what is bounded by its alphabet:

* `gathered`: each block of documents folds its text into distinct words and (context, byte) keys with counts, packed into one row
  for each shard of the key space.
* `counted`: rows of a shard are merged in rounds of at most FAN.
* The trees of all contexts that end in the same two bytes are in one shard. Depths 1 and 0 have at most 65,536 and 256 nodes; their
  sums are collected, mixed, and sent to all shards, which give each key its log probability.
* `answered`: a block's keys meet their shards (a join of packed rows), and the answers meet the block's documents.

A block holds documents of neighbouring ids and similar length, at most 256 MB of text, or one longer document; it is handled in the
pieces that its Arrow batches make. Packed rows and documents are compressed before they are written or shuffled. Log probabilities of
keys are kept to the 1/FINE.

Defined cases: a null or empty text is the end alone; a row without id is scored and learned from (its fold is not 0); a word that training has not
seen has count 0; without training rows all counts are 0 and bits cost one half each; rows that repeat an id are scored and
counted each on its own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemask.llm.common import LOWER, SPACE, fold_of, runs, table, text_slices, words, written

DEPTH, END, FAN = 5, 0xFF, 64  # no byte of UTF-8 is 0xFF
BLOCK_DOCS, BLOCK_BYTES, SLICE, FINE = 16384, 16384, 1 << 20, 65536
END_WORD = np.uint64(0x9D8F7C6B5A493827)
PARTS = "kind string, shard int, block long, keys binary, counts binary"
_B = np.uint64(8)


def context_keys(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) keys of the token sequences of adjacent texts, and where each text's begin (and the end).

    A key has the predicted byte lowest, then the bytes before it, the nearest first. Before a text there are END symbols."""
    n = len(offsets) - 1
    keep = ~SPACE[data]
    later = np.ones(len(starts), bool)
    later[first[:-1][first[:-1] < first[1:]]] = False
    keep[starts[later] - 1] = True
    low = np.where(SPACE[data], np.uint8(0x20), LOWER[data])[keep]
    begin = np.concatenate(([0], np.cumsum(keep)))[offsets]
    sizes = np.diff(begin)
    line = np.full(len(low) + n * (depth + 1), END, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    line[np.arange(len(low)) + owner * (depth + 1) + depth] = low
    keys = np.zeros(len(line), np.uint64)
    for back in range(depth, -1, -1):
        keys <<= _B
        keys[back:] |= line[: len(line) - back]
    pads = begin[:-1] + np.arange(n) * (depth + 1)
    real = np.ones(len(line), bool)
    for d in range(depth):
        real[pads + d] = False
    return keys[real], begin + np.arange(n + 1)


def folded(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    order = np.argsort(keys)
    keys, first = runs(keys[order])
    return keys, np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def tallied(keys: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how many of each are flagged by `learn`; keys alone sort much faster than keys with counts."""
    line = np.sort(keys)
    distinct, first = runs(line)
    counts = np.diff(first, append=len(line))
    if not learn.all():
        others = np.sort(keys[~learn])
        some, first = runs(others)
        counts[np.searchsorted(distinct, some)] -= np.diff(first, append=len(others))
    return distinct, counts


def _nodes(keys: np.ndarray, depth: int) -> np.ndarray:
    """Ids of the eight nodes of each key at `depth`: the key's context, with the decided bits in place of the byte."""
    byte = keys & np.uint64(0xFF)
    context = (keys >> _B) & np.uint64((1 << 8 * depth) - 1)
    decided = np.stack([(np.uint64(1) << np.uint64(k)) | (byte >> np.uint64(8 - k)) for k in range(8)], axis=1)
    return ((context << _B)[:, None] | decided).ravel()


def _bits(keys: np.ndarray) -> np.ndarray:
    byte = keys & np.uint64(0xFF)
    return np.stack([(byte >> np.uint64(7 - k)) & np.uint64(1) for k in range(8)], axis=1).ravel().astype(bool)


_LOG_STEPS = np.zeros(1)


def _log_gamma_half(n: np.ndarray) -> np.ndarray:
    """ln gamma(n + 1/2) - ln gamma(1/2): a table for small n, Stirling's series beyond."""
    global _LOG_STEPS
    if len(_LOG_STEPS) == 1:
        _LOG_STEPS = np.concatenate(([0.0], np.cumsum(np.log(np.arange(4096) + 0.5))))
    x = n + 0.5
    far = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) - 0.5 * np.log(np.pi)
    return np.where(n < 4096, _LOG_STEPS[np.minimum(n, 4096).astype(np.int64)], far)


def _log_factorial(n: np.ndarray) -> np.ndarray:
    x = n + 1.0
    near = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 256)))))
    far = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(n < 256, near[np.minimum(n, 255).astype(np.int64)], far)


def log_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of any sequence with these counts."""
    return _log_gamma_half(zeros) + _log_gamma_half(ones) - _log_factorial(zeros + ones)


def _weighed(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.logaddexp(own, below) - np.log(2)


class Trees:
    """Nodes of some depths over sorted distinct keys: zeros, ones, and log ratios of own to children's probability."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, least: int, depth: int):
        bit = _bits(keys)
        counts = np.repeat(counts.astype(np.float64), 8)
        self.bit, self.at, self.zeros, self.ones, self.ratio = bit, {}, {}, {}, {}
        below = None
        for d in range(depth, least - 1, -1):
            nodes, at = np.unique(_nodes(keys, d), return_inverse=True)
            zeros, ones = (np.bincount(at, counts * w, len(nodes)) for w in (~bit, bit))
            own = log_block(zeros, ones)
            if below is None:
                self.ratio[d], weighed = None, own
            else:
                deeper, value = below
                one_each = np.zeros(len(deeper), np.int64)
                one_each[self.at[d + 1]] = at  # the parent of each deeper node
                sums = np.bincount(one_each, value, len(nodes))
                self.ratio[d], weighed = own - sums, _weighed(own, sums)
            self.at[d], self.zeros[d], self.ones[d] = at, zeros, ones
            below = (nodes, weighed)
        self.nodes, self.weighed = below


def mixed_probability(trees: Trees, upper: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], depth: int, least: int) -> np.ndarray:
    """log10 probability of each key's byte. `upper`: (node of each bit, zeros, ones, ratio) of the depths below `least`, depth 0 first."""
    levels = upper + [(trees.at[d], trees.zeros[d], trees.ones[d], trees.ratio[d]) for d in range(least, depth + 1)]
    p, seen = None, None
    for at, zeros, ones, ratio in reversed(levels):
        n0, n1 = zeros[at], ones[at]
        own = (np.where(trees.bit, n1, n0) + 0.5) / (n0 + n1 + 1)
        if p is None:
            p = own
        else:
            share = 1 / (1 + np.exp(np.clip(-ratio[at], -700, 700)))  # of this depth's own estimate
            p = np.where(seen, share * own + (1 - share) * p, own)
        seen = n0 + n1 > 0
    return np.log10(p).reshape(-1, 8).sum(1)


def whole_model(keys: np.ndarray, counts: np.ndarray, depth: int) -> np.ndarray:
    """All depths at once; for tests and small keys."""
    return mixed_probability(Trees(keys, counts, 0, depth), [], depth, 0)


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def planes(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: high bytes are mostly zeros, low counts repeat."""
    return squeezed(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes())


def from_planes(data: bytes) -> np.ndarray:
    flat = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(flat, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()


def packed(values: np.ndarray) -> bytes:
    """Sorted numbers by their differences."""
    return planes(np.diff(values, prepend=values.dtype.type(0)))


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data), dtype=np.uint64)


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, block) rows as one compressed row for each block of a batch."""
    for batch in batches:
        block_of = batch.column(2).to_numpy()
        blocks, blobs = np.unique(block_of), []
        for block in blocks.tolist():
            rows = batch.filter(pa.array(block_of == block)).select([0, 1])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(rows)
            blobs.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(blobs, pa.binary())], ["block", "blob"])


def _gather(depth: int, shards: int):
    def of_block(rows: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        learn = rows.column(2).to_numpy(zero_copy_only=False).astype(bool)
        found = {"w": [(np.array([END_WORD]), np.array([learn.sum()]))], "g": []}
        for at, data, offsets in text_slices(rows.column(1), SLICE):
            mine = learn[at : at + len(offsets) - 1]
            hashes, starts, ends, first = words(data, offsets)
            found["w"].append(tallied(hashes, np.repeat(mine, np.diff(first))))
            keys, begin = context_keys(data, offsets, starts, ends, first, depth)
            found["g"].append(tallied(keys, np.repeat(mine, np.diff(begin))))
        for kind, parts in found.items():
            keys, counts = folded(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
            yield kind, keys, counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block_of = batch.column(3).to_numpy()
            for block in np.unique(block_of).tolist():
                rows = batch.filter(pa.array(block_of == block))
                out = []
                for kind, keys, counts in of_block(rows):
                    shard = (mixed_shard(keys, kind) % np.uint64(shards)).astype(np.int64)
                    order = np.argsort(shard, kind="stable")
                    bounds = np.searchsorted(shard[order], np.arange(shards + 1))
                    for s, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                        if a < b:
                            out.append((kind, s, block, packed(keys[order[a:b]]), planes(counts[order[a:b]])))
                types = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["kind", "shard", "block", "keys", "counts"])

    return run


def mixed_shard(keys: np.ndarray, kind: str) -> np.ndarray:
    """Keys whose context ends in the same two bytes belong together."""
    return keys if kind == "w" else (((keys >> _B) & np.uint64(0xFFFF)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)


def _merge(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
    keys, counts = folded(np.concatenate([unpacked(k) for k in f["keys"]]), np.concatenate([from_planes(c) for c in f["counts"]]))
    return pd.DataFrame({"kind": [key[0]], "shard": [key[1]], "block": [key[2]], "keys": [packed(keys)], "counts": [planes(counts)]})


def counted(parts: DataFrame) -> DataFrame:
    """One row per kind and shard: distinct keys with all their counts. At most some FAN rows meet in a group."""
    n, rows = parts.select("block").distinct().count(), parts
    while n > 1 or rows is parts:
        n = -(-n // FAN)
        rows = rows.withColumn("block", F.pmod(F.col("block"), F.lit(n))).groupBy("kind", "shard", "block").applyInPandas(_merge, PARTS)
    return written(rows.select("kind", "shard", "keys", "counts"), "counts")


def _upper(depth: int):
    """Sums at depth 1 of a shard's trees; for words, all and distinct tokens of the training text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for kind, k, c in zip(f["kind"], f["keys"], f["counts"], strict=True):
                counts = from_planes(c)
                if kind == "w":
                    yield pd.DataFrame({"node": [-1], "zeros": [float(counts.sum())], "ones": [float((counts > 0).sum())], "below": [0.0]})
                    continue
                trees = Trees(unpacked(k), counts, 2, depth)
                nodes, at = np.unique(trees.nodes & np.uint64(0xFFFF), return_inverse=True)
                sums = [np.bincount(at, x, len(nodes)) for x in (trees.zeros[2], trees.ones[2], trees.weighed)]
                yield pd.DataFrame({"node": nodes.astype(np.int64), "zeros": sums[0], "ones": sums[1], "below": sums[2]})

    return run


def _values(depth: int, one: tuple, root: tuple):
    """Each key's log10 probability; words keep their counts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for kind, k, c in zip(f["kind"], f["keys"], f["counts"], strict=True):
                if kind == "w":
                    out.append(c)
                    continue
                keys = unpacked(k)
                trees = Trees(keys, from_planes(c), 2, depth)
                upper = [(_nodes(keys, d).astype(np.int64), *sums) for d, sums in ((0, root), (1, one))]
                out.append(planes(np.rint(-FINE * mixed_probability(trees, upper, depth, 2))))
            yield pd.DataFrame({"kind": f["kind"], "shard": f["shard"], "known": f["keys"], "found": out})

    return run


def _answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for r in f.itertuples():
            known = unpacked(r.known)
            found = from_planes(r.found)
            out = []
            for asked in r.asked:
                values = found[np.searchsorted(known, unpacked(asked["keys"]))]
                out.append((asked["block"], r.kind, asked["keys"], planes(values)))
            yield pd.DataFrame(out, columns=["block", "kind", "keys", "found"])


def looked_up(keys: np.ndarray, found: np.ndarray) -> tuple[pd.Index, np.ndarray]:
    """Keys as a hash table, and what was found for each. A key that many pieces of a block ask for has one entry."""
    order = np.argsort(keys)
    keys, first = runs(keys[order])
    return pd.Index(keys), found[order[first]]


def values_of(known: tuple[pd.Index, np.ndarray], keys: np.ndarray) -> np.ndarray:
    at = known[0].get_indexer(keys)
    if (at < 0).any():
        raise ValueError("a block misses answers")
    return known[1][at]


def _score(depth: int, total: float, distinct: float):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def lookup(answers: pa.Table, kind: str) -> tuple[pd.Index, np.ndarray]:
        rows = [(k.as_py(), v.as_py()) for n, k, v in zip(answers["kind"], answers["keys"], answers["found"], strict=True) if n.as_py() == kind]
        if not rows:
            return looked_up(np.zeros(0, np.uint64), np.zeros(0))
        return looked_up(np.concatenate([unpacked(k) for k, _ in rows]), np.concatenate([from_planes(v) for _, v in rows]))

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        by_word, by_key = lookup(answers, "w"), lookup(answers, "g")
        floor = total + 0.1 * (distinct + 1)
        end_count = float(values_of(by_word, np.array([END_WORD]))[0]) if docs.num_rows else 0.0
        parts = []
        for batch in (b for blob in docs["blob"] for b in pa.ipc.open_stream(blob.as_buffer())):
            for at, data, offsets in text_slices(batch.column(1), SLICE):
                n = len(offsets) - 1
                hashes, starts, ends, first = words(data, offsets)
                counts = values_of(by_word, hashes).astype(np.float64) if len(hashes) else np.zeros(0)
                owner = np.repeat(np.arange(n), np.diff(first))
                base = np.bincount(owner, np.log10((counts + 0.1) / floor), n) + np.log10((end_count + 0.1) / floor)
                known = np.bincount(owner, counts > 0, n) + (end_count > 0)
                keys, begin = context_keys(data, offsets, starts, ends, first, depth)
                score = np.bincount(np.repeat(np.arange(n), np.diff(begin)), values_of(by_key, keys) / -FINE, n)
                parts.append([batch.column(0)[at : at + n], np.diff(first) + 1, known.astype(np.int64), base, score])
        chunks = [pa.Table.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in p], schema=schema) for p in parts]
        return pa.concat_tables(chunks) if chunks else schema.empty_table()

    return run


def scored(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score (words by their smoothed frequencies), score (the model's log10 probability) and
    train_tokens, a row per row of `docs`. `learn`: the rows to learn from. Contexts of 2 to 7 bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    long_ = F.length(F.bin(F.floor(F.octet_length(text) / BLOCK_BYTES)))  # 1 below two times BLOCK_BYTES, one more for each doubling
    level = F.when(F.octet_length(text) < BLOCK_BYTES, 0).otherwise(long_)
    width = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_DOCS) / F.pow(F.lit(2), level))).cast("long")
    number = F.floor(F.coalesce(F.col(id_col).cast("long"), F.lit(0)) / width)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.coalesce(learn, F.lit(True)).alias("learn"), F.xxhash64(level, number).alias("block"))
    shards = min(4096, max(64, docs.count() // 16384))
    parts = written(rows.mapInArrow(_gather(depth, shards), PARTS), "block-counts")
    counts = counted(parts)

    sums = counts.mapInPandas(_upper(depth), "node long, zeros double, ones double, below double")
    sums = sums.groupBy("node").agg(F.sum("zeros"), F.sum("ones"), F.sum("below")).collect()  # at most 65,281 rows
    one, root = [np.zeros((3, n)) for n in (65536, 256)]
    total = distinct = 0.0
    for node, zeros, ones, below in sums:
        if node < 0:
            total, distinct = zeros, ones
        else:
            one[:, node] = zeros, ones, below
    own = log_block(one[0], one[1])
    np.add.at(root[0], np.arange(65536) & 0xFF, one[0])
    np.add.at(root[1], np.arange(65536) & 0xFF, one[1])
    np.add.at(root[2], np.arange(65536) & 0xFF, _weighed(own, one[2]))
    upper = [(s[0], s[1], log_block(s[0], s[1]) - s[2]) for s in (one, root)]

    model = written(counts.mapInPandas(_values(depth, *upper), "kind string, shard int, known binary, found binary"), "byte-model")
    buckets = max(1, parts.select("block").distinct().count() // 16)
    by_shard = parts.repartition("kind", "shard")  # serves the grouping and the join
    asked = by_shard.groupBy("kind", "shard", F.pmod("block", F.lit(buckets)).alias("bucket")).agg(F.collect_list(F.struct("block", "keys")).alias("asked"))
    answers = asked.join(model, ["kind", "shard"]).select("kind", "known", "found", "asked").mapInPandas(_answer, "block long, kind string, keys binary, found binary")
    bundles = rows.select("id", "text", "block").mapInArrow(_bundle, "block long, blob binary")
    met = bundles.groupBy("block").cogroup(answers.groupBy("block"))
    found = met.applyInArrow(_score(depth, total, distinct), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return found.withColumn("train_tokens", F.lit(int(total)).cast("long"))


def op10_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = fold_of(F.col("doc_id"), 10)
    rows = scored(docs, fold != 0)
    return rows.select("doc_id", (fold == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op10_ctw": (op10_ctw, None)}
