"""Suffix-array dedup: bytes covered by a long string that also starts anywhere else are removed.

A window is a string of `width` bytes. Every window has one anchor, its `GRAM`-byte string of least hash (the leftmost of equals), so equal
windows have equal anchors at equal places. Windows in a row with the same anchor are a run: a piece of text that holds all of them. Runs
meet by the hash of their anchor, and a window is in one run only. Equal runs (128-bit BLAKE2 digests) fold before anything else: all their
windows repeat. Where different runs share an anchor, one of each kind is sent with its bytes, and a suffix array of the group's
bytes finds the rest: suffixes that are smaller than their successors are sorted directly, all others are induced from them by one scan
over the buckets of first bytes, and neighbours with a common prefix of `width` bytes or more are repeats.

Hot groups: the kinds of one anchor may be many (a line in a third of all documents, each time in other company). Groups of more than
`LARGE` bytes are split by what the windows have in common beside the anchor: windows that begin in the same stretch of places before the
anchor share their inner bytes, and runs cut at these places meet by those. Stretches are a third of a window first, then shorter; the
last are single windows, whose digests decide. No group is ever whole in a task beyond LARGE bytes, and all splits keep every pair of equal windows together.

Equal texts fold first (they travel once per task); the table of distinct texts is bucketed by its key, so texts are shuffled once. What
is gathered is one text's runs and marks, or one group's bytes up to LARGE.

Defined cases: a null text is empty; a text shorter than `width` loses nothing; rows that repeat an id and its text are rows like all
others, so their texts repeat; a null id passes through; an empty table gives no rows; further columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemask.llm.common import table, text_slices, written
from sievemask.llm.rolling import BYTE_VALUES, Prefixes, leftmost_minima
from sievemask.llm.texts import discard, distinct_texts, heavy_keys, joined_by_share, text_key

WIDTH = 400
GRAM = 64
LARGE = 1 << 18
SLICE = 1 << 20
RUN = "tid binary, start long, windows int, back int, key long, digest binary, weight long"
RUN_FIELDS = pa.schema([("tid", pa.binary()), ("start", pa.int64()), ("windows", pa.int32()), ("back", pa.int32()), ("key", pa.int64()), ("digest", pa.binary()), ("weight", pa.int64())])
MARK = "tid binary, low long, high long"


def _digest(piece: bytes) -> bytes:
    return hashlib.blake2b(piece, digest_size=16).digest()


def _runs(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, first window, windows, anchor's distance from it, anchor's hash) of the runs of adjacent texts, in arrays; `first window`
    counts from the beginning of `data`. A long text is cut into stretches; a run may be cut there, which joins no other windows."""
    gram = min(GRAM, max(1, width // 4))
    for at in range(0, max(0, len(data) - width + 1), SLICE):
        part = data[at : at + SLICE + width - 1]
        if len(part) < width:
            return
        hashes = Prefixes(BYTE_VALUES[part]).windows(gram)
        anchors = leftmost_minima(hashes, width - gram + 1)
        begins = np.arange(at, at + len(anchors))
        row = np.searchsorted(offsets, begins, side="right") - 1
        whole = begins + width <= offsets[row + 1]
        edge = np.empty(len(anchors), bool)
        edge[0] = True
        edge[1:] = (anchors[1:] != anchors[:-1]) | ~whole[:-1]
        firsts = np.flatnonzero(edge & whole)
        if not len(firsts):
            continue
        ends = np.flatnonzero(whole & np.append(edge[1:] | ~whole[1:], True))
        yield row[firsts], firsts + at, ends - firsts + 1, anchors[firsts] - firsts, hashes[anchors[firsts]].view(np.int64)


def _run_batches(width: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tids, copies = batch.column(0), batch.column(2)
            for at, data, offsets in text_slices(batch.column(1), SLICE):
                for row, first, n, back, key in _runs(data, offsets, width):
                    raw = memoryview(np.ascontiguousarray(data))
                    digests = [_digest(raw[a : a + k + width - 1]) for a, k in zip(first.tolist(), n.tolist(), strict=True)]
                    of = pa.array(row + at)
                    places = [pa.array(first - offsets[row]), pa.array(n, pa.int32()), pa.array(back, pa.int32()), pa.array(key)]
                    yield pa.RecordBatch.from_arrays([tids.take(of), *places, pa.array(digests, pa.binary()), copies.take(of)], schema=RUN_FIELDS)

    return runs


def _cut(piece: bytes, run: dict, step: int, width: int) -> Iterator[tuple]:
    """A run cut where its windows' distance before the anchor passes a multiple of `step`. A part's key is a digest of the bytes that all
    windows at its distances share, and of that distance."""
    n, back = run["windows"], run["back"]
    at = 0
    while at < n:
        block = (back - at) // step  # distances block * step ... block * step + step - 1
        until = min(n, back - block * step + 1)
        low = back - block * step  # the place, in the run, of the window nearest to the anchor; it may lie past the run's end
        core = piece[low : low + width - step + 1] if step > 1 else piece[at : at + width]
        key = hashlib.blake2b(core, digest_size=8, salt=block.to_bytes(4, "little")).digest()
        yield at, until - at, low - at, int.from_bytes(key, "little", signed=True), _digest(piece[at : until + width - 1])
        at = until


def _wanted(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """tid, text, runs: the texts that hold any of `runs`, and these; a list is as long as its text has runs."""
    lists = runs.groupBy("tid").agg(F.collect_list(F.struct("start", "windows", "back", "key")).alias("runs"))
    return texts.select("tid", "text").join(lists, "tid")


def _pieces(frame: pd.DataFrame, width: int) -> Iterator[tuple[bytes, dict, bytes]]:
    for tid, text, runs in zip(frame["tid"], frame["text"], frame["runs"], strict=True):
        raw = text.encode()
        for r in runs:
            run = r.asDict() if hasattr(r, "asDict") else r
            yield tid, run, raw[run["start"] : run["start"] + run["windows"] + width - 1]


def _steps(width: int) -> list[int]:
    """How finely large groups are cut: first by a third of a window, so that what parts share is long."""
    return sorted({max(1, width // 3), max(1, width // 25), 1}, reverse=True)


def _finer(texts: DataFrame, runs: DataFrame, step: int, width: int) -> DataFrame:
    def finer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = RUN_FIELDS.names
        for frame in frames:
            out = []
            for tid, run, piece in _pieces(frame, width):
                out += [(tid, run["start"] + at, n, back, key, digest, 1) for at, n, back, key, digest in _cut(piece, run, step, width)]
                if len(out) > 1 << 16:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    return _wanted(texts, runs).mapInPandas(finer, RUN)


def suffix_order(data: bytes, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """The suffixes of `data` that are `wanted` (flags; all by default), in the order of their first `depth` bytes.

    First stage: suffixes smaller than their successors are sorted. Second stage: the buckets of first bytes are scanned upwards, and each
    suffix that is reached puts its predecessor, if that one is greater, at the end of its bucket's front part; a bucket's sorted
    suffixes follow its induced ones. What is sorted to `depth` bytes is induced to more."""
    text = np.frombuffer(data, np.uint8)
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    differs = np.flatnonzero(text[1:] != text[:-1])
    until = np.append(differs, n - 1)[np.searchsorted(differs, np.arange(n))]  # the last place of a run of one byte
    smaller = np.zeros(n, bool)
    smaller[until < n - 1] = text[until[until < n - 1]] < text[until[until < n - 1] + 1]
    wanted = np.ones(n, bool) if wanted is None else wanted
    sorts = np.append(np.flatnonzero(smaller), n)
    until = sorts[np.searchsorted(sorts, np.arange(n))]  # a suffix is induced from its successors up to the next sorted one
    changes = np.bincount(np.flatnonzero(wanted), minlength=n + 2) - np.bincount(until[wanted] + 1, minlength=n + 2)
    needed = np.cumsum(changes)[:n] > 0
    direct = np.array(sorted(np.flatnonzero(smaller & needed).tolist(), key=lambda p: data[p : p + depth]), dtype=np.int64)
    direct_cuts = np.searchsorted(text[direct], np.arange(257))
    fronts: list[list[np.ndarray]] = [[] for _ in range(256)]

    def reach(places: np.ndarray) -> None:
        before = places[places > 0] - 1
        before = before[~smaller[before] & needed[before]]
        first = text[before]
        by = np.argsort(first, kind="stable")
        before, first = before[by], first[by]
        edges = np.flatnonzero(np.diff(first, prepend=-1, append=256).astype(bool)) if len(first) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            fronts[first[a]].append(before[a:b])

    reach(np.array([n]))
    out = []
    for bucket in range(256):
        done = 0
        while done < len(fronts[bucket]):  # a run of one byte reaches into its own bucket
            wave = np.concatenate(fronts[bucket][done:])
            done = len(fronts[bucket])
            out.append(wave)
            reach(wave)
        fronts[bucket] = []
        some = direct[direct_cuts[bucket] : direct_cuts[bucket + 1]]
        out.append(some)
        reach(some)
    order = np.concatenate(out)
    return order[wanted[order]]


def _common(data: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Whether the strings of `width` bytes at a and b are the same: eight bytes at a time, for those that still agree."""
    words = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(7, np.uint8)), 8)
    same = np.arange(len(a))
    for at in [*range(0, width - 7, 8), max(0, width - 8)]:
        if width >= 8:
            x, y = words[a[same] + at].copy().view(np.uint64).ravel(), words[b[same] + at].copy().view(np.uint64).ravel()
        else:
            x, y = np.array([bytes(data[i : i + width]) for i in a[same]]), np.array([bytes(data[i : i + width]) for i in b[same]])
        same = same[x == y]
    out = np.zeros(len(a), bool)
    out[same] = True
    return out


def repeated_windows(pieces: list[bytes], windows: list[int], width: int) -> list[np.ndarray]:
    """For each piece the flags of its first windows: whether the window occurs at another place of these pieces."""
    data = b"".join(pieces)
    begins = np.cumsum([0, *map(len, pieces)])
    is_window = np.zeros(len(data) + 1, bool)
    for at, n in zip(begins, windows, strict=False):
        is_window[at : at + n] = True
    order = suffix_order(data, width, is_window[:-1])
    same = _common(np.frombuffer(data, np.uint8), order[:-1], order[1:], width)
    found = np.zeros(len(data) + 1, bool)
    found[order[:-1][same]] = True
    found[order[1:][same]] = True
    return [found[at : at + n] for at, n in zip(begins, windows, strict=False)]


def _marks_of_groups(texts: DataFrame, kinds: DataFrame, width: int) -> DataFrame:
    """kinds: runs of groups that fit into a task. tid, low, high of the bytes under repeated windows."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, held = [], 0
            for tid, run, piece in _pieces(frame, width):
                rows.append((run["key"], tid, run["start"], run["windows"], piece))
                held += len(piece)
                if held > 1 << 22:
                    yield pd.DataFrame(rows, columns=["key", "tid", "start", "windows", "piece"])
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["key", "tid", "start", "windows", "piece"])

    def marks(rows: list[tuple]) -> Iterator[tuple]:
        flags = repeated_windows([r[4] for r in rows], [r[3] for r in rows], width)
        for (_, tid, start, _, _), flag in zip(rows, flags, strict=True):
            edges = np.flatnonzero(np.diff(flag.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
            yield from ((tid, start + int(a), start + int(b) - 1 + width) for a, b in edges)

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size, group, group_size = [], 0, [], 0
        last = None
        for frame in frames:
            out = []
            for r in zip(frame["key"], frame["tid"], frame["start"], frame["windows"], frame["piece"], strict=True):
                if r[0] != last:
                    if len(group) > 1:
                        rows, size = rows + group, size + group_size
                    if size > LARGE // 2:
                        out += marks(rows)
                        rows, size = [], 0
                    group, group_size, last = [], 0, r[0]
                group.append(r)
                group_size += len(r[4])
            if out:
                yield pd.DataFrame(out, columns=["tid", "low", "high"])
        rows = rows + group if len(group) > 1 else rows
        if rows:
            yield pd.DataFrame(list(marks(rows)), columns=["tid", "low", "high"])

    pieces = _wanted(texts, kinds).mapInPandas(cut, "key long, tid binary, start long, windows int, piece binary")
    return pieces.repartition("key").sortWithinPartitions("key").mapInPandas(search, MARK)


def repeats(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """texts: tid, text, copies. tid, low, high (bytes) of what repeated windows cover, in pieces that may overlap."""
    long = texts.select("tid", "text", "copies").where(F.octet_length("text") >= width)
    runs = written(long.mapInArrow(_run_batches(width), RUN), "runs")
    marks = None
    for step in (*_steps(width), 0):
        # Runs whose anchor occurs again; most do not.
        anchors = written(runs.groupBy("key").agg(F.sum("weight").alias("n")).where("n > 1"), "repeated-anchors")
        common = heavy_keys(anchors, ["key"], "n", runs.count())
        shared = written(joined_by_share(runs, anchors.select("key"), ["key"], common), "shared-runs")
        discard(runs, anchors, common)
        one = F.min(F.struct("tid", "start", "windows", "back")).alias("one")
        kinds = written(shared.groupBy("key", "digest").agg(F.sum("weight").alias("times"), one), "run-kinds")
        # Runs that occur as a whole somewhere else.
        whole = kinds.where("times > 1").select("key", "digest", "times")
        heavy = heavy_keys(whole, ["key", "digest"], "times", shared.count())
        again = joined_by_share(shared, whole.select("key", "digest"), ["key", "digest"], heavy)
        found = again.select("tid", F.col("start").alias("low"), (F.col("start") + F.col("windows") - 1 + width).alias("high"))
        # Different runs with one anchor.
        span = F.sum(F.col("one.windows") + width - 1)
        sizes = written(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("n"), span.alias("size")).where("n > 1"), "group-sizes")
        many = heavy_keys(sizes, ["key"], "n", kinds.count())
        groups = written(joined_by_share(kinds.select("key", "one"), sizes, ["key"], many).select("key", "size", "one.*"), "groups")
        if step:
            found = found.unionByName(_marks_of_groups(texts, groups.where(F.col("size") <= LARGE), width))
        found = written(found, "marks")
        discard(shared, kinds, heavy, sizes, many)
        marks = found if marks is None else marks.unionByName(found)
        large = groups.where(F.col("size") > LARGE)
        if not step or large.isEmpty():
            discard(groups)
            break
        runs = written(_finer(texts, large, step, width), "finer-runs")
        discard(groups)
    return marks


def _stripped(raw: bytes, spans) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, what is left)."""
    kept, removed, count, at = [], 0, 0, 0
    high = -1
    for low, end in sorted((s["low"], s["high"]) for s in spans):
        if low > high:
            kept.append(raw[at:low])
            count += 1
            removed += end - low
            at = high = end
        elif end > high:
            removed += end - high
            at = high = end
    kept.append(raw[at:])
    return removed, count, b"".join(kept)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, with_bytes: bool = True) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the remaining bytes) if asked for."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = distinct_texts(rows, ["text"], "distinct-texts")
    lists = repeats(texts, width).groupBy("tid").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    single = texts.where("copies = 1").join(lists, "tid", "left").select("id", "text", "spans")
    columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_bytes else [])]

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.encode()
                removed, count, kept = _stripped(raw, spans or [])
                out.append((len(raw), removed, count, hashlib.sha256(kept).hexdigest(), kept)[: len(columns)])
            made = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.string(), pa.binary()], strict=False)] if out else []
            if made:
                yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", *columns])

    kind = single.schema["id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_bytes else "")
    once = single.mapInArrow(strip, schema)
    # Rows whose text has copies: a window of theirs is in a copy too.
    repeated = texts.where("copies > 1").select("tid", "copies")
    gone = F.octet_length("text") >= width
    left = F.when(gone, F.lit(b"")).otherwise(F.col("text").cast("binary"))
    size = F.octet_length("text").cast("long")
    slim = rows.select(
        text_key(F.col("text")).alias("tid"), F.col("id").alias("doc_id"), size.alias("n_bytes"), F.when(gone, size).otherwise(0).alias("n_removed"),
        gone.cast("long").alias("n_spans"), F.sha2(left, 256).alias("kept_sha256"), *([left.alias("kept")] if with_bytes else []),
    )
    often = joined_by_share(slim, repeated.select("tid"), ["tid"], heavy_keys(repeated, ["tid"], "copies", rows.count()))
    return once.unionByName(often.drop("tid"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), with_bytes=False)


QUERIES = {"op12_suffix_dedup": (op12_suffix_dedup, None)}
