"""Phrase collocations: n-grams that occur together more often than their parts would suggest, per language.

Rabin-Karp fingerprints. Words of a text are hashed through prefix polynomials of its bytes, and n-grams through prefix polynomials of the word
hashes, so every n-gram of a block of texts costs two array reads. Tasks fold equal fingerprints; the shuffle sums them, keeps a pointer to a
text that holds the phrase, and the least and greatest of a second, independent hash. One pass a length: an n-gram can only be frequent if
both its (n-1)-grams are, and a bit map of the frequent fingerprints of the length before (16 bits for each of them, at most `MAP_BITS` in all)
keeps most others out of the shuffle. The map errs on one side only, so its size decides cost and not results.

Collisions. Where the second hash differs under one fingerprint, different phrases met; all occurrences of such fingerprints are counted
again by their text. All other frequent phrases are cut out of the text that their pointer names, where both hashes are computed anew. Only
frequent phrases ever exist as strings.

A language, a word or a copied text may hold any share of the rows: equal texts fold into one with a count, fingerprints fold in tasks, the
last ranking numbers ranges of rows and adds up their sizes, and parts shared by many phrases are looked up by `joined_by_share`. What is held
in a task is a block of texts (`BLOCK` bytes, or one text) and `FOLDED` fingerprints; these are folded by ranges of fingerprints, so that no
second copy of them is made, and leave the task range by range.

Defined cases: a null text is empty, a null language `und`; rows that repeat an id count as rows; a text of any length is one block at least;
ties are ordered by count and phrase; an empty table gives no rows; further columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemask.llm.common import LOWER, mixed, runs, table, text_slices, written
from sievemask.llm.rolling import BYTE_VALUES, Prefixes
from sievemask.llm.texts import distinct_texts, heavy_keys, joined_by_share
from sievemask.operators.ranking import numbered

LONGEST, LEAST, TOP = 4, 30, 2000
BLOCK, FOLDED, RANGE = 1 << 19, 1 << 21, 1 << 16
MAP_BITS = 1 << 28
SEGMENT = 1 << 19  # bits of the map that are packed into one row
BLANK, STOP = np.zeros(256, bool), np.zeros(256, bool)
BLANK[[0x20, 0x09]] = True
STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
OTHER = np.uint64(0x632BE59BD9B4E019)
FOUND = [("fp", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("count", pa.int64()), ("ref", pa.int64()), ("lang", pa.string())]
FOUND_SQL = "fp long, low long, high long, count long, ref long, lang string"


def language_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Block:
    """The words of adjacent texts, with hashes of all their n-grams. An n-gram lies in one text, between marks that end a piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, print_bits: int = 64):
        self._mask = np.uint64((1 << print_bits) - 1)
        n = len(data)
        data = LOWER[data]
        stop = STOP[data]
        space = BLANK[data] | stop
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        before, after = cut[:n].copy(), cut[1:].copy()
        before[1:] |= space[:-1]
        after[:-1] |= space[1:]
        self.data = data
        self.starts = np.flatnonzero(before & ~space)
        self.ends = np.flatnonzero(after & ~space) + 1
        self.text = np.searchsorted(offsets, self.starts, side="right") - 1
        piece = np.cumsum(stop)[self.starts] if n else self.starts
        count = len(self.starts)
        joined = np.zeros(count, bool)  # the next word stands in the same piece
        if count:
            joined[:-1] = (piece[1:] == piece[:-1]) & (self.text[1:] == self.text[:-1])
        self.joined = joined
        self._langs = langs[self.text]
        self._first = Prefixes(Prefixes(BYTE_VALUES[data]).stretches(self.starts, self.ends))
        self._other_words = None

    def places(self, n: int) -> np.ndarray:
        """First words of the n-grams."""
        ok = np.ones(len(self.starts), bool)
        for j in range(n - 1):
            ok[: len(ok) - j] &= self.joined[j:]
            ok[len(ok) - j :] = False
        return np.flatnonzero(ok)

    def prints(self, at: np.ndarray, n: int) -> np.ndarray:
        return (mixed(self._first.stretches(at, at + n) + self._langs[at]) & self._mask).view(np.int64)

    def checks(self, at: np.ndarray, n: int) -> np.ndarray:
        """A second hash, from each word's first and last eight bytes and its length: it does not rest on the polynomials of bytes."""
        if self._other_words is None:
            eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([self.data, np.zeros(8, np.uint8)]), 8)
            length = (self.ends - self.starts).astype(np.uint64)
            spare = (np.uint64(8) * (np.uint64(8) - np.minimum(length, np.uint64(8)))).astype(np.uint64)
            first = eight[self.starts].copy().view("<u8").ravel() << spare
            last = eight[np.maximum(self.ends - 8, self.starts)].copy().view("<u8").ravel() << spare
            self._other_words = Prefixes(mixed(mixed(first + OTHER) ^ (last + length * OTHER)))
        return mixed(self._other_words.stretches(at, at + n) ^ self._langs[at]).view(np.int64)

    def phrase(self, at: int, n: int) -> str:
        words = (self.data[self.starts[i] : self.ends[i]].tobytes() for i in range(at, at + n))
        return b" ".join(words).decode()


def _held(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    place = prints.view(np.uint64) & np.uint64(len(bits) * 64 - 1)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _fold(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Rows (fp, low, high, count, ref) with one row per fingerprint, in its order."""
    fp, low, high, count, ref = rows
    if not len(fp):
        return rows
    order = np.argsort(fp, kind="stable")
    distinct, first = runs(fp[order])
    return [distinct, np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first), np.add.reduceat(count[order], first), np.minimum.reduceat(ref[order], first)]


def _fold_ranges(parts: list[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """Folded rows of `parts`, each of which is folded itself, in ranges of fingerprints: about `RANGE` rows of `parts` at a time."""
    ranges = max(1, sum(len(part[0]) for part in parts) // RANGE)
    bounds = np.array([-(1 << 63) + (1 << 64) * i // ranges for i in range(1, ranges)], np.int64)
    cuts = [[0, *np.searchsorted(part[0], bounds).tolist(), len(part[0])] for part in parts]
    for i in range(ranges):
        rows = [[c[cut[i] : cut[i + 1]] for c in part] for part, cut in zip(parts, cuts, strict=True)]
        folded = _fold([np.concatenate(c) for c in zip(*rows, strict=True)]) if rows else []
        if folded and len(folded[0]):
            yield folded


def _blocks(batches: Iterator[pa.RecordBatch], print_bits: int) -> Iterator[tuple[Block, np.ndarray, np.ndarray, list[str]]]:
    """Blocks of (lang, text, copies, ref) rows, with copies, refs and languages of their texts."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        hashed = {name: language_hash(name) for name in set(langs)}
        codes = np.array([hashed[x] for x in langs], np.uint64)
        copies, refs = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
        for at, data, offsets in text_slices(batch.column(1), BLOCK):
            to = at + len(offsets) - 1
            yield Block(data, offsets, codes[at:to], print_bits), copies[at:to], refs[at:to], langs[at:to]


def _candidates(block: Block, n: int, bits) -> np.ndarray:
    at = block.places(n)
    if n > 1:
        parts = block.places(n - 1)
        fit = np.zeros(len(block.starts) + 1, bool)
        fit[parts[_held(bits, block.prints(parts, n - 1))]] = True
        at = at[fit[at] & fit[at + 1]]
    return at


def _counted(n: int, map_of, print_bits: int):
    """Folded fingerprints of the n-grams of blocks; the words of each language, with n = 1, in rows that name it."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = map_of.value if map_of is not None else None
        totals: dict[str, int] = {}
        kept: list[list[np.ndarray]] = []
        size = 0

        def batch_of(rows: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.nulls(len(rows[0]), pa.string())], schema=pa.schema(FOUND))

        for block, copies, refs, langs in _blocks(batches, print_bits):
            at = _candidates(block, n, bits)
            of = block.text[at]
            check = block.checks(at, n)
            kept.append(_fold([block.prints(at, n), check, check, copies[of], refs[of]]))
            size += len(kept[-1][0])
            if n == 1:
                for i, words in enumerate(np.bincount(block.text, minlength=len(langs)).tolist()):
                    totals[langs[i]] = totals.get(langs[i], 0) + words * int(copies[i])
            del block, at, of, check
            if size > FOLDED:
                size = len(runs(np.sort(np.concatenate([part[0] for part in kept])))[0])
                if size > FOLDED // 2:
                    yield from map(batch_of, _fold_ranges(kept))
                    kept, size = [], 0
                else:
                    kept = [[np.concatenate(c) for c in zip(*_fold_ranges(kept), strict=True)]]
        yield from map(batch_of, _fold_ranges(kept))
        if totals:
            zeros = pa.array(np.zeros(len(totals), np.int64))
            yield pa.RecordBatch.from_arrays([zeros, zeros, zeros, pa.array(list(totals.values()), pa.int64()), zeros, pa.array(list(totals))], schema=pa.schema(FOUND))

    return counted


def _bit_map(spark: SparkSession, frequent: DataFrame):
    """A broadcast bit map of fingerprints, sized by their number up to `MAP_BITS`, packed by tasks."""
    bits = min(MAP_BITS, max(SEGMENT, 1 << (16 * frequent.count() - 1).bit_length()))

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        place = (frame["place"].to_numpy() & (SEGMENT - 1)).astype(np.int64)
        flags = np.zeros(SEGMENT, np.uint8)
        flags[place] = 1
        return pd.DataFrame({"segment": frame["segment"].iloc[:1], "bits": [np.packbits(flags, bitorder="little").tobytes()]})

    place = F.col("fp").bitwiseAND(F.lit(bits - 1).cast("long")).alias("place")
    places = frequent.select(place).distinct().withColumn("segment", F.shiftright("place", SEGMENT.bit_length() - 1))
    out = np.zeros(bits // 64, np.uint64)
    for r in places.groupBy("segment").applyInPandas(packed, "segment long, bits binary").toLocalIterator():
        some = np.frombuffer(r["bits"], np.uint64)
        out[r["segment"] * len(some) : (r["segment"] + 1) * len(some)] = some
    return spark.sparkContext.broadcast(out)


def _cut_out(batches: Iterator[pa.RecordBatch], print_bits: int) -> Iterator[pa.RecordBatch]:
    """(lang, text, copies, ref, wanted) to (lang, n, fp, phrase): each wanted fingerprint where it stands, if both hashes agree."""
    for batch in batches:
        wanted = batch.column(4).to_pylist()
        row = 0
        for block, _, _, langs in _blocks(iter([batch.select([0, 1, 2, 3])]), print_bits):
            out: set = set()
            asked = [(w["n"], w["fp"], w["low"]) for some in wanted[row : row + len(langs)] for w in some]
            row += len(langs)
            for n in {a[0] for a in asked}:
                checks = {fp: check for m, fp, check in asked if m == n}
                at = block.places(n)
                prints = block.prints(at, n)
                hit = np.flatnonzero(np.isin(prints, np.array(list(checks), np.int64)))
                distinct, first = np.unique(prints[hit], return_index=True)
                places = at[hit[first]]
                for fp, place, check in zip(distinct.tolist(), places.tolist(), block.checks(places, n).tolist(), strict=True):
                    if checks[fp] == check:
                        out.add((langs[block.text[place]], n, fp, block.phrase(place, n)))
            if out:
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.string(), pa.int32(), pa.int64(), pa.string()], strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "n", "fp", "phrase"])


def _spelled(n: int, map_of, print_bits: int):
    """(lang, n, fp, phrase, count) of the n-grams of blocks whose fingerprint may be one of those asked for."""

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, copies, _, langs in _blocks(batches, print_bits):
            at = block.places(n)
            prints = block.prints(at, n)
            hit = np.flatnonzero(_held(map_of.value, prints))
            for a in range(0, len(hit), 1 << 16):
                some = hit[a : a + (1 << 16)]
                of = block.text[at[some]]
                columns = [[langs[i] for i in of], pa.array([n] * len(some), pa.int32()), pa.array(prints[some]), [block.phrase(i, n) for i in at[some].tolist()], pa.array(copies[of])]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.string()) for c in columns], ["lang", "n", "fp", "phrase", "count"])

    return spelled


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, print_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(lang, n, phrase, f) of all phrases of 1 to `longest` words with f >= least, and (lang, words): all word occurrences."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.lit(0).alias("id"))
    texts = distinct_texts(rows, ["lang", "text"], "distinct-texts").withColumn("ref", F.xxhash64("tid"))
    plain = texts.select("lang", "text", "copies", "ref")
    frequent, spelled, words, map_of = [], [], None, None
    for n in range(1, longest + 1):
        found = plain.mapInArrow(_counted(n, map_of, print_bits), FOUND_SQL).repartition("fp", "lang")  # tasks have folded their rows already
        summed = found.groupBy("fp", "lang").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("count").alias("count"), F.min("ref").alias("ref"))
        level = written(summed.where((F.col("count") >= least) | F.col("lang").isNotNull()).withColumn("n", F.lit(n)), "frequent")
        if n == 1:
            words = level.where("lang is not null").select("lang", F.col("count").alias("words"))
            level = level.where("lang is null")
        clashes = level.where("low <> high").select("fp")
        if not clashes.isEmpty():
            again = plain.mapInArrow(_spelled(n, _bit_map(spark, clashes), print_bits), "lang string, n int, fp long, phrase string, count long")
            by_text = again.join(clashes, "fp", "left_semi").groupBy("lang", "n", "phrase").agg(F.sum("count").alias("f"))
            spelled.append(by_text.where(F.col("f") >= least))
        frequent.append(level.where("low = high").drop("lang"))
        if n < longest:
            map_of = _bit_map(spark, level)
    named = reduce(DataFrame.unionByName, frequent)
    asked = named.join(texts.select("ref", "tid"), "ref").groupBy("tid").agg(F.collect_list(F.struct("n", "fp", "low")).alias("wanted"))
    phrases = texts.join(asked, "tid").select("lang", "text", "copies", "ref", "wanted").mapInArrow(partial(_cut_out, print_bits=print_bits), "lang string, n int, fp long, phrase string")
    once = phrases.groupBy("n", "fp").agg(F.first("lang").alias("lang"), F.first("phrase").alias("phrase"))
    counted = once.join(named.select("n", "fp", F.col("count").alias("f")), ["n", "fp"]).select("lang", "n", "phrase", "f")
    return written(reduce(DataFrame.unionByName, spelled, counted), "phrases"), words


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, print_bits: int = 64) -> DataFrame:
    """Each language's first `top` phrases: lang, rank, phrase, a, l, r, n, score."""
    counts, words = frequent_phrases(docs, text_col, lang_col, least, longest, print_bits)
    split = F.split("phrase", " ")
    many = counts.where("n > 1").select("lang", "n", "phrase", F.col("f").alias("a"), split.alias("w"))

    def part(at, size):
        return F.array_join(F.slice("w", at, size), " ")

    cuts = many.select("lang", "phrase", "a", "n", "w", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cuts = written(cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("n") - F.col("k")).alias("right")), "cuts")
    total = cuts.count()
    for side, name in (("left", "l"), ("right", "r")):
        heavy = heavy_keys(cuts.groupBy("lang", side).count(), ["lang", side], "count", total)
        cuts = joined_by_share(cuts, counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side], heavy)
    product = F.lit(2_000_000).cast("decimal(7,0)") * F.col("a").cast("decimal(19,0)")
    score = F.call_function("div", product, F.col("l").cast("decimal(19,0)") + F.col("r").cast("decimal(19,0)"))
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"), F.first("a").alias("a"))
    # Phrases that longer ones take with them.
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("n") - 1), lambda s: F.transform(F.sequence(F.lit(1), F.col("n") - s + 1), lambda i: part(i, s)))))
    longer = many.where("n > 2").select("lang", "a", inner.alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    taken = F.col("most").cast("decimal(19,0)") * 100 >= F.col("a").cast("decimal(19,0)") * 80
    left = scored.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | ~taken)
    order = {"down_score": -F.col("c.score"), "down_a": -F.col("a")}
    first = numbered(left.withColumns(order), ["lang"], [*order, "phrase"], "rank").where(F.col("rank") <= top)
    return first.join(words, "lang").select("lang", "rank", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("words").alias("n"), F.col("c.score").alias("score"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, s AS size, unnest(list_transform(range(1, len(w) - s + 2), lambda i: array_to_string(w[i:i + s - 1], ' '))) AS phrase
          FROM w, (SELECT unnest([1, 2, 3, 4]) AS s) WHERE len(w) >= s),
f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
scored AS (SELECT x.lang, x.phrase, x.a, x.k, l.f AS l, r.f AS r, ((2000000::HUGEINT * x.a) // (l.f::HUGEINT + r.f))::BIGINT AS score
           FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = x.lp JOIN f r ON r.lang = x.lang AND r.phrase = x.rp),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (SELECT lang, a, array_to_string(w[i:i + s - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, size - s + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS s FROM c WHERE size > 2))),
longer AS (SELECT lang, phrase, max(a) AS most FROM inner_phrases GROUP BY ALL),
stay AS (SELECT x.* FROM lowest x LEFT JOIN longer y USING (lang, phrase) WHERE y.most IS NULL OR 100 * y.most < 80 * x.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM stay)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

QUERIES = {"op11_collocations": (op11_collocations, OP11_SQL)}
