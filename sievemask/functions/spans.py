"""Span arrays inside a row: finding, resolving overlaps, splicing. No shuffle, no Python worker.

Everything here stays linear in the number of spans for ordinary texts: spans are swept once in start order and
only spans that really overlap (one cluster) are compared with each other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOUND = "struct<start:int,end:int,value:string>"


def empty(element: str) -> Column:
    return F.array().cast(f"array<{element}>")


def unfolded(rows: DataFrame, kept: list, values: Column | str, out: str, pos: str = "_pos") -> DataFrame:
    """`kept` columns with a row for each element of `values`: the element and its place from 0.

    After a plain `explode` the optimizer asks for the array's size first, and pushes that filter down to the scan or into a join: what the
    array is made of is then spelled out and computed once more, or as often as its expressions mention each other."""
    return rows.select(*kept, F.posexplode_outer(values).alias(pos, out)).where(F.col(pos).isNotNull())


def overlap(a: Column, b: Column) -> Column:
    return F.greatest(
        F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"])
    )


# A noncharacter: not valid in interchange, so texts normally do not hold it.
_MARK = "\uffff"


def _alternating(text: Column, pattern: str) -> Column:
    """The text cut into gap, match, gap, …, gap."""
    marked = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    cut = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")
    )
    direct = F.flatten(F.transform(cut, lambda z: F.array_compact(F.array(z["gap"], z["hit"]))))
    return F.when(F.contains(text, F.lit(_MARK)), direct).otherwise(marked)


def pattern_spans(text: Column, pattern: str) -> Column:
    """All non-overlapping matches with code-point offsets; an empty array when nothing matches.

    One pass of the pattern puts a mark on both sides of each match; cutting at the mark then gives gaps and
    matches in turn, and a running sum of their lengths the offsets. A text that holds the mark itself is cut by
    the pattern directly."""
    def found(pieces: Column) -> Column:
        # Pieces alternate: gap, match, gap, …, gap.
        def hits(ends: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(2), F.size(pieces), F.lit(2)),
                lambda i: F.struct(
                    F.element_at(ends, i - 1).alias("start"), F.element_at(ends, i).alias("end"), F.element_at(pieces, i).alias("value")
                ),
            )

        ends = running(F.transform(pieces, F.length), lambda x, y: x + y, F.lit(0))
        return F.when(F.size(pieces) > 1, bound(ends, hits)).otherwise(empty(FOUND))

    return bound(_alternating(text, pattern), found)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with `value` evaluated once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def part(values: Column, first: Column, last: Column) -> Column:
    """Elements `first` to `last`, counted from 1. `slice` would copy the whole array first."""
    return F.transform(F.sequence(first, last), lambda i: F.element_at(values, i))


STRIDE = 64


def running(values: Column, merge: Callable[[Column, Column], Column], zero: Column, element: str = "int") -> Column:
    """Running totals (inclusive) of an array under an associative `merge`.

    A plain fold that appends copies its array at every step. Here strides of the array are folded on their own and
    then their totals, so an array of 100,000 costs a few steps for each element."""

    def within(part: Column, start: Column) -> Column:
        grown = F.aggregate(
            part,
            F.struct(start.alias("at"), empty(element).alias("out")),
            lambda acc, x: F.struct(merge(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(merge(acc["at"], x))).alias("out")),
        )
        return grown["out"]

    def whole(v: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(v), F.lit(STRIDE))
        stride = lambda i: part(v, i, F.least(i + STRIDE - 1, F.size(v)))
        totals = F.transform(firsts, lambda i: F.aggregate(stride(i), zero, merge))
        return bound(
            within(totals, zero),
            lambda upto: F.flatten(
                F.transform(
                    firsts,
                    lambda i, k: within(stride(i), F.when(k == 0, zero).otherwise(F.get(upto, k - 1))),
                )
            ),
        )

    return bound(values, lambda v: F.when(F.size(v) <= STRIDE, within(v, zero)).otherwise(whole(v)))


def clustered(
    spans: Column,
    result: str,
    settle: Callable[[Column], Column],
    reach: Callable[[Column], Column],
    starts_new: Callable[[Column, Column], Column],
    zero: Column,
    element: str = "int",
) -> Column:
    """`settle(cluster)` over runs of touching spans, one after the other. `spans` are in sweep order.

    `starts_new(span, furthest)` decides whether a span opens a cluster; `furthest` is the greatest `reach` before it."""

    def sweep(s: Column) -> Column:
        def opens(furthest: Column) -> Column:
            numbers = F.sequence(F.lit(1), F.size(s))
            return F.filter(numbers, lambda i: (i == 1) | starts_new(F.element_at(s, i), F.element_at(furthest, F.greatest(i - 1, F.lit(1)))))

        def cut(at: Column) -> Column:
            return F.flatten(F.transform(at, lambda i, k: settle(part(s, i, F.coalesce(F.get(at, k + 1) - 1, F.size(s))))))

        return bound(bound(running(F.transform(s, reach), lambda x, y: F.greatest(x, y), zero, element), opens), cut)

    return bound(spans, lambda s: F.when(F.size(s) > 0, sweep(s)).otherwise(empty(result)))


CANDIDATE = "struct<start:int,end:int,rank:int,label:string,value:string>"


def resolve_overlaps(candidates: Column) -> Column:
    """Keeps the longest of overlapping candidates (ties: earlier start, then recognizer order), by start."""

    def longest_first(a: Column, b: Column) -> Column:
        def key(x: Column) -> Column:
            return F.struct((x["start"] - x["end"]), x["start"], x["rank"])

        return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)

    def settle(cluster: Column) -> Column:
        kept = F.aggregate(
            F.array_sort(cluster, longest_first),
            empty(CANDIDATE),
            lambda kept, c: F.when(F.exists(kept, lambda k: (c["start"] < k["end"]) & (k["start"] < c["end"])), kept)
            .otherwise(F.concat(kept, F.array(c))),
        )
        return F.when(F.size(cluster) == 1, cluster).otherwise(F.sort_array(kept))

    return clustered(
        F.sort_array(candidates), CANDIDATE, settle, lambda c: c["end"], lambda c, furthest: c["start"] >= furthest, F.lit(-1)
    )


def splice(text: Column, replacements: Column) -> Column:
    """`text` with each `(start, end, replacement)` put in; the array is in start order and disjoint."""

    def around(r: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(0)).otherwise(F.get(replacements, i - 1)["end"])
        return F.concat(F.substring(text, before + 1, r["start"] - before), r["replacement"])

    rest = F.substring(text, F.coalesce(F.element_at(replacements, -1)["end"], F.lit(0)) + 1, F.length(text))
    return F.when(F.size(replacements) == 0, text).otherwise(F.concat(F.array_join(F.transform(replacements, around), ""), rest))
