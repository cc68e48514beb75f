"""Matching and scoring on hand-made and random cases."""

import random

from pyspark.sql import functions as F

from sievemask.operators import scoring as S
from sievemask.schemas import SAMPLES

SPANS = "array<struct<start:int,end:int,entity:string>>"


def greedy(gold, predicted, strict):
    over = lambda a, b: max(0, min(a[1], b[1]) - max(a[0], b[0]))
    pairs = sorted(
        (-over(g, p), i, j) for i, g in enumerate(gold) for j, p in enumerate(predicted)
        if g[2] == p[2] and ((g[0], g[1]) == (p[0], p[1]) if strict else over(g, p) > 0)
    )
    g_used, p_used, hits = set(), set(), {}
    for _, i, j in pairs:
        if i not in g_used and j not in p_used:
            g_used.add(i), p_used.add(j)
            hits[gold[i][2]] = hits.get(gold[i][2], 0) + 1
    return hits


def test_matching_against_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        make = lambda n: [(s := rng.randint(0, 40), s + rng.randint(1, 12), rng.choice(["A", "B"])) for _ in range(n)]
        gold, pred = make(rng.randint(0, 7)), make(rng.randint(0, 7))
        pred += [g for g in gold if rng.random() < 0.4]
        rows.append((i, gold, pred))
    df = spark.createDataFrame(rows, f"i int, gold {SPANS}, pred {SPANS}").repartition(8)
    m = df.select("i", F.explode(S.match_spans(F.col("gold"), F.col("pred"))).alias("m")).groupBy("i", "m.entity").agg(
        F.sum("m.strict").alias("strict"), F.sum("m.relaxed").alias("relaxed"), F.sum("m.gold").alias("gold"), F.sum("m.predicted").alias("predicted")
    )
    got = {(r["i"], r["entity"]): r for r in m.collect()}
    for i, gold, pred in rows:
        for e in {x[2] for x in gold + pred}:
            r = got[i, e]
            assert (r["gold"], r["predicted"]) == (sum(g[2] == e for g in gold), sum(p[2] == e for p in pred))
            assert r["strict"] == greedy(gold, pred, True).get(e, 0)
            assert r["relaxed"] == greedy(gold, pred, False).get(e, 0)


def _sample(i, kind, spans=(), decoy=None, lang="en"):
    return (i, "x" * 40, (kind, list(spans) if kind == "positive" else None, decoy), lang, "easy", "handwritten", "t")


def test_a_small_run(spark):
    samples = spark.createDataFrame(
        [_sample("a", "positive", [(0, 10, "PAN")]), _sample("b", "hard_negative", decoy="PHONE", lang="hi-Latn"), _sample("c", "positive"), _sample("d", "positive", [(0, 3, "PAN")])], SAMPLES
    )
    records = spark.createDataFrame(
        [
            ("a", "detected", [(0, 10, "PAN", None)], 100, 110, None), ("b", "detected", [(5, 15, "PHONE", None)], 300, 310, None),
            ("c", "detected", [(1, 3, None, "ORG")], 200, 210, None), ("d", "failed", None, None, None, "boom"),
        ],
        "sample_id string, status string, predicted array<struct<start:int,end:int,mapped:string,unmapped:string>>, elapsed_ns long, wall_ns long, message string",
    )
    scored = S.joined(samples, records)
    t = {(r["dimension"], r["value"], r["mode"]): (r["tp"], r["fp"], r["fn"]) for r in S.totals(scored).collect()}
    assert t["micro", "", "strict"] == (1, 1, 1)
    assert t["entity", "PAN", "relaxed"] == (1, 0, 1)
    assert t["lang", "hi-Latn", "relaxed"] == (0, 1, 0)
    assert t["source", "handwritten", "strict"] == (1, 1, 1)
    assert [tuple(r) for r in S.hard_negatives(scored).collect()] == [("PHONE", 1, 1, 1)]
    assert [tuple(r) for r in S.unmapped_labels(scored).collect()] == [("ORG", 1, 0)]
    assert tuple(S.coverage(samples, records).first()) == (4, 0, 1)
    summary = S.run_summary(samples, records).first()
    assert (summary["tool_p50_ns"], summary["samples"], summary["hard_negative_rate"]) == (200, "4", 1.0)
    bad = S.record_problems(samples, records.union(records.where("sample_id = 'a'")).union(records.where("sample_id = 'b'").withColumn("sample_id", F.lit("zzz"))))
    assert {(r["sample_id"], r["problem"]) for r in bad.collect()} == {("a", "repeated record"), ("zzz", "unknown sample")}
