"""The pipeline's stages on awkward rows, and every query of the package on the smallest tables."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_operators import components_of, shingle_set

from sievemask.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_rows(spark):
    rows = [(i, f"word{i} and some more words of text number {i} which goes on", "en", "a" if i % 3 else "b", 1, "x") for i in range(40)]
    rows += [(100, rows[0][1], "en", "a", 1, "x"), (101, None, None, None, None, None), (102, "123 !?", "en", "a", 1, "x"), (None, "an idless text with words", "en", None, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, hash string")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns, name
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        assert ids == {r[0] for r in rows} - {101, 102} - ({100} if name != "language_id" else set())
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, kept, SF).select("doc_id").collect()} == ids
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where(F.lit(False)), SF).count() == 0


def test_stages_against_brute_force(spark):
    """Each stage on what the one before kept: rows without a letter go, the least id of equal texts and of near copies stays, every kept document
    is taken once or twice, and its tokens lie in sequences without a gap."""
    rng = random.Random(8)
    texts = {}
    for i in range(60):
        texts[i] = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "und", "the", "of", "ein", f"x{rng.randrange(400)}"]) for _ in range(rng.randrange(5, 90)))
    for i in range(60, 110):  # copies with a word or two changed
        words = texts[rng.randrange(60)].split()
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = f"y{rng.randrange(10**6)}"
        texts[i] = " ".join(words)
    texts |= {200: texts[3], 201: texts[3] + " ", 202: None, 203: "12 34 --", 204: "w " * 30_000, 205: "w " * 30_000}
    ids = list(texts)
    rng.shuffle(ids)
    docs = spark.createDataFrame([(i, texts[i], "en" if i % 2 else "de", "big" if i % 5 else "small", 1) for i in ids], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    ids_of = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())

    lettered = stages["language_id"](spark, docs, SF)
    want = sorted(i for i, t in texts.items() if t and any(c.isalpha() for c in t))
    assert ids_of(lettered) == want
    distinct = stages["exact_dedup"](spark, lettered, SF)
    want = sorted({min(j for j in want if texts[j] == texts[i]) for i in want})
    assert ids_of(distinct) == want
    near = stages["near_dedup"](spark, distinct, SF)
    component = components_of({i: shingle_set(texts[i], 5) for i in want})
    want = sorted(i for i in want if component[i] == i)
    assert ids_of(near) == want
    mixed = stages["mixing"](spark, near, SF)
    taken = Counter(ids_of(mixed))
    assert sorted(taken) == want and max(taken.values()) <= 2
    pieces = stages["packing"](spark, mixed, SF).collect()
    held = defaultdict(list)
    for r in pieces:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in held.values():
        spans.sort()
        assert all(at == sum(n for _, n in spans[:k]) for k, (at, _) in enumerate(spans)) and sum(n for _, n in spans) <= 2048
    tokens = Counter()
    for r in pieces:
        tokens[r["doc_id"]] += r["length"]
    assert dict(tokens) == {i: taken[i] * next(r["doc_tokens"] for r in pieces if r["doc_id"] == i) for i in want}


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("n", range(1, 14))
def test_one_query_for_each_operator(n):
    assert len([q for q in QUERIES if q.startswith(f"op{n}_")]) == 1
