"""Phrase collocations, suffix-array dedup and hard negatives against brute force, on small awkward tables."""

import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from sievemask.llm import collocations, hard_negatives, suffix_dedup
from sievemask.llm.texts import bucketed, discard, heavy_keys, joined_by_share

rng = random.Random(11)


# --- collocations ---

WORDS = ["The", "the", "a", "cat", "Sat", "on", "mat", "é", "日本", "longerthansixteenbytesword", "longerthansixteenbytesworx", "x", "y", "z\x1c"]


def phrases_by_hand(rows, least, longest, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    f = {k: v for k, v in f.items() if v >= least}
    most = Counter()
    for (lang, w), a in f.items():
        for s in range(2, len(w)):
            for i in range(len(w) - s + 1):
                most[lang, w[i : i + s]] = max(most[lang, w[i : i + s]], a)
    found = {}
    for (lang, w), a in f.items():
        if len(w) > 1 and 100 * most[lang, w] < 80 * a:
            score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, r, p.decode(), -a, left, right, n[lang], -s) for lang, v in found.items() for r, (s, a, p, left, right) in enumerate(sorted(v)[:top], 1))


def some_texts():
    rows = []
    for _ in range(200):
        text = "".join(rng.choice(WORDS) + rng.choice([" ", "  ", "\t", " ", ", ", ". ", "\n", "\r\n", " "]) for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice(["en", "en", "fr", None, "und"]), text))
    rows += [("en", None), (None, None), ("en", ""), ("en", " .,; "), ("en", "new york city " * 2000)]
    return rows + [("de", "guten tag")] * 40 + [("de", "guten")] * 3  # copies


@pytest.mark.parametrize("print_bits", [64, 8])  # with 8 bits, most fingerprints stand for several phrases
def test_collocations(spark, print_bits):
    rows = some_texts()
    df = spark.createDataFrame([(i % 5 if i % 7 else None, t, lang, "x", 1) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, fp int")
    got = collocations.collocations(df.repartition(3), least=3, top=60, print_bits=print_bits)
    assert sorted(tuple(r) for r in got.collect()) == phrases_by_hand(rows, 3, 4, 60)


def test_collocations_of_nothing(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(none).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None)], "text string, lang string")).collect() == []


def summed_counts(rows):
    """Fingerprints of word pairs as tasks count them, summed: (least and greatest check, count, least pointer) of each."""
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.string(), pa.string(), pa.int64(), pa.int64()], strict=True)], ["lang", "text", "copies", "ref"])
    every = SimpleNamespace(value=np.full(1, np.iinfo(np.uint64).max, np.uint64))  # a map that keeps nothing out
    out = {}
    sent = 0
    for some in collocations._counted(2, every, 64)(iter([batch.slice(0, 100), batch.slice(100)])):
        sent += some.num_rows
        for fp, low, high, count, ref in zip(*(some.column(i).to_pylist() for i in range(5)), strict=True):
            a, b, n, r = out.get(fp, (low, high, 0, ref))
            out[fp] = (min(a, low), max(b, high), n + count, min(r, ref))
    return out, sent


@pytest.mark.parametrize("folded", [400, 1600])  # the distinct pairs are more than half of it, and leave in parts, or fewer, and are held
def test_folding_by_ranges(monkeypatch, folded):
    rows = [(lang or "und", text or "", i % 3 + 1, (i * 7919) % 1000 - 500) for i, (lang, text) in enumerate(some_texts())]
    want, sent = summed_counts(rows)
    assert sent == len(want) and 200 < sent < 800
    for name, value in (("BLOCK", 256), ("FOLDED", folded), ("RANGE", 16)):
        monkeypatch.setattr(collocations, name, value)
    assert summed_counts(rows)[0] == want


def test_counting_holds_one_copy_of_its_rows():
    """2.7 million words, nearly all pairs of them distinct: 107 MB as rows. Folding held several copies, and sent one batch of 2 million rows."""
    letters = np.random.default_rng(5).integers(97, 123, (2000, 8000), np.uint8)
    letters[:, 5::6] = 32
    texts = [row.tobytes().decode() for row in letters]
    words = sum(len(t.split()) for t in texts)
    columns = [["en"] * 2000, texts, [3] * 2000, list(range(2000))]
    every = SimpleNamespace(value=np.full(1 << 13, np.iinfo(np.uint64).max, np.uint64))  # a map that keeps nothing out
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 500]) for c in columns], ["lang", "text", "copies", "ref"]) for i in range(0, 2000, 500)]
    tracemalloc.start()
    try:
        count = largest = 0
        for batch in collocations._counted(2, every, 64)(iter(batches)):
            count += pc.sum(batch.column(3)).as_py()
            largest = max(largest, batch.num_rows)
            del batch
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert count == 3 * (words - 2000)
    assert largest <= 1 << 18
    assert peak < 250_000_000


# --- suffix arrays ---


def test_suffix_order():
    for alphabet in ("ab", "a", "abcdefgh é\x00"):
        for _ in range(60):
            data = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 70))).encode()
            some = np.array([rng.random() < 0.3 for _ in data], bool)
            assert suffix_dedup.suffix_order(data, 10**6).tolist() == sorted(range(len(data)), key=lambda p: data[p:])
            assert suffix_dedup.suffix_order(data, 10**6, some).tolist() == sorted(np.flatnonzero(some).tolist(), key=lambda p: data[p:])


def stripped_by_hand(rows, width):
    seen = Counter(r[a : a + width] for _, t in rows for r in [(t or "").encode()] for a in range(len(r) - width + 1))
    out = []
    for doc_id, t in rows:
        r = (t or "").encode()
        gone = np.zeros(len(r), bool)
        for a in range(len(r) - width + 1):
            if seen[r[a : a + width]] > 1:
                gone[a : a + width] = True
        kept = bytes(b for b, x in zip(r, gone, strict=True) if not x)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((doc_id, len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def mosaic():
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))) for _ in range(50)]
    rows = [*enumerate(base), *((100 + i, rng.choice(base)) for i in range(25))]
    for i in range(50):
        a, b = rng.choice(base), rng.choice(base)
        rows.append((200 + i, f"{a[: rng.randint(0, len(a))]}#{i}#{b[rng.randint(0, len(b)) :]}"))
    rows += [(400 + i, f"{i} " + base[0][:60] + f" {i}") for i in range(60)]  # one passage in ever other company
    rows += [(300, None), (301, ""), (None, base[0]), (None, None), (302, "a" * 300), (303, "ab" * 200), (305, "x" + "z" * 40), (305, "x" + "z" * 40)]
    return rows


@pytest.mark.parametrize("large", [suffix_dedup.LARGE, 300])  # with 300 bytes a group, most groups are cut
def test_suffix_dedup(spark, monkeypatch, large):
    monkeypatch.setattr(suffix_dedup, "LARGE", large)
    rows = mosaic()
    df = spark.createDataFrame([(*r, "x", b"y") for r in rows], "doc_id long, text string, tid string, key binary").repartition(3)
    got = [tuple(r) for r in suffix_dedup.deduplicated(df, width=40).collect()]
    assert sorted([(*r[:5], bytes(r[5])) for r in got], key=str) == stripped_by_hand(rows, 40)


def test_suffix_dedup_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 1000)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    long = "".join(rng.choice("abcdefgh ") for _ in range(9000))
    rows = [(1, long[:4000] + shared + long[4000:]), (2, shared[200:] + "!" + shared[:700]), (3, long[::-1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(*r[:5], bytes(r[5])) for r in suffix_dedup.deduplicated(df, width=400).collect()]
    assert sorted(got, key=str) == stripped_by_hand(rows, 400)
    assert suffix_dedup.deduplicated(df.limit(0)).collect() == []


# --- hard negatives ---


def negatives_by_hand(rows, scale=256):
    best = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            best[i] = min(best.get(i, (label, v)), (label, v))
    whole = {i: (label, [int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale) for x in v]) for i, (label, v) in best.items()}
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = []
    for a, (label, v) in whole.items():
        if a % 50 == 0:
            scores = [(-sum(x * y for x, y in zip(v, w, strict=False)), i, other) for i, (other, w) in whole.items() if i != a]
            for s, p, _ in sorted(x for x in scores if x[2] == label)[:5]:
                fit = sorted(x for x in scores if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s)[:3]
                out += [(a, p, r, x[1], clip(-s), clip(-x[0])) for r, x in enumerate(fit, 1)]
    return sorted(out)


def some_vectors():
    rows = [(i, rng.randint(0, 3) if i % 9 else 1, [float(rng.randint(-3, 3)) / 4 for _ in range(6)]) for i in range(300)]
    rows += [(1000, None, [1.0] * 6), (1050, 1, None), (1100, 1, [float("nan")] * 6), (1150, 1, [float("inf")] + [0.0] * 5), (1200, 2, [None] + [1.0] * 5)]
    rows += [(None, 1, [1.0] * 6), (1250, 1, [0.5]), (1300, 2, []), (50, 1, [9.0] * 6), (50, 1, [9.0] * 6), (1350, 77, [1.0] * 6), (1351, 2, [0.25] * 9)]
    return rows


CASES = {
    "plain": [],
    "beyond 64 bits": [(1400, 1, [1e30, 1.0]), (1401, 1, [-1e20, 1.0]), (1402, 2, [3e38] * 6), (1450, 2, [1e38] * 6), (1403, 2, [2.5e38] * 6), (1405, 1, [8e37] * 6)],
    "beyond doubles": [(1400, 1, [1e308] * 6), (1401, 1, [1.7e308] * 6), (1402, 2, [8e307] * 6), (1403, 2, [-1e308] * 6), (1404, 2, [1e307] * 6)],
}


@pytest.mark.parametrize("case", CASES)
def test_hard_negatives(spark, monkeypatch, case):
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)
    monkeypatch.setattr(hard_negatives, "GROUP", 4)
    rows = some_vectors() + CASES[case]
    df = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], "vec_id long, label int, embedding array<double>, id string, anchor int, score int").repartition(3)
    got = hard_negatives.mined(df, F.col("id") % 50 == 0, "vec_id", "label", "embedding")
    assert sorted(tuple(r) for r in got.collect()) == negatives_by_hand(rows)


def test_hard_negatives_of_ties_and_nothing(spark):
    zeros = [(i, i % 2, [0.0, 0.0]) for i in range(120)]
    schema = "vec_id long, label int, embedding array<float>"
    mine = lambda rows: hard_negatives.mined(spark.createDataFrame(rows, schema), F.col("id") % 50 == 0, "vec_id", "label", "embedding").collect()
    assert sorted(tuple(r) for r in mine(zeros)) == negatives_by_hand(zeros)
    assert mine([]) == []


# --- joins and tables ---


def test_join_by_share_and_discard(spark):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 7, id) as k", "id")
    found = spark.range(4000).selectExpr("id as k", "id * 2 as v")
    heavy = heavy_keys(rows.groupBy("k").count(), ["k"], "count", 5000)
    assert [r["k"] for r in heavy.collect()] == [7]
    assert joined_by_share(rows, found, ["k"], heavy).exceptAll(rows.join(found, "k")).isEmpty()
    held = bucketed(rows, "id", "held")
    assert held.count() == 5000
    discard(held, heavy)
    with pytest.raises(Exception, match="(?i)does not exist|not exist|FileNotFound|FILE_NOT_EXIST"):
        held.groupBy("k").count().collect()


# --- top-k of any size of numbers ---


@pytest.mark.parametrize("case", ["64 bits", *list(CASES)[1:]])
def test_topk_of_large_numbers(spark, case):
    from sievemask.llm import topk

    rows = [(i, v) for i, _, v in some_vectors() if i != 50]
    rows += [(i, v) for i, _, v in CASES[case]] if case in CASES else [(2000 + i, [rng.uniform(-4e5, 4e5) for _ in range(6)]) for i in range(60)]
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole[i] = [int(x) * 1024 if abs(x) >= 2**53 else math.floor(x * 1024) for x in v]
    want = []
    for q, v in whole.items():
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i) for i, w in whole.items() if i != q)[:10]
            want += [(q, r, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(scores, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = topk.top_k(df, lambda ids: ids % 50 == 0, "vec_id", "embedding")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_runs_of_long_texts_hold_every_window_once(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 700)
    data = np.frombuffer("".join(rng.choice("abc ") for _ in range(5000)).encode(), np.uint8)
    offsets = np.array([0, 0, 1200, 1250, 5000])
    seen = Counter()
    for row, first, n, back, _key in suffix_dedup._runs(data, offsets, 100):
        for r, a, k, b in zip(row.tolist(), first.tolist(), n.tolist(), back.tolist(), strict=True):
            assert offsets[r] <= a and a + k - 1 + 100 <= offsets[r + 1] and 0 <= b <= 100
            seen.update(range(a, a + k))
    assert seen == Counter([*range(1101), *range(1250, 4901)])


# --- versions of a template ---


@pytest.mark.parametrize("count", [150, 300])
def test_versions_below_the_threshold_make_no_pairs(spark, count):
    """Mutual similarity 0.77: bands hold all of them, no two link, and nothing is made for their pairs; planted links are found."""
    from sievemask.llm import near_dedup

    body = " ".join(f"t{i}" for i in range(201))
    rows = [(i, body + "".join(f" v{i}x{k}" for k in range(30))) for i in range(count)]
    rows += [(1000 + i, rows[i][1].replace(f"v{i}x29", "other")) for i in range(0, count, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = docs.selectExpr("doc_id as id", "text")
    open_ = docs.selectExpr("doc_id as rep", "doc_id as component", "cast(230 as long) as n")
    pairs = {(r["a"], r["b"]) for r in near_dedup._rare_pairs(open_, texts, 2, 0.8).collect()}
    assert pairs == {(1000 + i, i) for i in range(0, count, 30)}
    if count == 150:
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.linked(docs, 2).collect()}
        assert got == {i: i % 1000 for i, _ in rows}


def test_rare_pairs_lose_no_link(spark):
    from sievemask.llm import near_dedup

    sets = {}
    for i in range(160):
        n = rng.choice([1, 2, 3, 5, 9, 20, 40])
        base = sets[rng.randrange(i)] if i and rng.random() < 0.6 else [f"w{rng.randrange(60)}" for _ in range(n + 1)]
        sets[i] = [w if rng.random() > 0.05 else f"w{rng.randrange(60)}" for w in base]
    grams = {i: {tuple(w[k : k + 2]) for k in range(len(w) - 1)} or {tuple(w)} for i, w in sets.items()}
    want = {(a, b) for a in grams for b in grams if b < a and 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b])}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in sets.items()], "id long, text string")
    open_ = spark.createDataFrame([(i, i, len(g)) for i, g in grams.items()], "rep long, component long, n long")
    got = {(r["a"], r["b"]) for r in near_dedup._rare_pairs(open_, docs, 2, 0.8).collect()}
    assert want <= got and len(want) > 20
