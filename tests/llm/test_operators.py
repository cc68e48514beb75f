"""The corpus operators on small awkward tables, against brute force."""

import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievemask.llm import ctw, exact_dedup, html_text, langid, mixing, near_dedup, packing, token_counts, topk, tokens, warc
from sievemask.llm.common import text_slices, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, id string, `_key` int, component int, found string"
LONG = " ".join(f"w{i % 977} end." for i in range(40_000))
ROWS = [
    (1, "the cat sat on the mat today", "en", "a", 1), (2, "the cat sat on the mat today", "en", "a", 1), (2, "the cat sat on the mat today", "en", "a", 1),
    (3, None, "en", "b", None), (4, "", None, None, 0), (5, "   \n\t ", "fr", "b", 3), (6, "One", "fr", None, 3), (7, "one", "en", "c", 3),
    (8, LONG, "en", "a", len(LONG)), (9, LONG + " x", "en", None, 1), (None, "no id here at all", "en", "a", 1), (None, None, None, None, None),
    (10, "é ́ 日本語 \U0001F600 <|endoftext|> it's  12345!?\r\n\n", "fr", "b", 1), (11, "a\x0bb\x1cc d", "en", "b", 1), (12, "12 !? 34", "en", "b", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "h", "i", 7, 8, "f") for r in ROWS], SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def byte_words(text):
    return (text or "").encode().lower().split()


def shingle_set(text, width):
    w = byte_words(text)
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def components_of(sets, percent=80):
    """sets: by id. Least id reachable over links."""
    up = {k: k for k in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {k: top(k) for k in sets}


def test_words_are_cut_like_bytes_split():
    texts = pa.array([t for _, t, *_ in ROWS] + ["A b", "a B", "a  b ", " x"])
    seen = {}
    for at, data, offsets in text_slices(texts, 64):
        hashes, starts, ends, first = words(data, offsets)
        for i in range(len(offsets) - 1):
            mine = range(first[i], first[i + 1])
            assert [bytes(data[starts[k] : ends[k]]).lower() for k in mine] == byte_words(texts[at + i].as_py())
            for k in mine:
                assert seen.setdefault(bytes(data[starts[k] : ends[k]]).lower(), hashes[k]) == hashes[k]
    assert len(set(seen.values())) == len(seen)


# --- near dedup ---


def test_near_dedup_on_awkward_rows(docs, none):
    for width in (2, 5):
        got = near_dedup.linked(docs, width).collect()
        want = components_of({i: shingle_set(t, width) for i, t, *_ in ROWS if i is not None})
        assert sorted((r.doc_id, r.n_shingles) for r in got if r.doc_id) == sorted((i, len(shingle_set(t, width))) for i, t, *_ in ROWS if i)
        assert all(r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
        assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    assert near_dedup.linked(none).count() == 0
    kept = near_dedup.deduplicated(docs, 5)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == sorted("1 10 11 12 3 4 5 6 8 None None".split())
    assert near_dedup.deduplicated(none).count() == 0


@pytest.mark.parametrize("n", range(6))
def test_a_short_document_alone_in_its_slice(n):
    text = " ".join(f"w{i}" for i in range(n))
    [(_, data, offsets)] = text_slices(pa.array([text]), 1 << 19)
    hashes, _, _, first = words(data, offsets)
    sets, starts = near_dedup.shingles(hashes, first, 5)
    assert starts.tolist() == [0, len(shingle_set(text, 5))] and len(sets) == starts[-1]
    # The same set as beside a longer document.
    [(_, data, offsets)] = text_slices(pa.array([text, "a b c d e f g"]), 1 << 19)
    hashes, _, _, first = words(data, offsets)
    both, begin = near_dedup.shingles(hashes, first, 5)
    assert sets.tolist() == both[: begin[1]].tolist()


def test_one_short_document_is_kept(spark):
    frame = spark.createDataFrame([(1, "two words")], "doc_id long, text string")
    assert [r.kept for r in near_dedup.linked(frame, 5).collect()] == [True]


def test_near_dedup_follows_chains_and_hubs(spark):
    rng = random.Random(3)
    texts, n = {}, 0
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    for k in range(60):  # a chain: each copy differs from the one before in two words
        base = list(base)
        for _ in range(2):
            base[rng.randrange(120)] = f"c{k}-{rng.randrange(10**6)}"
        texts[n] = " ".join(base)
        n += 1
    hub = [f"h{i}" for i in range(100)]
    for k in range(80):  # around a hub that is neither the least nor the greatest id
        copy = list(hub)
        for i in rng.sample(range(100), 0 if k == 40 else 9):
            copy[i] = f"x{k}-{i}"
        texts[n] = " ".join(copy)
        n += 1
    for _ in range(60):
        texts[n] = " ".join(f"r{rng.randrange(50)}" for _ in range(rng.randrange(1, 60)))
        n += 1
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    for width in (2, 3):
        want = components_of({i: shingle_set(t, width) for i, t in texts.items()})
        assert {r.doc_id: r.component_id for r in near_dedup.linked(frame, width).collect()} == want


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for shared in (300, 900, 1800):
        a, b = np.sort(pool[:2000]), np.sort(pool[2000 - shared : 4000 - shared][:2000])
        regs = near_dedup.registers(np.concatenate([a, b]), np.array([0, len(a)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(near_dedup.estimates(regs[:1], regs[1:], np.array([len(a)]), np.array([len(b)]))[0] - true) < 0.13
        whole = near_dedup.registers(np.union1d(a, b), np.array([0]))
        assert (whole == np.maximum(regs[0], regs[1])).all()  # mergeable


# --- mixing ---


def brute_mix(rows, entropy_share, max_repetition, seed=17):
    """rows: (id, source, tokens)."""
    total = sum(n for *_, n in rows)
    by = defaultdict(int)
    for _, s, n in rows:
        by[s] += n
    p = {s: n / total for s, n in by.items() if n}

    def good(a):
        w = {s: x**a for s, x in p.items()}
        z = sum(w.values())
        h = -sum(x / z * math.log(x / z) for x in w.values())
        r = [w[s] / p[s] for s in p]
        return h <= entropy_share * math.log(len(p)) and max(r) / min(r) <= max_repetition

    low, high = 0.0, 1.0
    for _ in range(28):
        m = (low + high) / 2
        low, high = (low, m) if good(m) else (m, high)
    w = {s: x**high for s, x in p.items()}
    z = sum(w.values())
    out = Counter()
    for s, n in by.items():
        mine = [(i, t) for i, x, t in rows if x == s]
        budget = round(w[s] / z * total * max(p[x] / w[x] for x in p) * z) if n else 0
        epochs, rest = divmod(budget, n) if n else (1, 0)
        key = {i: hashlib.md5(f"{seed}/{epochs}/{'null' if i is None else i}".encode()).hexdigest()[:6] for i, _ in mine}
        blocks = defaultdict(int)
        for i, t in mine:
            blocks[key[i]] += t
        upto, taken = 0, set()
        for k in sorted(blocks):
            upto += blocks[k]
            if upto > rest:
                break
            taken.add(k)
        for i, t in mine:
            for e in range(epochs + (rest > 0 and key[i] in taken)):
                out[i, s, e, t] += 1
    return out


def test_mixing_matches_brute_force(spark, docs, none):
    rng = random.Random(5)
    rows = [(i, rng.choice("aaaaaaabbc"), rng.randrange(0, 40)) for i in range(400)] + [(900, None, 7), (901, "empty", 0), (902, "empty", 0)]
    frame = spark.createDataFrame([(i, s, " ".join(["x"] * n)) for i, s, n in rows], "doc_id long, source string, text string").repartition(3)
    for limits in ((0.98, 2.0), (0.7, 50.0), (0.999, 4.0)):
        got = Counter((r.doc_id, r.source, r.epoch, r.n_tokens) for r in mixing.mixed(frame, *limits).collect())
        assert got == brute_mix(rows, *limits)
    got = Counter((r.doc_id, r.source, r.epoch, r.n_tokens) for r in mixing.mixed(docs).collect())
    assert got == brute_mix([(i, s, len(byte_words(t))) for i, t, _, s, _ in ROWS], 0.98, 2.0)
    assert mixing.mixed(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns and whole.count() == sum(got.values())


def test_mixing_keeps_a_budget(spark):
    frame = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 1500, "big").otherwise("small").alias("source"))
    got = mixing.mixed(frame, budget_tokens=1200).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    assert 1190 <= sum(r.n for r in got) <= 1200


# --- language ID ---


def test_phrases_match_a_naive_parse():
    rng = random.Random(2)
    for _ in range(30):
        known = [rng.randrange(1, 5) for _ in range(40)]
        grid = np.array([[rng.randrange(1, 6)] for _ in range(25)], np.uint8)
        seen = {tuple(known[a:b]) for a in range(40) for b in range(a + 1, 41)} | {()}
        count, held = 0, ()
        for s in grid[:, 0].tolist():
            if (*held, s) in seen:
                held = (*held, s)
            else:
                count += 1
                held = (s,) if (s,) in seen else ()
        assert langid.Automaton(known).phrases(grid)[0] == count + bool(held)


def test_phrases_of_wide_alphabets_match_a_naive_parse():
    rng = random.Random(3)
    for _ in range(30):
        known = [rng.choice((1, 2, 64, 65, 900)) for _ in range(40)]
        grid = np.array([[rng.choice((1, 2, 3, 64, 65, 66, 900, 5000))] for _ in range(25)], np.uint16)
        seen = {tuple(known[a:b]) for a in range(40) for b in range(a + 1, 41)} | {()}
        count, held = 0, ()
        for s in grid[:, 0].tolist():
            if (*held, s) in seen:
                held = (*held, s)
            else:
                count += 1
                held = (s,) if (s,) in seen else ()
        assert langid.Automaton(known).phrases(grid)[0] == count + bool(held)


def test_languages_of_many_letters():
    rng = random.Random(4)
    # Three scripts of 150 letters; the first has so many texts that its letters are the most frequent ones. bb and cc share theirs.
    letters = {"aa": 0x4E00, "bb": 0xAC00, "cc": 0xAC00, "dd": 0xA000}
    words_of = {k: ["".join(chr(a + rng.randrange(150)) for _ in range(3)) for _ in range(80)] for k, a in letters.items()}

    def text(lang, n):
        return " ".join(rng.choice(words_of[lang]) for _ in range(n))

    model = langid.Model({k: [text(k, 60) for _ in range(40 if k == "aa" else n)] for n, k in enumerate(letters, 6)})
    truth = [k for k in letters for _ in range(20)]
    assert model.predict([text(k, 20) for k in truth])[0] == truth


def test_language_of_awkward_rows(spark, docs, none):
    model = langid.fitted(docs, F.lit(True))
    rows = langid.labelled(docs, model).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.lang_score <= 1
    assert langid.labelled(none, model).count() == 0
    assert {r.lang_pred for r in langid.labelled(docs, langid.fitted(none, F.lit(True))).collect()} == {"und"}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.001"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in langid.op3_langid(spark, sf).collect() if r.held_out]
    assert len(held) > 20 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


# --- tokens ---


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.default_path())


def test_ids_are_those_of_the_whole_text(encoder):
    rng = random.Random(4)
    texts = [t or "" for _, t, *_ in ROWS if t != LONG] + ["".join(rng.choice("ab  \n\t 1,.'sé　\x1c") for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    for t in texts:
        assert np.frombuffer(encoder.ids(t), "<u4").tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_packing_is_a_partition_of_all_ids(docs, none, encoder):
    import zlib

    rows = packing.packed(docs).collect()
    whole = {}
    for i, t, *_ in ROWS:
        whole.setdefault(i, []).append(np.append(np.frombuffer(encoder.ids(t or ""), "<u4"), 1).astype("<u4"))
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for i, texts in whole.items():
        left = Counter((len(t), a.start, a.length) for t in texts for a in pieces[i] if a.doc_tokens == len(t))
        assert sum(a.length for a in pieces[i]) == sum(map(len, texts)) and left
        if len(texts) == 1:
            at = 0
            for a in sorted(pieces[i], key=lambda a: a.start):
                assert a.start == at and a.ids_crc32 == zlib.crc32(texts[0][at : at + a.length].tobytes()) and a.doc_tokens == len(texts[0])
                at += a.length
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    assert packing.packed(none).count() == 0


def test_cuts_are_optimal():
    rng = random.Random(6)
    for _ in range(60):
        places = sorted({0, 10, 20, 30, 40, 50, 60, *rng.sample(range(1, 60), rng.randrange(1, 20))})
        prices = [0.0] + [rng.choice([0.0, 6.0, 24.0]) for _ in places[1:]]

        def pad(n):
            return 0 if n & (n - 1) == 0 else 16 - n

        best = [0.0] + [math.inf] * (len(places) - 1)
        for j in range(1, len(places)):
            for i in range(j):
                if places[j] - places[i] <= 16:
                    best[j] = min(best[j], best[i] + pad(places[j] - places[i]) + prices[j] + packing.SEQUENCE_PRICE)
        path = packing.cuts(np.array(places), np.array(prices), 16)
        price = dict(zip(places, prices, strict=True))
        assert math.isclose(sum(pad(b - a) + price[b] + packing.SEQUENCE_PRICE for a, b in itertools.pairwise(path)), best[-1])


def test_section_tokens_match_offsets(docs, none, encoder):
    for rule in ("first", "most"):
        rows = token_counts.section_tokens(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), rule=rule).collect()
        by = defaultdict(list)
        for r in rows:
            by[r.doc_id].append(r)
        for i, t, *_ in {r[0]: r for r in ROWS if r[0] is not None}.values():
            t = t or ""
            mine = sorted(by[i], key=lambda r: r.section)
            spans = encoder.tokenizer.encode(t, add_special_tokens=False).offsets
            assert sum(r.n_tokens for r in mine) == len(spans) and sum(r.n_chars for r in mine) == len(t)
            assert len(mine) == max(1, len(t.splitlines(keepends=True)) if "\r" not in t and "\x0b" not in t and "\x1c" not in t else len(mine))
            if rule == "first":
                starts = [r.start for r in mine]
                want = Counter(max(k for k, s in enumerate(starts) if s <= a) for a, _ in spans)
                assert [r.n_tokens for r in mine] == [want[k] for k in range(len(mine))]
    assert token_counts.section_tokens(none).count() == 0


def test_a_crossing_token_goes_where_most_of_it_is():
    n, crossing = token_counts.attributed("aabbb", np.array([0, 1]), np.array([1, 4]), np.array([0, 2]))
    assert n.tolist() == [1, 1] and crossing.tolist() == [1, 1]
    n, _ = token_counts.attributed("aabbb", np.array([0, 1]), np.array([1, 4]), np.array([0, 2]), "first")
    assert n.tolist() == [2, 0]


# --- top k ---


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    vectors = [(i, rng.normal(0, 0.2, 6).round(2).tolist()) for i in range(900)]
    vectors += [(i, [0.5] * 6) for i in range(900, 960)] + [(1000, None), (1001, [None] * 6), (1002, [math.nan] + [0.1] * 5), (1003, [math.inf] * 6), (None, [0.1] * 6), (1004, [0.3, 0.2]), (1100, []), (5, vectors[5][1])]
    frame = spark.createDataFrame([(*v, 1, "x") for v in vectors], "vec_id long, embedding array<double>, label int, id string").repartition(4)
    got = defaultdict(list)
    for r in topk.top_k(frame, lambda ids: ids % 50 == 0, "vec_id", "embedding").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = {}
    for q in (i for i in whole if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=False)), i) for i, v in whole.items() if i != q)[:10]
        want[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert {q: sorted(r) for q, r in got.items()} == want
    assert topk.top_k(frame.where("vec_id in (0, 5, 7)"), lambda ids: ids % 50 == 0, "vec_id", "embedding").count() == 2
    assert topk.top_k(frame.where("false"), lambda ids: ids % 50 == 0, "vec_id", "embedding").count() == 0


# --- exact dedup ---


@pytest.mark.parametrize("hash_of", [exact_dedup.md5_of, lambda t: F.lit(b"same")])
def test_exact_dedup(docs, none, hash_of):
    """The second hash puts all texts into one group."""
    for keep, best in (("min", min), ("max", max)):
        groups = defaultdict(list)
        for i, t, *_ in ROWS:
            groups[t or ""].append(i)
        stays = {t: best((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
        want = Counter((i, stays[t or ""], len(groups[t or ""]), i == stays[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in ROWS)
        assert Counter(map(tuple, exact_dedup.marked(docs, keep=keep, hash_of=hash_of).collect())) == want
        kept = exact_dedup.deduplicated(docs, keep=keep, hash_of=hash_of)
        assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(i for (i, _, _, k, _), n in want.items() for _ in range(n) if k)
    assert exact_dedup.marked(none).count() == 0 and exact_dedup.deduplicated(none).count() == 0


# --- WARC ---


def test_archives_go_round(spark, tmp_path):
    body = "<p>" + "WARC/1.1\r\n\r\nfiledesc://x é " * 100
    rows = [(1, "http://a b/c", body, 0), (2, None, body, 0), (2, None, body, 0), (3, "u", None, 0), (4, "u", "", 0), (5, "u", "short", 0), (6, "u", "short", 0), (None, "http://x", body, 0), (7, "", "y" * 50_000, 0), (8, "u", "y" * 50_000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int").repartition(2)
    warc.write_arc(pages, f"{tmp_path}/arc")
    arc = warc.read_arc(spark, f"{tmp_path}/arc").persist()
    assert Counter(r.payload.decode() for r in arc.collect()) == Counter(h or "" for _, _, h, _ in rows)
    warc.write_warc(warc.to_warc(arc), f"{tmp_path}/warc")
    got = warc.resolved(warc.read_warc(spark, f"{tmp_path}/warc")).collect()
    top = {body: 2, "y" * 50_000: 8}
    want = Counter((i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if (h in top and i != top[h]) else "response", top[h] if h in top and i != top[h] else None) for i, _, h, _ in rows)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want and all(r.digest_ok for r in got)
    warc.write_arc(pages.where("false"), f"{tmp_path}/empty")
    assert warc.read_arc(spark, f"{tmp_path}/empty").count() == 0


def test_both_versions_of_header_lines():
    head = "HTTP/1.1 200 OK\r\n\r\nhi\n"
    for version, line in ((1, f"http://a 1.2.3.4 20010203040506 text/html {len(head)}"), (2, f"http://a 1.2.3.4 20010203040506 text/html 200 - - 77 f.arc {len(head)}")):
        block = f"{version} 0 org\n{warc.ARC_FIELDS[version]}\n"
        start = f"filedesc://f.arc 0.0.0.0 20010203040506 text/plain {len(block)}" if version == 1 else f"filedesc://f.arc 0.0.0.0 20010203040506 text/plain 200 - - 0 f.arc {len(block)}"
        data = f"{start}\n{block}\n{line}\n{head}\n".encode()
        ((at, v, fields, body),) = warc._arc_records(data)
        assert v == version and fields["Archive-date"] == "20010203040506" and body == head.encode() and at == len(f"{start}\n{block}\n")
        with pytest.raises(ValueError):
            list(warc._arc_records(data[:-8]))


# --- language models ---


def test_ctw_keys_are_tallied_and_looked_up():
    rng = np.random.default_rng(3)
    keys, learn = rng.integers(0, 50, 4000).astype(np.uint64) << np.uint64(58), rng.random(4000) < 0.9
    learn[keys == keys[0]] = False  # asked for, never learned
    for flags in (learn, np.ones(4000, bool), np.zeros(4000, bool)):
        for got, want in zip(ctw.tallied(keys, flags), ctw.folded(keys, flags.astype(np.int64)), strict=True):
            assert (got == want).all()
    assert [len(x) for x in ctw.tallied(keys[:0], learn[:0])] == [0, 0]
    known = ctw.looked_up(keys, keys.astype(float))  # as from many pieces of a block
    assert len(known[0]) == len(set(keys.tolist())) and (ctw.values_of(known, keys) == keys).all()
    with pytest.raises(ValueError, match="misses answers"):
        ctw.values_of(known, np.array([7], np.uint64))


def brute_ctw(pairs, depth):
    """Weighted block probability and prediction by the recursive definition. pairs: training (context bytes, byte)."""

    def kt(n0, n1):
        p, a, b = 1.0, 0.5, 0.5
        for k in range(n0 + n1):
            if k < n0:
                p, a = p * a / (a + b), a + 1
            else:
                p, b = p * b / (a + b), b + 1
        return p

    def decisions(byte):
        return [((1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1) for k in range(8)]

    counts = defaultdict(lambda: [0, 0])
    contexts = defaultdict(set)
    for context, byte in pairs:
        for node, bit in decisions(byte):
            for d in range(depth + 1):
                counts[context[len(context) - d :], node][bit] += 1
                if d < depth:
                    contexts[context[len(context) - d :], node].add(context[len(context) - d - 1 :])

    def weighted(suffix, node):
        own = kt(*counts[suffix, node]) if (suffix, node) in counts else 1.0
        if len(suffix) == depth:
            return own, own, None
        below = math.prod(weighted(c, node)[0] for c in contexts.get((suffix, node), ()))
        return 0.5 * own + 0.5 * below, own, below

    def predict(context, byte):
        total = 0.0
        for node, bit in decisions(byte):
            p = None
            for d in range(depth, -1, -1):
                suffix = context[len(context) - d :]
                n = counts[suffix, node] if (suffix, node) in counts else [0, 0]
                own = (n[bit] + 0.5) / (sum(n) + 1)
                if p is None or not seen:
                    p = own
                else:
                    _, mine, below = weighted(suffix, node)
                    p = (mine * own + below * p) / (mine + below)
                seen = sum(n) > 0
            total += math.log10(p)
        return total

    return predict


def test_context_trees_match_the_recursive_definition():
    rng = random.Random(8)
    text = bytes(rng.choice(b"abAB") for _ in range(70))
    pairs = [(text[i - 2 : i], text[i]) for i in range(2, 60)]
    asked = sorted({(text[i - 2 : i], text[i]) for i in range(2, 70)} | {(b"zz", 97), (b"az", 200)})
    predict = brute_ctw(pairs, 2)

    def key(context, byte):
        return int.from_bytes(context + bytes([byte]), "big")

    keys = np.array([key(*a) for a in asked], np.uint64)
    order = np.argsort(keys)
    trained = Counter(key(*p) for p in pairs)
    got = ctw.whole_model(keys[order], np.array([trained[int(k)] for k in keys[order]]), 2)
    assert np.allclose(got, np.array([predict(*asked[i]) for i in order]), atol=1e-9)
    every = np.array([key(b"ab", b) for b in range(256)] + [k for k in trained if k >> 8 != key(b"ab", 0) >> 8], np.uint64)
    every.sort()
    p = ctw.whole_model(every, np.array([trained[int(k)] for k in every]), 2)
    assert math.isclose((10 ** p[(every >> np.uint64(8)) == np.uint64(key(b"ab", 0) >> 8)]).sum(), 1.0, rel_tol=1e-9)


def test_scores_of_awkward_rows(docs, none):
    rows = ctw.scored(docs, F.col("doc_id") % 3 != 0).collect()
    train = [t for i, t, *_ in ROWS if i is None or i % 3]
    count = Counter(w for t in train for w in byte_words(t))
    total, distinct = sum(count.values()) + len(train), len(count) + 1

    def base(t):
        parts = [count[w] for w in byte_words(t)] + [len(train)]
        return sum(math.log10((c + 0.1) / (total + 0.1 * (distinct + 1))) for c in parts)

    want = sorted((str(i), len(byte_words(t)) + 1, sum(count[w] > 0 for w in byte_words(t)) + 1, total, round(base(t), 6)) for i, t, *_ in ROWS)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert ctw.scored(none, F.lit(True)).count() == 0
    assert all(r.n_known == 0 for r in ctw.scored(docs, F.lit(False)).collect())


def test_spark_scores_equal_the_model_in_one_piece(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in ctw.op10_ctw(spark, sf).collect()}
    found = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    ids, texts = [r.doc_id for r in found], pa.array([r.text for r in found])
    ((_, data, offsets),) = text_slices(texts, 1 << 30)
    keys, begin = ctw.context_keys(data, offsets, *words(data, offsets)[1:], ctw.DEPTH)
    learn = np.repeat([not rows[i].held_out for i in ids], np.diff(begin)).astype(np.int64)
    known, counts = ctw.folded(keys, learn)
    score = np.add.reduceat(ctw.whole_model(known, counts, ctw.DEPTH)[np.searchsorted(known, keys)], begin[:-1])
    assert np.allclose([rows[i].score for i in ids], score, rtol=2e-5)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > 1.6 * sum(r.base_score for r in held)


# --- pages ---

PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/x">News</a></li></ul></nav>
<div class="ad">Buy two of these now.</div><article><h1>The&nbsp;title of it</h1><p><b>First words &amp; more of them.<br>
 They go on.<p>Second   paragraph is here, too.</p></article><footer>&copy; all of us</footer></body></html>"""


def test_blocks_are_cut_at_block_tags():
    got = html_text.blocks(PAGE)
    assert [b[1] for b in got] == ["Home", "News", "Buy two of these now.", "The title of it", "First words & more of them. They go on.", "Second paragraph is here, too.", "© all of us"]
    assert [html_text.label(b[0]) for b in got] == [0, 0, 0, 1, 1, 1, 0] and got[0][2] == 1
    for odd in ("", "<", "<p", "a<b>c", "<!-- x", "<script>x", "</p></p>x", "<p title='a>b'>c</p>", "&#65;&bogus;", "<ul><li>a<li>b</ul>c"):
        html_text.blocks(odd)
    assert [b[1] for b in html_text.blocks("<ul><li>a<li>b</ul>c")] == ["a", "b", "c"]
    assert html_text.blocks("<p title='a>b'>c")[0][1] == "c"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>Before.</p><img alt='Bob's photo'><p>After one.</p><p>After two.</p>", ["Before.", "After one.", "After two."]),
        ('<p>See <a href="x"">link</a> here.</p><p>Next.</p>', ["See link here.", "Next."]),
        ('<p title="never closed>One.</p><p>Two.</p>', ["One.", "Two."]),
        ("<p>One.</p><p title = 'a>b' data-x=it's>Two.</p><p \">Three.</p>", ["One.", "Two.", "Three."]),
        ("<p =\">One.</p><p a=\"1\"b='2>1'/>Two.</p><p a=>Three.</p>", ["One.", "Two.", "Three."]),
        ("<p>One.</p><script src='a'b'>x > 1</script><p>Two.</p><style media=\"a\"\">p > b {}</style><p>Three.</p>", ["One.", "Two.", "Three."]),
        ("<p>One.</p><select-box>Two.</select-box><p>Three.</p><p title='cut off", ["One.", "Two.", "Three."]),
    ],
)
def test_stray_quotes_drop_no_text(html, want):
    assert [b[1] for b in html_text.blocks(html)] == want


def test_all_words_of_a_block_count():
    half = html_text.features([((), "one " * 64 + "two " * 64, 0.0)])[0, html_text.PATH : html_text.PATH + html_text.WORDS]
    want = np.zeros(html_text.WORDS)
    for w in ("one", "two"):
        want[html_text._bucket(w, html_text.WORDS)] += 0.5
    assert np.allclose(half, want)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    model = html_text.Labeller()
    x, mask = rng.random((4, 3, html_text.INPUT)), np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0]], bool)
    y = (rng.random((4, 3)) > 0.5).astype(float)

    def loss():
        p = model.outputs(x, mask)[0]
        return -np.where(mask, y * np.log(p) + (1 - y) * np.log(1 - p), 0).sum() / mask.sum()

    g = model.gradients(x, y, mask)
    for name, w in model.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in w.shape)
            w[at] += 1e-5
            up = loss()
            w[at] -= 2e-5
            down = loss()
            w[at] += 1e-5
            assert math.isclose((up - down) / 2e-5, g[name][at], rel_tol=1e-3, abs_tol=1e-7)


def test_main_text_of_pages(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.page_id: r for r in html_text.op4_html_text(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    wrong = 0
    for p in pages:
        want = "\n\n".join(b[1] for b in html_text.blocks(p.html) if html_text.label(b[0]) == 1)
        wrong += rows[p.page_id].text != want
        assert rows[p.page_id].n_chars == len(rows[p.page_id].text)
    assert len(rows) == len(pages) and wrong <= 0.02 * len(pages)
    odd = [(1, "u", None, "x"), (2, None, "", "x"), (2, None, "", "x"), (None, "u", "plain words of a text.", "x"), (3, "u", "<p>" + "long text goes on. " * 50_000, "x"), (4, "u", "<p>a</p>" * 3000, "x")]
    frame = spark.createDataFrame(odd, "page_id long, url string, html string, text string")
    got = html_text.extracted(frame).collect()
    assert len(got) == len(odd) and all(r.text == "" and r.n_chars == 0 for r in got if r.page_id in (1, 2))
    assert html_text.extracted(frame.where("false")).count() == 0
