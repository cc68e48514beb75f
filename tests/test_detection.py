"""The recognizers against a brute-force reading of the same patterns in Python's own regex engine."""

import random
import re

import pytest

from pyspark.sql import functions as F

from sievemask.functions import recognizers as R
from sievemask.functions import spans as S
from sievemask.operators import detection as D


def labels(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    return [(s["label"], s["value"]) for s in D.with_spans(df).first()["spans"]]


def test_known_texts(spark):
    cases = {
        "Aadhaar 2345 6789 0124 ok": [("AADHAAR", "2345 6789 0124")], "Aadhaar 2345 6789 0125 ok": [], "card 4111-1111-1111-1111": [("CARD", "4111-1111-1111-1111")],
        "GSTIN 27AAPFU0939F1ZV.": [("GSTIN", "27AAPFU0939F1ZV")], "mail rahul.s@gmail.com": [("EMAIL", "rahul.s@gmail.com")], "pay rahul.s@okaxis now": [("UPI", "rahul.s@okaxis")],
        "pay rahul.s@okaxis.": [("UPI", "rahul.s@okaxis")], "call +91 98765 43210.": [("PHONE", "+91 98765 43210")], "+1 (771) 555-1655 and 10.0.0.1": [], "code ABCD0EFGHIJ": [("IFSC", "ABCD0EFGHIJ")],
        "": [], "x￿ QWKPD4821F": [("PAN", "QWKPD4821F")],
    }
    for text, want in cases.items():
        assert labels(spark, text) == want, text


def test_offsets_count_code_points(spark):
    text = "😀 मेरा पैन QWKPD4821F है"
    df = spark.createDataFrame([(text,)], "text string")
    [s] = D.with_spans(df).first()["spans"]
    assert text[s["start"] : s["end"]] == "QWKPD4821F"


# What the EMAIL pattern stands for, as the other engine can read it.
PLAIN_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"


def _python_pattern(pattern):
    pattern = PLAIN_EMAIL if r"\G" in pattern else pattern
    return re.compile(pattern.replace(r"\p{L}\p{N}_", r"\w").replace(r"\p{Nd}", r"\d"))


def _verhoeff(d):
    from sievemask.functions.checkdigits import VERHOEFF_D, VERHOEFF_P

    c = 0
    for i, x in enumerate(reversed(d)):
        c = VERHOEFF_D[c][VERHOEFF_P[i % 8][int(x)]]
    return bool(d) and c == 0


def _luhn(d):
    doubled = sum(sum(divmod(2 * int(x), 10)) if i % 2 else int(x) for i, x in enumerate(reversed(d)))
    return bool(d) and doubled % 10 == 0


def _gstin(s):
    chars = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    g = s.upper()
    if any(c not in chars for c in g):
        return False
    total = sum(sum(divmod(chars.index(c) * (1 + i % 2), 36)) for i, c in enumerate(g[:14]))
    return g[14] == chars[-total % 36]


def brute_force(text):
    only = lambda s: "".join(c for c in s if c in "0123456789")
    checks = {"AADHAAR_VID": lambda s: _verhoeff(only(s)), "CARD": lambda s: _luhn(only(s)), "AADHAAR": lambda s: _verhoeff(only(s)), "GSTIN": _gstin}
    found = []
    for rank, (label, pattern) in enumerate(R.PATTERNS.items()):
        for m in _python_pattern(pattern).finditer(text):
            if checks.get(label, lambda _: True)(m.group()):
                found.append((m.start() - m.end(), m.start(), rank, m.end(), label))
    kept = []
    for _, start, _, end, label in sorted(found):
        if all(end <= s or e <= start for s, e, _ in kept):
            kept.append((start, end, label))
    return sorted(kept)


def test_random_texts_match_brute_force(spark):
    rng = random.Random(11)
    atoms = ["2345 6789 0124", "4111111111111111", "QWKPD4821F", "27AAPFU0939F1ZV", "a.b@c.co", "x.y@ybl", "9876543210", "+91-98765 43210", "MH12AB1234", "J8369854",
             "ABC1234567", "SBIN0123456", "@", ".", " ", "-", "0", "6", "91", "A", "z", "😀", "पै", "१", "_", "+", "\n", "12", "1234", "99999"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(8)
    got = {r["i"]: [(s["start"], s["end"], s["label"]) for s in r["spans"]] for r in D.with_spans(df).select("i", "spans").collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_force(t), t


def test_guard_never_hides_a_hit(spark):
    rng = random.Random(3)
    atoms = ["ABCD0EFGHIJ", "x.y@ybl", "9876543210", "word ", "12 ", "MH 12 A 1234", "J8369854"]
    rows = [("".join(rng.choice(atoms) for _ in range(3)),) for _ in range(300)]
    df = spark.createDataFrame(rows, "text string")
    assert D.with_spans(df).where(F.size("spans") > 0).where(~R.may_hold(F.col("text"))).count() == 0


def test_splice(spark):
    df = spark.createDataFrame([("ab😀cd", [(0, 1, "X"), (2, 3, "YY"), (4, 5, "")])], "t string, r array<struct<start:int,end:int,replacement:string>>")
    assert df.select(S.splice(F.col("t"), F.col("r")).alias("o")).first()["o"] == "XbYYc"


def test_failing_detector_only_fails_its_row(spark):
    def detector(text):
        if text == "bad":
            raise RuntimeError("boom")
        return [{"start": 0, "end": 2, "label": "ORG"}]

    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "fine")], "id int, text string")
    rows = {r["id"]: r for r in D.detect_with(df, "id", detector).collect()}
    assert rows[2]["status"] == "failed" and rows[2]["message"] == "RuntimeError: boom"
    assert rows[1]["status"] == rows[3]["status"] == "detected" and rows[1]["entities"][0]["label"] == "ORG"


def test_labels_are_mapped_once(spark):
    records = D.detect_with(
        spark.createDataFrame([(1, "ab"), (2, "")], "id int, text string"), "id",
        lambda t: [{"start": i, "end": i + 1, "label": c} for i, c in enumerate(t)],
    )
    entity_map = spark.createDataFrame([("a", "PAN"), ("z", "PHONE")], "label string, entity string")
    got = {r["id"]: [tuple(p) for p in r["predicted"]] for r in D.mapped_records(records, entity_map, "id").collect()}
    assert got == {1: [(0, 1, "PAN", None), (1, 2, None, "b")], 2: []}
    twice = entity_map.unionByName(spark.createDataFrame([("a", "GSTIN")], "label string, entity string"))
    with pytest.raises(Exception, match="lists a label twice: a"):
        D.mapped_records(records, twice, "id").collect()


def test_streamed_detection_reads_a_folder_of_files(spark, tmp_path):
    """A table of several part files beside other tables, as Spark writes it."""
    from sievemask.plans.detection import streamed_detection

    rows = [(i, "en", f"mail a{i}@example.org") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(5).write.parquet(str(tmp_path / "labels.parquet"))
    assert [tuple(r) for r in streamed_detection(spark, str(tmp_path)).collect()] == [("en", "EMAIL", 40)]
