"""Check digits, validators, text and JSON helpers on known values."""

import json
import random

from pyspark.sql import functions as F

from sievemask.functions import checkdigits as C
from sievemask.functions import identifiers as I
from sievemask.functions import jsontext as J
from sievemask.functions import metrics as M
from sievemask.functions import placeholders as P
from sievemask.functions import text as X


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_check_digits(spark):
    lit = F.lit
    got = spark.range(1).select(
        C.verhoeff_check_digit(lit("236")), C.verhoeff_is_valid(lit("2363")), C.verhoeff_is_valid(lit("2364")), C.verhoeff_is_valid(lit("3263")),
        C.verhoeff_is_valid(lit("")), C.luhn_is_valid(lit("4111111111111111")), C.luhn_is_valid(lit("4111111111111112")), C.luhn_check_digit(lit("7992739871")),
        C.luhn_check_digit(lit("411111111111111")), C.luhn_is_valid(lit("")), C.gstin_check_char(lit("27AAPFU0939F1Z")), C.gstin_check_char(lit("27aapfu0939f1z")),
    ).first()
    assert list(got) == [3, True, False, False, False, True, False, 3, 1, False, "V", None]


def test_ascii_digits(spark):
    assert value(spark, X.ascii_digits(F.lit("120"))) == [1, 2, 0]
    assert value(spark, X.ascii_digits(F.lit(""))) == []
    assert value(spark, X.ascii_digits(F.lit("12a"))) is None
    assert value(spark, X.ascii_digits(F.lit("१२"))) is None


def test_validators_on_edge_cases(spark):
    rows = [
        ("GSTIN", "27AAPFU0939F1ZV", True), ("GSTIN", "27AAPFU0939F1ZW", False), ("GSTIN", "99AAPFU0939F1ZV", False), ("PAN", "ABCPक1234A", False),
        ("PAN", "abcps1234k", True), ("PASSPORT", "Q1234567", False), ("PASSPORT", "J8369854", True), ("PHONE", "2234567890", False), ("PHONE", "+91 98765-43210", True),
        ("PHONE", "09876543210", True), ("UPI_ID", "rahul@gmail.com", False), ("UPI_ID", "rahul.s@okaxis", True), ("AADHAAR", "2345 6789 0124", True),
        ("AADHAAR", "2345 6789 0125", False), ("EMAIL", "a@b.co", True), ("EMAIL", "a@b..co", True), ("EMAIL", "a b@c.in", False), ("EMAIL", "é@x.in", True), ("EMAIL", "root@localhost", False),
        ("EMAIL", "a@.in", False), ("VEHICLE_REGISTRATION", "MH 12 AB 1234", True), ("VEHICLE_REGISTRATION", "MH12ABC1234", False), ("VOTER_ID", "ABC1234567", True),
        ("IFSC", "sbin0a1b2c3", True), ("PAYMENT_CARD", "4111-1111-1111-1111", True), ("PAYMENT_CARD", "41111111", False), ("PERSON_NAME", "anything", None), ("ADDRESS", "x", None),
    ]
    df = spark.createDataFrame(rows, "entity string, text string, want boolean")
    wrong = df.withColumn("got", I.is_valid(F.col("entity"), F.col("text"))).where("not (got <=> want)").collect()
    assert wrong == []


def test_code_point_offsets_match_utf16_slicing(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(60):
        text = "".join(rng.choice("ab😀é🎉पै") for _ in range(rng.randint(0, 12)))
        for i in range(len(text) + 1):
            rows.append((text, len(text[:i].encode("utf-16-le")) // 2, i))
    df = spark.createDataFrame(rows, "t string, units int, want int")
    assert df.where(X.code_point_offset(F.col("t"), F.col("units")) != F.col("want")).count() == 0


def test_display_matches_exact_rounding(spark):
    rng = random.Random(1)
    values = [0.0, 0.05, 0.25, 0.35, 0.125, 0.375, 99.95, 1 / 3, 2.675, 100.0, 0.15, 0.45] + [rng.randint(0, 2000) / 20 for _ in range(500)] + [rng.random() * 100 for _ in range(500)]
    df = spark.createDataFrame([(v, f"{v:.1f}", f"{v:.2f}") for v in values], "v double, one string, two string")
    got = df.select("v", M._fixed(F.col("v"), 1).alias("a"), M._fixed(F.col("v"), 2).alias("b"), "one", "two")
    assert got.where("a <> one or b <> two").collect() == []
    assert value(spark, M.percent(F.lit(None).cast("double"))) == "–"


def test_rates(spark):
    tp, fp, fn = F.lit(6), F.lit(2), F.lit(4)
    assert value(spark, F.struct(M.precision(tp, fp), M.recall(tp, fn), M.f1(tp, fp, fn))) == (0.75, 0.6, 12 / 18)
    zero = F.lit(0)
    assert value(spark, F.struct(M.precision(zero, zero), M.recall(zero, zero), M.f1(zero, zero, zero))) == (None, None, None)


def test_placeholder_anatomy_and_mangles(spark):
    m = lambda p, how: value(spark, P.mangled(F.lit(p), F.lit(how)))
    assert m("<PERSON_1>", "lowercase") == "<person_1>"
    assert m("[[pan_2]]", "uppercase") == "[[PAN_2]]"
    assert m("<<PERSON_1>>", "strip_delimiters") == "PERSON_1"
    assert m("<PERSON_1>", "space_padded") == "< PERSON_1 >"
    assert m("PERSON_1", "space_padded") == " PERSON_1 "
    assert value(spark, P.fragments(F.lit("[PAN_1]"))) == ["[pan_1]", "pan_1", "[pan", "n_1]"]
    assert value(spark, P.fragments(F.lit("***"))) == []


def test_json_parses_like_a_strict_parser(spark):
    texts = ["1", "1 x", '{"a":1} x', '{"a":1}', "[1,2]", '"s"', "", '{"a":1', "null", '{"a":1},"b":2', '1,"q":3', ' {"a" : 1} ', "tru", "-", "{]", '1,"z":5', '{"v":1,"z":2}', "[]"]

    def ok(t):
        try:
            json.loads(t)
            return True
        except ValueError:
            return False

    df = spark.createDataFrame([(t, ok(t)) for t in texts], "t string, want boolean")
    assert df.where(J.parses(F.col("t")) != F.col("want")).collect() == []


def test_json_equality_and_strings(spark):
    rows = [
        ('{"a":1,"b":[1,2]}', '{"b":[1,2], "a":1.0}', True), ('{"a":1}', '{"a":2}', False), ("x", "x", True), ("x ", "x", False),
        ('{"a":100}', '{"a":1e2}', True), ('{"a":"1"}', '{"a":1}', False), ('{"a":"1.0"}', '{"a":"1"}', False),
    ]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert df.where(J.same_json(F.col("a"), F.col("b")) != F.col("want")).collect() == []
    body = json.dumps({"role": "user", "content": [{"text": 'a"b: c', "n": 1}, "x"], "k": "yé"})
    assert value(spark, J.string_values(F.lit(body))) == ["user", 'a"b: c', "x", "yé"]
    assert value(spark, J.string_values(F.lit('"just"'))) == ["just"]


def test_long_strings_cost_no_stack(spark):
    from sievemask.functions import jsontext as J

    texts = ["x" * 1_000_000, '"' * 100_000, "\\" * 50_001, "\n" * 1000]
    import json

    df = spark.createDataFrame([(json.dumps({"k": [t, 1.0]}), json.dumps({"k": [t, 1]}, indent=1), t) for t in texts], "a string, b string, t string")
    for r in df.select(J.string_values(F.col("a")).alias("v"), J.same_json(F.col("a"), F.col("b")).alias("same"), "t").collect():
        assert r["v"] == [r["t"]] and r["same"]


def test_addresses_match_the_plain_pattern(spark):
    import random
    import re

    from sievemask.functions.recognizers import PATTERNS, detect
    from sievemask.functions.spans import pattern_spans

    plain = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
    ours = PATTERNS["EMAIL"]
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab1.@-_..@cde ") for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", pattern_spans(F.col("t"), ours).alias("s")).collect():
        assert [tuple(x) for x in r["s"]] == [(m.start(), m.end(), m.group()) for m in plain.finditer(r["t"])]
    long = spark.createDataFrame([("a@" + "x." * 100_000 + "com tail",), ("a@" + "x." * 100_000,)], "t string")
    assert [[x["end"] for x in r["s"]] for r in long.select(pattern_spans(F.col("t"), ours).alias("s")).collect()] == [[200_005], []]
    many = spark.createDataFrame([("a@bc.de " * 100_000,)], "t string")
    assert many.select(F.size(detect(F.col("t"))).alias("n")).first()["n"] == 100_000


def test_running_totals_over_strides(spark):
    from sievemask.functions.spans import running

    for n in (0, 1, 63, 64, 65, 200, 1000):
        df = spark.createDataFrame([([i % 7 for i in range(n)],)], "v array<int>")
        got = df.select(running(F.col("v"), lambda x, y: x + y, F.lit(0)).alias("s")).first()["s"]
        assert got == [sum(i % 7 for i in range(k + 1)) for k in range(n)]
