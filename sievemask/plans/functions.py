"""Queries for the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievemask.corpus.draws import digits, letters
from sievemask.functions import checkdigits as C
from sievemask.functions import identifiers as I
from sievemask.functions import jsontext as J
from sievemask.functions import metrics as M
from sievemask.functions import placeholders as P
from sievemask.functions import text as X
from sievemask.plans.common import (
    big, digest_of, q_digits, q_gstin_index, q_letters, q_list, q_luhn_digit, q_luhn_sum, q_verhoeff_digit,
    q_verhoeff_state, spread, table,
)



def _key():
    return F.concat(F.lit("ids/"), F.col("o_orderkey").cast("string"))


Q_KEY = "'ids/' || o_orderkey"


def grouping_and_digits(spark, sf):
    s = F.concat(digits(_key(), "a", 8), digits(_key(), "b", 8))
    sep = F.element_at(F.array(F.lit(""), F.lit(" "), F.lit("-")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, sf, "orders").select(
        "o_orderkey", s.alias("s"), X.group_by_four(s, sep).alias("grouped")
    ).select(
        "o_orderkey", "grouped", X.ungrouped(F.col("grouped")).alias("plain"),
        big(F.aggregate(X.ascii_digits(F.col("s")), F.lit(0), lambda a, d: a + d)).alias("digit_sum"),
        X.ascii_digits(F.concat("s", F.lit("x"))).isNull().alias("rejects_letters"),
        big(F.size(X.ascii_digits(F.substring("s", 1, 0)))).alias("empty_size"),
    )


Q_GROUPING = f"""
WITH t AS (SELECT o_orderkey, {q_digits(Q_KEY, 'a', 8)} || {q_digits(Q_KEY, 'b', 8)} AS s,
  (['', ' ', '-'])[(o_orderkey % 3 + 1)::INT] AS sep FROM orders)
SELECT o_orderkey, substr(s,1,4)||sep||substr(s,5,4)||sep||substr(s,9,4)||sep||substr(s,13,4) AS grouped, s AS plain,
  list_sum(list_transform(range(16), lambda i: substr(s, (i+1)::INT, 1)::INT))::BIGINT AS digit_sum,
  true AS rejects_letters, 0::BIGINT AS empty_size FROM t"""


def verhoeff_digits(spark, sf):
    d11, d12 = digits(_key(), "v", 11), F.concat(digits(_key(), "v", 11), digits(_key(), "w", 1))
    return table(spark, sf, "orders").select(
        "o_orderkey", big(C.verhoeff_check_digit(d11)).alias("check_digit"), C.verhoeff_is_valid(d12).alias("valid"),
        C.verhoeff_is_valid(F.concat(d11, C.verhoeff_check_digit(d11).cast("string"))).alias("closes"),
    )


Q_D12 = f"({q_digits(Q_KEY, 'v', 11)} || {q_digits(Q_KEY, 'w', 1)})"
Q_VERHOEFF = f"""
SELECT o_orderkey, ({q_verhoeff_digit(q_digits(Q_KEY, 'v', 11))})::BIGINT AS check_digit,
  {q_verhoeff_state(Q_D12, 0)} = 0 AS valid, true AS closes FROM orders"""


def luhn_digits(spark, sf):
    d = F.concat(digits(_key(), "l", 10), digits(_key(), "m", 5))
    whole = F.concat(d, digits(_key(), "n", 1))
    return table(spark, sf, "orders").select(
        "o_orderkey", big(C.luhn_check_digit(d)).alias("check_digit"), C.luhn_is_valid(whole).alias("valid")
    )


Q_D15 = f"({q_digits(Q_KEY, 'l', 10)} || {q_digits(Q_KEY, 'm', 5)})"
Q_LUHN = f"""
SELECT o_orderkey, ({q_luhn_digit(Q_D15)})::BIGINT AS check_digit,
  {q_luhn_sum(f"({Q_D15} || {q_digits(Q_KEY, 'n', 1)})", 0)} % 10 = 0 AS valid FROM orders"""


def gstin_chars(spark, sf):
    body = F.concat(digits(_key(), "s", 2), letters(_key(), "p", 5), digits(_key(), "q", 4), letters(_key(), "r", 1), F.lit("1Z"))
    return table(spark, sf, "orders").select(
        "o_orderkey", C.gstin_check_char(body).alias("check_char"),
        C.gstin_check_char(F.lower(body)).isNull().alias("rejects_lower_case"),
    )


Q_BODY = f"({q_digits(Q_KEY, 's', 2)} || {q_letters(Q_KEY, 'p', 5)} || {q_digits(Q_KEY, 'q', 4)} || {q_letters(Q_KEY, 'r', 1)} || '1Z')"
Q_GSTIN = f"""
WITH t AS (SELECT o_orderkey, {Q_BODY} AS body FROM orders)
SELECT o_orderkey, substr('{C.GSTIN_ALPHABET}', ({q_gstin_index('body')} + 1)::INT, 1) AS check_char,
  true AS rejects_lower_case FROM t"""


def _typed_rows(spark, sf):
    """Orders turned into (entity, text) pairs: every type, right and wrong forms mixed by the order's own digits."""
    d2, d4, d6, d7, d9 = (digits(_key(), f"t{n}", n) for n in (2, 4, 6, 7, 9))
    a1, a3, a4, a5 = (letters(_key(), f"u{n}", n) for n in (1, 3, 4, 5))
    sep = F.element_at(F.array(F.lit(""), F.lit(" "), F.lit("-")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    d12 = F.concat(digits(_key(), "v", 11), digits(_key(), "w", 1))
    d16 = F.concat(d12, d4)
    gst = F.concat(d2, a3, F.lit("P"), a1, d4, a1, F.lit("1Z"))
    made = {
        "AADHAAR": F.concat(F.substring(d12, 1, 4), sep, F.substring(d12, 5, 4), sep, F.substring(d12, 9, 4)),
        "AADHAAR_VID": d16,
        "PAN": F.concat(a5, d4, a1),
        "GSTIN": F.concat(gst, F.when(F.col("o_orderkey") % 2 == 0, C.gstin_check_char(gst)).otherwise("0")),
        "IFSC": F.concat(a4, F.substring(d2, 1, 1), d6),
        "UPI_ID": F.concat(F.lower(a5), F.lit("."), d2, F.lit("@"), F.lower(a4), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(".com")),
        "PHONE": F.concat(F.element_at(F.array(F.lit(""), F.lit("+91 "), F.lit("0"), F.lit("91"), F.lit("92")), (F.col("o_orderkey") % 5 + 1).cast("int")), F.substring(d2, 1, 1), d9),
        "EMAIL": F.concat(F.lower(a5), F.lit("@"), F.element_at(F.array(F.lit(""), F.lit(".")), (F.col("o_orderkey") % 2 + 1).cast("int")), F.lower(a4), F.lit(".in")),
        "PAYMENT_CARD": d16,
        "PASSPORT": F.concat(a1, d7),
        "VOTER_ID": F.concat(a3, d7, F.when(F.col("o_orderkey") % 4 == 0, "1").otherwise("")),
        "VEHICLE_REGISTRATION": F.concat(F.substring(a4, 1, 2), sep, d2, sep, F.when(F.col("o_orderkey") % 4 == 0, F.substring(a5, 1, 3)).otherwise(a1), sep, d4),
        "PERSON_NAME": a5,
    }
    pairs = F.array(*[F.struct(F.lit(e).alias("entity"), t.alias("text")) for e, t in made.items()])
    return spread(table(spark, sf, "orders")).select("o_orderkey", F.explode(pairs).alias("p")).select("o_orderkey", "p.*")


def identifier_validity(spark, sf):
    return _typed_rows(spark, sf).select(
        "o_orderkey", "entity", "text", I.is_valid(F.col("entity"), F.col("text")).alias("valid")
    )


_SEP = "(['', ' ', '-'])[(o_orderkey % 3 + 1)::INT]"
Q_TYPED = f"""
WITH b AS (SELECT o_orderkey, {', '.join(f"{q_digits(Q_KEY, f't{n}', n)} AS d{n}" for n in (2, 4, 6, 7, 9))},
  {', '.join(f"{q_letters(Q_KEY, f'u{n}', n)} AS a{n}" for n in (1, 3, 4, 5))}, {_SEP} AS sep, {Q_D12} AS d12 FROM orders),
g AS (SELECT *, d12 || d4 AS d16, d2 || a3 || 'P' || a1 || d4 || a1 || '1Z' AS gst FROM b),
t AS (SELECT o_orderkey, unnest([
  {{'entity': 'AADHAAR', 'text': substr(d12,1,4)||sep||substr(d12,5,4)||sep||substr(d12,9,4)}},
  {{'entity': 'AADHAAR_VID', 'text': d16}},
  {{'entity': 'PAN', 'text': a5||d4||a1}},
  {{'entity': 'GSTIN', 'text': gst || CASE WHEN o_orderkey % 2 = 0 THEN substr('{C.GSTIN_ALPHABET}', ({q_gstin_index('gst')} + 1)::INT, 1) ELSE '0' END}},
  {{'entity': 'IFSC', 'text': a4||substr(d2,1,1)||d6}},
  {{'entity': 'UPI_ID', 'text': lower(a5)||'.'||d2||'@'||lower(a4)||CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '.com' END}},
  {{'entity': 'PHONE', 'text': (['', '+91 ', '0', '91', '92'])[(o_orderkey % 5 + 1)::INT]||substr(d2,1,1)||d9}},
  {{'entity': 'EMAIL', 'text': lower(a5)||'@'||(['', '.'])[(o_orderkey % 2 + 1)::INT]||lower(a4)||'.in'}},
  {{'entity': 'PAYMENT_CARD', 'text': d16}},
  {{'entity': 'PASSPORT', 'text': a1||d7}},
  {{'entity': 'VOTER_ID', 'text': a3||d7||CASE WHEN o_orderkey % 4 = 0 THEN '1' ELSE '' END}},
  {{'entity': 'VEHICLE_REGISTRATION', 'text': substr(a4,1,2)||sep||d2||sep||CASE WHEN o_orderkey % 4 = 0 THEN substr(a5,1,3) ELSE a1 END||sep||d4}},
  {{'entity': 'PERSON_NAME', 'text': a5}}]) AS p FROM g),
u AS (SELECT o_orderkey, p.entity AS entity, p.text AS text, replace(replace(p.text,' ',''),'-','') AS bare FROM t)
SELECT o_orderkey, entity, text, CASE entity
  WHEN 'AADHAAR' THEN bare[1] >= '2' AND {q_verhoeff_state('bare', 0)} = 0
  WHEN 'AADHAAR_VID' THEN {q_verhoeff_state('bare', 0)} = 0
  WHEN 'PAN' THEN contains('PCHFATBLJG', text[4])
  WHEN 'GSTIN' THEN list_contains({q_list(I.GST_STATES)}, substr(text,1,2))
    AND text[15] = substr('{C.GSTIN_ALPHABET}', ({q_gstin_index('text')} + 1)::INT, 1)
  WHEN 'IFSC' THEN text[5] = '0'
  WHEN 'UPI_ID' THEN NOT contains(text, '.com')
  WHEN 'PHONE' THEN (length(bare) = 10 AND bare[1] >= '6')
    OR (starts_with(bare,'+91') AND length(bare) = 13 AND bare[4] >= '6')
    OR (starts_with(bare,'91') AND length(bare) = 12 AND bare[3] >= '6')
    OR (starts_with(bare,'0') AND length(bare) = 11 AND bare[2] >= '6')
  WHEN 'EMAIL' THEN NOT contains(text, '@.')
  WHEN 'PAYMENT_CARD' THEN {q_luhn_sum('bare', 0)} % 10 = 0
  WHEN 'PASSPORT' THEN NOT contains('QXZ', text[1]) AND text[2] <> '0' AND text[8] <> '0'
  WHEN 'VOTER_ID' THEN length(text) = 10
  WHEN 'VEHICLE_REGISTRATION' THEN length(bare) <= 10
  END AS valid FROM u"""


def code_point_offsets(spark, sf):
    text = F.concat(F.lit("😀"), "text", F.lit("🎉x"))
    n = F.length("text")
    return table(spark, sf, "documents").select("doc_id", text.alias("t"), n.alias("n")).select(
        "doc_id", big(X.code_point_offset(F.col("t"), F.lit(0))).alias("first"),
        big(X.code_point_offset(F.col("t"), F.lit(2))).alias("second"),
        big(X.code_point_offset(F.col("t"), F.col("n") + 4)).alias("after_all"),
        big(X.code_point_offset(F.col("t"), F.col("n") + 5)).alias("end"),
    )


Q_OFFSETS = """SELECT doc_id, 0::BIGINT AS first, 1::BIGINT AS second, (length(text) + 2)::BIGINT AS after_all,
  (length(text) + 3)::BIGINT AS "end" FROM documents"""


def rates_and_display(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        big(F.count_if(F.col("l_quantity") > 30)).alias("tp"), big(F.count_if(F.col("l_tax") > 0.05)).alias("fp"),
        big(F.count_if(F.col("l_discount") > 0.07)).alias("fn"), big(F.sum(F.round(F.col("l_extendedprice") * 1000))).alias("ns"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "l_suppkey", "tp", "fp", "fn", M.precision(tp, fp).alias("precision"), M.recall(tp, fn).alias("recall"),
        M.f1(tp, fp, fn).alias("f1"), M.ratio(tp, tp - tp).alias("nothing"), M.percent(M.f1(tp, fp, fn)).alias("f1_pct"),
        M.percent(M.ratio(tp, tp - tp)).alias("nothing_pct"), M.milliseconds(F.col("ns")).alias("ms"),
    )


Q_RATES = """
WITH c AS (SELECT l_suppkey, count(*) FILTER (l_quantity > 30) AS tp, count(*) FILTER (l_tax > 0.05) AS fp,
  count(*) FILTER (l_discount > 0.07) AS fn, sum(round(l_extendedprice * 1000))::BIGINT AS ns FROM lineitem GROUP BY 1)
SELECT l_suppkey, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall,
  CASE WHEN 2*tp + fp + fn > 0 THEN 2 * tp / (2*tp + fp + fn) END AS f1, NULL::DOUBLE AS nothing,
  CASE WHEN 2*tp + fp + fn > 0 THEN printf('%.1f', 2 * tp / (2*tp + fp + fn) * 100) ELSE '–' END AS f1_pct,
  '–' AS nothing_pct, printf('%.2f', ns / 1e6) AS ms FROM c"""


def folded_texts(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", digest_of(X.alnum_folded(F.col("text"))).alias("folded"),
        digest_of(X.excerpt(F.col("text"))).alias("excerpt"), X.has_edge_space(F.col("text")).alias("edge_space"),
        X.is_blank(F.col("text")).alias("blank"),
    )


Q_FOLDED = r"""
SELECT doc_id, md5(lower(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))) AS folded,
  md5(CASE WHEN length(text) <= 600 THEN text ELSE substr(text, 1, 600) || '…' END) AS excerpt,
  regexp_matches(text, '^[\s\p{Z}]|[\s\p{Z}]$') AS edge_space, regexp_full_match(text, '[\s\p{Z}]*') AS blank
FROM documents"""


def placeholder_anatomy(spark, sf):
    n = F.col("o_orderkey").cast("string")
    p = F.element_at(
        F.array(F.concat(F.lit("["), F.lit("Pan_"), n, F.lit("]")), F.concat(F.lit("<<CARD-"), n, F.lit(">>")), F.concat(F.lit("X"), n), F.lit("[--]")),
        (F.col("o_orderkey") % 4 + 1).cast("int"),
    )
    c = F.col("p")
    return table(spark, sf, "orders").select("o_orderkey", p.alias("p")).select(
        "o_orderkey", P.opening(c).alias("opening"), P.inner(c).alias("core"), P.closing(c).alias("closing"),
        *[P.mangled(c, F.lit(m)).alias(m) for m in ("lowercase", "uppercase", "strip_delimiters", "space_padded")],
        F.array_join(P.fragments(c), "|").alias("fragments"),
    )


Q_ANATOMY = """
WITH t AS (SELECT o_orderkey, o_orderkey % 4 AS k, o_orderkey::VARCHAR AS n FROM orders),
u AS (SELECT o_orderkey, k, (['[', '<<', '', '[--]'])[(k+1)::INT] AS opening, (['Pan_'||n, 'CARD-'||n, 'X'||n, ''])[(k+1)::INT] AS core,
  ([']', '>>', '', ''])[(k+1)::INT] AS closing FROM t),
v AS (SELECT *, lower(opening||core||closing) AS low, length(opening||core||closing) AS size FROM u),
w AS (SELECT *, (size + 1) // 2 AS half FROM v)
SELECT o_orderkey, opening, core, closing, low AS lowercase, upper(opening||core||closing) AS uppercase,
  core AS strip_delimiters, opening||' '||core||' '||closing AS space_padded,
  array_to_string(list_filter([low, CASE WHEN lower(core) <> low THEN lower(core) END,
    CASE WHEN substr(low,1,half) NOT IN (low, lower(core)) THEN substr(low,1,half) END,
    CASE WHEN substr(low,size-half+1,half) NOT IN (low, lower(core), substr(low,1,half)) THEN substr(low,size-half+1,half) END],
    lambda f: f IS NOT NULL AND length(f) >= 3 AND regexp_matches(f, '[a-z0-9]')), '|') AS fragments
FROM w"""


def json_texts(spark, sf):
    props, k = F.col("props"), F.col("event_id") % 6
    variant = (
        F.when(k == 0, props).when(k == 1, F.concat(props, F.lit(" x"))).when(k == 2, F.concat(props, props))
        .when(k == 3, F.concat(F.lit("["), props, F.lit(",1.5,null]"))).when(k == 4, F.expr("substring(props, 2)"))
        .otherwise(F.concat(F.lit(' { "z" : "a\\"b" , "a" : '), props, F.lit("}")))
    )
    turned = F.when(k == 5, F.concat(F.lit('{"a":'), props, F.lit(',"z":"a\\u0022b"}'))).when(
        k == 1, variant
    ).otherwise(F.concat(variant, F.lit("\n")))
    return table(spark, sf, "events").select("event_id", variant.alias("v"), turned.alias("w")).select(
        "event_id", J.parses(F.col("v")).alias("parses"), J.same_json(F.col("v"), F.col("w")).alias("same"),
        F.array_join(J.string_values(F.col("v")), "|").alias("strings"),
    )


Q_JSON = """
SELECT event_id, event_id % 6 IN (0, 3, 5) AS parses,
  event_id % 6 IN (0, 1, 3, 5) AS same,
  CASE WHEN event_id % 6 = 5 THEN 'a"b' ELSE '' END AS strings FROM events"""


def document_payloads(spark, sf):
    """Whole documents as message contents: found again among a body's strings, and equal when the body is spaced otherwise."""
    message = F.struct(F.lit("user").alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    body = F.to_json(F.struct(F.array(message).alias("messages")))
    spaced = F.concat(F.lit(" "), F.replace(F.col("body"), F.lit('{"messages":['), F.lit('{ "messages" : [ ')), F.lit("\n"))
    return table(spark, sf, "documents").select("doc_id", body.alias("body")).select(
        "doc_id", digest_of(F.element_at(J.string_values(F.col("body")), -1)).alias("content"), J.same_json(F.col("body"), spaced).alias("same")
    )


Q_PAYLOADS = "SELECT doc_id, md5(text) AS content, true AS same FROM documents"

QUERIES = {
    "document_payloads": (document_payloads, Q_PAYLOADS),
    "grouping_and_digits": (grouping_and_digits, Q_GROUPING),
    "verhoeff_digits": (verhoeff_digits, Q_VERHOEFF),
    "luhn_digits": (luhn_digits, Q_LUHN),
    "gstin_chars": (gstin_chars, Q_GSTIN),
    "identifier_validity": (identifier_validity, Q_TYPED),
    "code_point_offsets": (code_point_offsets, Q_OFFSETS),
    "rates_and_display": (rates_and_display, Q_RATES),
    "folded_texts": (folded_texts, Q_FOLDED),
    "placeholder_anatomy": (placeholder_anatomy, Q_ANATOMY),
    "json_texts": (json_texts, Q_JSON),
}
