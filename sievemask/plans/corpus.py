"""Queries for corpus generation, checking and description; every sample is keyed by a driver row."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievemask.corpus import build as B
from sievemask.corpus import fillers as V
from sievemask.corpus import lexicon as L
from sievemask.corpus import quality as Q
from sievemask.corpus import templates as T
from sievemask.corpus.draws import UPPER, below, between, chance, digest, digits, letters, pick
from sievemask.functions.identifiers import GST_STATES, PAN_HOLDERS, PASSPORT_SERIES
from sievemask.operators import detection as D
from sievemask.operators import scoring as S
from sievemask.plans.common import (
    big, digest_of, q_below, q_between, q_digest, q_digits, q_grouped, q_gstin_index, q_letters, q_list, q_luhn_digit,
    q_number, q_pick, q_verhoeff_digit, q_verhoeff_state, spread, table,
)
from sievemask.session import frozen
from sievemask.sources import samples as SRC

SEED = 42


def _key(prefix, column):
    return F.concat(F.lit(prefix + "/"), F.col(column).cast("string"))


def seeded_draws(spark, sf):
    """The draws everything else is made of."""
    k = _key("draw", "o_orderkey")
    h = digest(k, "c")
    return table(spark, sf, "orders").select(
        "o_orderkey", big(below(k, "a", 10)).alias("below_ten"), big(between(k, "b", 5, 9)).alias("between"),
        pick(k, "p", ("x", "y", "z")).alias("pick"), chance(h, 1, 20).alias("chance"), digits(k, "d", 11).alias("digits"), letters(k, "l", 4).alias("letters"),
    )


_D = "'draw/' || o_orderkey"
Q_DRAWS = f"""SELECT o_orderkey, {q_below(_D, 'a', 10)} AS below_ten, {q_between(_D, 'b', 5, 9)} AS between, {q_pick(_D, 'p', ('x', 'y', 'z'))} AS pick,
  {q_number(q_digest(_D, 'c'), 1, 4)} % 100 < 20 AS chance, {q_digits(_D, 'd', 11)} AS digits, {q_letters(_D, 'l', 4)} AS letters FROM orders"""

# Kinds and styles tried for every order: one row each.
TRIED = (
    ("aadhaar", "spaced"), ("vid", "hyphen"), ("card", "plain"), ("pan", "lower"), ("gstin", "upper"), ("ifsc", "upper"), ("upi", "name"),
    ("upi", "phone"), ("phone", "intl"), ("phone", "split"), ("email", "lower"), ("passport", None), ("voter", None), ("vehicle", "spaced"),
    ("name", "full"), ("name", "deva_first"), ("other_name", "upper"), ("address", "latin"), ("address", "deva"), ("dob", "iso"), ("dob", "month_first"),
    ("dob", "deva"), ("decoy_aadhaar", "plain"), ("decoy_card", "plain"), ("decoy_pan", None), ("decoy_pnr", None), ("decoy_date", "slashed"),
    ("decoy_place", None), ("decoy_passport", None), ("decoy_gstin", None), ("decoy_ifsc", None), ("decoy_handle", None), ("decoy_service_account", None),
)


def filler_values(spark, sf):
    tried = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).cast("string").alias("style")) for k, s in TRIED])
    sample = _key("fill", "c_custkey")
    rows = spread(table(spark, sf, "customer")).withColumn("people", V.people(sample)).select("c_custkey", "people", F.explode(tried).alias("t"))
    value = V.filled(F.col("t.kind"), F.col("t.style"), F.lit("en"), F.col("people"), F.concat(sample, F.lit("/0")))
    return rows.select("c_custkey", "t.kind", "t.style", value.alias("value"))


_S, _P = "('fill/' || c_custkey)", "('fill/' || c_custkey || '/0')"


def _q_person(who, key=_S):
    g, f = q_below(key, f"{who}-given", len(L.GIVEN)), q_below(key, f"{who}-family", len(L.FAMILY))
    return [f"({q_list([r[c] for r in rows])})[{i} + 1]" for rows, i in ((L.GIVEN, g), (L.FAMILY, f)) for c in (0, 1)]


def _q_at(rows, column, name):
    return f"({q_list([r[column] for r in rows])})[{q_below(_P, name, len(rows))} + 1]"


def _q_bare(x):
    return f"regexp_replace(lower({x}), '[^a-z]', '', 'g')"


def _q_date(years, style):
    y, m = q_between(_P, "year", *years), q_between(_P, "month", 1, 12)
    last = f"day(last_day(make_date({y}::BIGINT, {m}::BIGINT, 1::BIGINT)))"
    d = f"({q_number(q_digest(_P, 'day'), 1, 8)} % {last} + 1)"
    dd, mm = f"lpad({d}::VARCHAR, 2, '0')", f"lpad({m}::VARCHAR, 2, '0')"
    month = lambda c: f"({q_list([r[c] for r in L.MONTHS])})[{m}]"
    return {
        "iso": f"{y} || '-' || {mm} || '-' || {dd}", "month_first": f"{month(0)} || ' ' || {d} || ', ' || {y}",
        "deva": f"{d} || ' ' || {month(1)} || ' ' || {y}", "slashed": f"{dd} || '/' || {mm} || '/' || {y}",
    }[style]


def _q_value(kind, style):
    mg, mgd, mf, mfd = _q_person("main")
    og, _, of, _ = _q_person("other")
    sg, _, sfam, _ = _q_person("stranger", _P)
    ten = f"({q_between(_S, 'mobile-head', 6, 9)}::VARCHAR || {q_digits(_S, 'mobile-tail', 9)})"
    city = lambda c: _q_at(L.CITIES, c, "town")
    pin = f"{city(4)} || {q_digits(_P, 'pin', 3)}"
    n = q_between(_P, "n", 1, 250)
    loc, bld, lmk = (lambda c: _q_at(L.LOCALITIES, c, "area")), (lambda c: _q_at(L.BUILDINGS, c, "house")), (lambda c: _q_at(L.LANDMARKS, c, "mark"))

    def address(c, block, plot, shop, facing, pin_word):
        door = (
            f"CASE {q_below(_P, 'door', 4)} WHEN 0 THEN {bld(c)} || ', {block} ' || {q_letters(_P, 'block', 1, 'ABCDEFGH')} || '-' || {n} WHEN 1 THEN '{plot} ' || {n} "
            f"WHEN 2 THEN '{shop} ' || {n} || ' ({facing} ' || {lmk(c)} || ')' ELSE {n} || ' ' || {bld(c)} END"
        )
        region = f"CASE {q_below(_P, 'tail', 2)} WHEN 0 THEN {city(c)} || ' ' || {pin} ELSE {city(c)} || '; ' || {city(c + 2)} || '; {pin_word} ' || {pin} END"
        return f"{door} || ', ' || {loc(c)} || ', ' || {region}"

    def local_part(g, f, forms):
        written = {
            "family.given": f"{f} || '.' || {g}", "given-family": f"{g} || '-' || {f}", "i.family": f"{g}[1] || '.' || {f}",
            "given+year": f"{g} || {q_between(_P, 'year-of-name', 1961, 2004)}", "my+given+digits": f"'my' || {g} || {q_digits(_P, 'tail-of-name', 3)}",
            "family+i+digits": f"{f} || {g}[1] || {q_digits(_P, 'tail-of-name', 2)}",
        }
        ends = [sum(list(forms.values())[: i + 1]) for i in range(len(forms))]
        drawn = q_below(_P, "form-of-name", ends[-1])
        return "CASE " + " ".join(f"WHEN {drawn} < {e} THEN {written[x]}" for x, e in zip(forms, ends)) + " END"

    sub = {"aad": f"({q_between(_P, 'head', 2, 9)}::VARCHAR || {q_digits(_P, 'body', 10)})"}
    wrong = q_between(_P, "wrong", 1, 9)
    panned = lambda holder, initial: f"{q_letters(_P, 'pan-series', 3)} || {holder} || {initial} || {q_digits(_P, 'pan-serial', 4)} || {q_letters(_P, 'pan-last', 1)}"
    # check digits are computed on columns prepared in the CTE `b`
    return {
        ("aadhaar", "spaced"): q_grouped("(aad || aadc)", "' '"),
        ("vid", "hyphen"): q_grouped("(vid || vidc)", "'-'"),
        ("card", "plain"): "crd || crdc",
        ("pan", "lower"): f"lower({panned(chr(39) + 'P' + chr(39), f'upper({mf}[1])')})",
        ("gstin", "upper"): f"gst || substr('0123456789{UPPER}', (gsti + 1)::INT, 1)",
        ("ifsc", "upper"): f"{q_pick(_P, 'bank', L.BANKS)} || '0' || {q_digits(_P, 'branch', 6)}",
        ("upi", "name"): f"{local_part(_q_bare(mg), _q_bare(mf), V.UPI_FORMS)} || '@' || {q_pick(_P, 'handle', L.UPI_HANDLES)}",
        ("upi", "phone"): f"{ten} || '@' || {q_pick(_P, 'handle', L.UPI_HANDLES)}",
        ("phone", "intl"): f"'+91 ' || {ten}[1:5] || ' ' || {ten}[6:10]",
        ("phone", "split"): f"{ten}[1:5] || ' ' || {ten}[6:10]",
        ("email", "lower"): f"{local_part(_q_bare(mg), _q_bare(mf), V.EMAIL_FORMS)} || '@' || {q_pick(_P, 'domain', L.EMAIL_DOMAINS)}",
        ("passport", None): f"{q_pick(_P, 'series', PASSPORT_SERIES)} || {q_between(_P, 'first', 1, 9)} || {q_digits(_P, 'middle', 5)} || {q_between(_P, 'last', 1, 9)}",
        ("voter", None): f"{q_letters(_P, 'series', 3)} || {q_digits(_P, 'serial', 7)}",
        ("vehicle", "spaced"): f"{q_pick(_P, 'state', L.VEHICLE_STATES)} || ' ' || lpad({q_between(_P, 'office', 1, 60)}::VARCHAR, 2, '0') || ' ' || CASE {q_below(_P, 'series-kind', 4)} WHEN 0 THEN {q_letters(_P, 'series', 1)} ELSE {q_letters(_P, 'series', 2)} END || ' ' || {q_digits(_P, 'plate', 4)}",
        ("name", "full"): f"{mg} || ' ' || {mf}", ("name", "deva_first"): mgd, ("other_name", "upper"): f"upper({og} || ' ' || {of})",
        ("address", "latin"): address(0, "Block", "Plot", "Shop", "facing", "PIN"),
        ("address", "deva"): address(1, "ब्लॉक", "भूखंड", "दुकान", "सामने", "पिन"),
        ("dob", "iso"): _q_date(V.DOB_YEARS, "iso"), ("dob", "month_first"): _q_date(V.DOB_YEARS, "month_first"), ("dob", "deva"): _q_date(V.DOB_YEARS, "deva"),
        ("decoy_aadhaar", "plain"): f"aad || ((aadc::INT + {wrong}) % 10)", ("decoy_card", "plain"): f"crd || ((crdc::INT + {wrong}) % 10)",
        ("decoy_pan", None): panned(q_pick(_P, "holder", "".join(c for c in UPPER if c not in PAN_HOLDERS)), q_letters(_P, "initial", 1)),
        ("decoy_pnr", None): f"{q_between(_P, 'head', 2, 8)} || {q_digits(_P, 'body', 9)}", ("decoy_date", "slashed"): _q_date(V.EVENT_YEARS, "slashed"),
        ("decoy_place", None): q_pick(_P, "place", L.NAMED_PLACES),
        ("decoy_passport", None): f"{q_pick(_P, 'series', PASSPORT_SERIES)} || {q_between(_P, 'first', 1, 9)} || {q_digits(_P, 'middle', 5)} || {q_between(_P, 'last', 1, 9)}",
        ("decoy_gstin", None): f"gst || substr('0123456789{UPPER}', ((gsti + {q_between(_P, 'wrong', 1, 35)}) % 36 + 1)::INT, 1)",
        ("decoy_ifsc", None): f"CASE WHEN {q_letters(_P, 'prefix', 4)} IN ({q_list(L.BANKS)[1:-1]}) THEN 'X' || {q_letters(_P, 'prefix', 4)}[2:] ELSE {q_letters(_P, 'prefix', 4)} END || '0' || {q_letters(_P, 'tail', 6, L.BRANCH_CHARS)}",
        ("decoy_handle", None): f"CASE WHEN {q_below(_P, 'handle-kind', 5)} < 2 THEN '@' || {_q_bare(sfam)} || '_' || {_q_bare(sg)} WHEN {q_below(_P, 'handle-kind', 5)} = 2 THEN '@real' || {_q_bare(sg)} || {q_digits(_P, 'handle-tail', 3)} ELSE '@' || {_q_bare(sg)} || '.writes' END",
        ("decoy_service_account", None): q_pick(_P, "account", L.SERVICE_ACCOUNTS),
    }[(kind, style)]


_Q_GBODY = f"({q_pick(_P, 'state', GST_STATES)} || {q_letters(_P, 'pan-series', 3)} || {q_pick(_P, 'holder', 'CFPT')} || {q_letters(_P, 'initial', 1)} || {q_digits(_P, 'pan-serial', 4)} || {q_letters(_P, 'pan-last', 1)} || {q_between(_P, 'entity', 1, 9)} || 'Z')"


def _q_fillers() -> str:
    rows = ", ".join(
        f"{{'kind': '{k}', 'style': {'NULL' if s is None else chr(39) + s + chr(39)}, 'value': {_q_value(k, s)}}}" for k, s in TRIED
    )
    return f"""
WITH a AS (SELECT c_custkey, {q_between(_P, 'head', 2, 9)}::VARCHAR || {q_digits(_P, 'body', 10)} AS aad,
  {q_between(_P, 'head', 1, 9)}::VARCHAR || {q_digits(_P, 'body', 10)} || {q_digits(_P, 'more', 4)} AS vid,
  ({q_pick(_P, 'issuer', L.CARD_PREFIXES)} || {q_digits(_P, 'body', 10)} || {q_digits(_P, 'more', 4)})[1:15] AS crd, {_Q_GBODY} AS gst FROM customer),
b AS (SELECT *, ({q_verhoeff_digit('aad')})::VARCHAR AS aadc, ({q_verhoeff_digit('vid')})::VARCHAR AS vidc, ({q_luhn_digit('crd')})::VARCHAR AS crdc,
  {q_gstin_index('gst')} AS gsti FROM a),
r AS (SELECT c_custkey, unnest([{rows}]) AS t FROM b)
SELECT c_custkey, t.kind AS kind, t.style AS style, t.value AS value FROM r"""


def corpus(spark, sf):
    """A sample per order: its key picks the template and the index."""
    names = [t[0] for t in T.TEMPLATES]
    k = F.col("o_orderkey")
    rows = spread(table(spark, sf, "orders")).select(
        F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names) + 1).cast("int")).alias("template_id"), F.floor(k / len(names)).alias("n")
    )
    return B.rendered(rows, T.builtin(spark), SEED)


def _q_templates() -> str:
    """The template dimension with what each template holds, read off its text."""
    import re

    rows = []
    for i, (name, lang, difficulty, source, _noisy, text) in enumerate(T.TEMPLATES):
        slots = re.findall(r"\{([^{}]+)\}", text.replace("{{", "").replace("}}", ""))
        spans, decoy = [], None
        for s in slots:
            head = s[1:].split(":")[0] if s[0] in "=!" else s.split(":")[0]
            if s[0] == "=" or head in V.FILLERS:
                spans.append(head if s[0] == "=" else V.FILLERS[head][0])
            else:
                decoy = head if s[0] == "!" else V.DECOYS[head][0]
        rows.append(f"({i}, '{name}', '{lang}', '{difficulty}', '{source}', {q_list(spans) if spans else '[]::VARCHAR[]'}, {'NULL' if decoy is None else chr(39) + decoy + chr(39)})")
    return f"t(i, name, lang, difficulty, source, spans, decoy) AS (VALUES {', '.join(rows)}), c AS (SELECT o_orderkey, t.* FROM orders JOIN t ON o_orderkey % {len(T.TEMPLATES)} = i)"


def corpus_stats(spark, sf):
    return Q.stats(corpus(spark, sf)).select("measure", "value", big("n").alias("n"))


def _q_stats() -> str:
    return f"""WITH {_q_templates()}, f AS (SELECT 'samples' AS measure, '' AS value FROM c UNION ALL SELECT 'by_lang', lang FROM c UNION ALL SELECT 'by_difficulty', difficulty FROM c
  UNION ALL SELECT 'by_source', source FROM c UNION ALL SELECT 'positive_samples', '' FROM c WHERE decoy IS NULL UNION ALL SELECT 'hard_negatives', '' FROM c WHERE decoy IS NOT NULL
  UNION ALL SELECT 'hard_negatives_by_decoy', decoy FROM c WHERE decoy IS NOT NULL UNION ALL SELECT 'empty_samples', '' FROM c WHERE decoy IS NULL AND len(spans) = 0
  UNION ALL SELECT 'spans_by_entity', unnest(spans) FROM c) SELECT measure, value, count(*) AS n FROM f GROUP BY 1, 2"""


def corpus_ids(spark, sf):
    """Ids, label kinds, and that every span's text is a valid value of its type."""
    from sievemask.functions.identifiers import is_valid
    from sievemask.functions.text import slice_span

    c = corpus(spark, sf)
    ok = F.forall(F.coalesce("labels.spans", F.array().cast("array<struct<start:int,end:int,entity:string>>")), lambda s: F.coalesce(is_valid(s["entity"], slice_span(F.col("text"), s["start"], s["end"])), F.lit(True)))
    return c.select("id", F.col("labels.kind").alias("kind"), F.col("labels.decoy").alias("decoy"), big(F.coalesce(F.size("labels.spans"), F.lit(0))).alias("spans"), ok.alias("valid"))


def _q_ids() -> str:
    n = len(T.TEMPLATES)
    return f"""WITH {_q_templates()} SELECT name || '-' || CASE WHEN o_orderkey // {n} > 9999 THEN (o_orderkey // {n})::VARCHAR ELSE lpad((o_orderkey // {n})::VARCHAR, 4, '0') END AS id,
  CASE WHEN decoy IS NULL THEN 'positive' ELSE 'hard_negative' END AS kind, decoy, CASE WHEN decoy IS NULL THEN len(spans) ELSE 0 END AS spans, true AS valid FROM c"""


def kyc_texts(spark, sf):
    """Whole rendered texts of one template."""
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(F.lit("en-kyc").alias("template_id"), k.alias("n"))
    c = B.rendered(rows, T.builtin(spark), SEED)
    spans = F.array_join(F.transform("labels.spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), s["entity"])), " ")
    return c.select("id", "text", spans.alias("spans"))


_T = "('42/en-kyc/' || c_custkey)"


def _q_kyc() -> str:
    ten = f"({q_between(_T, 'mobile-head', 6, 9)}::VARCHAR || {q_digits(_T, 'mobile-tail', 9)})"
    p1, p3 = f"({_T} || '/1')", f"({_T} || '/3')"
    family = f"({q_list([r[0] for r in L.FAMILY])})[{q_below(_T, 'main-family', len(L.FAMILY))} + 1]"
    return f"""
WITH a AS (SELECT c_custkey, {q_between(p1, 'head', 2, 9)}::VARCHAR || {q_digits(p1, 'body', 10)} AS aad, {q_pick(p1, 'style', ('', ' ', '-'))} AS sep,
  {q_letters(p3, 'pan-series', 3)} || 'P' || upper({family}[1]) || {q_digits(p3, 'pan-serial', 4)} || {q_letters(p3, 'pan-last', 1)} AS pan, {ten} AS ten FROM customer),
b AS (SELECT *, aad || ({q_verhoeff_digit('aad')})::VARCHAR AS full12 FROM a),
g AS (SELECT *, {q_grouped('full12', 'sep')} AS grouped FROM b),
x AS (SELECT *, 20 + length(grouped) AS e FROM g)
SELECT 'en-kyc-' || lpad(c_custkey::VARCHAR, greatest(4, length(c_custkey::VARCHAR))::INT, '0') AS id,
  'KYC update: Aadhaar ' || grouped || ', PAN ' || pan || ', mobile +91 ' || ten[1:5] || ' ' || ten[6:10] || '.' AS text,
  '20:' || e || ':AADHAAR ' || (e + 6) || ':' || (e + 16) || ':PAN ' || (e + 25) || ':' || (e + 40) || ':PHONE' AS spans FROM x"""


def template_cuts(spark, sf):
    """Templates made from orders, cut into parts."""
    return B.template_parts(_order_templates(spark, sf)).select("template_id", big("pos").alias("pos"), "part_kind", "text", "filler", "style", "entity")


def _order_templates(spark, sf):
    k = F.col("o_orderkey") % 8
    text = (
        F.when(k == 0, F.concat(F.lit("Order {{"), "o_orderpriority", F.lit("}} for {name:full} paid")))
        .when(k == 1, F.concat(F.lit("{=PAN:ABCPS1234K} and {!PHONE:12} "), "o_orderstatus"))
        .when(k == 2, F.concat(F.col("o_orderpriority"), F.lit(" {nonsense}")))
        .when(k == 3, F.lit("{phone:loud}"))
        .when(k == 4, F.concat(F.lit("open { "), "o_orderstatus"))
        .when(k == 5, F.concat(F.lit("shut } "), "o_orderstatus"))
        .when(k == 6, F.lit("{decoy_pnr} {decoy_card:plain}"))
        .otherwise(F.lit("{=PAN: x}{decoy_pan:upper}"))
    )
    return table(spark, sf, "orders").select(
        F.concat(F.lit("o"), F.floor(F.col("o_orderkey") / F.when(F.col("o_orderkey") < 20, 10).otherwise(1)).cast("string")).alias("template_id"), F.lit("en").alias("lang"),
        F.when(F.col("o_custkey") % 50 == 0, "odd").otherwise("easy").alias("difficulty"), F.lit("template").alias("source"), F.lit(False).alias("noisy"), text.alias("text"),
    )


_Q_OT = """
ot AS (SELECT o_orderkey % 8 AS k, 'o' || CASE WHEN o_orderkey < 20 THEN o_orderkey // 10 ELSE o_orderkey END AS template_id, o_orderpriority AS p, o_orderstatus AS s, o_custkey % 50 = 0 AS odd FROM orders)"""
Q_CUTS = f"""WITH {_Q_OT}, r AS (
  SELECT template_id, 0 AS pos, 'text' AS part_kind, 'Order {{' || p || '}} for ' AS text, NULL::VARCHAR AS filler, NULL::VARCHAR AS style, NULL::VARCHAR AS entity FROM ot WHERE k = 0
  UNION ALL SELECT template_id, 1, 'fill', NULL, 'name', 'full', 'PERSON_NAME' FROM ot WHERE k = 0 UNION ALL SELECT template_id, 2, 'text', ' paid', NULL, NULL, NULL FROM ot WHERE k = 0
  UNION ALL SELECT template_id, 0, 'labelled', 'ABCPS1234K', NULL, NULL, 'PAN' FROM ot WHERE k = 1 UNION ALL SELECT template_id, 1, 'text', ' and ', NULL, NULL, NULL FROM ot WHERE k = 1
  UNION ALL SELECT template_id, 2, 'literal_decoy', '12', NULL, NULL, 'PHONE' FROM ot WHERE k = 1 UNION ALL SELECT template_id, 3, 'text', ' ' || s, NULL, NULL, NULL FROM ot WHERE k = 1
  UNION ALL SELECT template_id, 0, 'text', p || ' ', NULL, NULL, NULL FROM ot WHERE k = 2 UNION ALL SELECT template_id, 1, 'decoy', NULL, 'nonsense', NULL, NULL FROM ot WHERE k = 2
  UNION ALL SELECT template_id, 0, 'fill', NULL, 'phone', 'loud', 'PHONE' FROM ot WHERE k = 3
  UNION ALL SELECT template_id, 0, 'text', 'open ', NULL, NULL, NULL FROM ot WHERE k = 4 UNION ALL SELECT template_id, 1, 'text', '{{', NULL, NULL, NULL FROM ot WHERE k = 4
  UNION ALL SELECT template_id, 2, 'text', ' ' || s, NULL, NULL, NULL FROM ot WHERE k = 4
  UNION ALL SELECT template_id, 0, 'text', 'shut ', NULL, NULL, NULL FROM ot WHERE k = 5 UNION ALL SELECT template_id, 1, 'text', '}}', NULL, NULL, NULL FROM ot WHERE k = 5
  UNION ALL SELECT template_id, 2, 'text', ' ' || s, NULL, NULL, NULL FROM ot WHERE k = 5
  UNION ALL SELECT template_id, 0, 'decoy', NULL, 'decoy_pnr', NULL, 'PHONE' FROM ot WHERE k = 6 UNION ALL SELECT template_id, 1, 'text', ' ', NULL, NULL, NULL FROM ot WHERE k = 6
  UNION ALL SELECT template_id, 2, 'decoy', NULL, 'decoy_card', 'plain', 'PAYMENT_CARD' FROM ot WHERE k = 6
  UNION ALL SELECT template_id, 0, 'labelled', ' x', NULL, NULL, 'PAN' FROM ot WHERE k = 7 UNION ALL SELECT template_id, 1, 'decoy', NULL, 'decoy_pan', 'upper', 'PAN' FROM ot WHERE k = 7)
SELECT template_id, pos::BIGINT AS pos, part_kind, text, filler, style, entity FROM r""".replace("{{", "{").replace("}}", "}")


def template_rules(spark, sf):
    return B.template_problems(_order_templates(spark, sf))


Q_RULES = f"""WITH {_Q_OT}, r AS (SELECT template_id, CASE k WHEN 2 THEN 'no such slot: nonsense' WHEN 3 THEN 'no such style: phone:loud' WHEN 4 THEN 'brace never shut'
  WHEN 5 THEN 'brace never opened' WHEN 7 THEN 'literal with bare edges: [ x]'
  ELSE CASE WHEN odd THEN 'no such difficulty: odd' WHEN k IN (1, 6) THEN 'decoy beside other slots' END END AS problem FROM ot)
SELECT template_id, problem FROM r WHERE problem IS NOT NULL UNION ALL SELECT template_id, 'id used twice' FROM ot GROUP BY 1 HAVING count(*) > 1""".replace("{{", "{").replace("}}", "}")


def built_samples(spark, sf):
    """Samples of every sound order template, three each, with what their only span covers."""
    templates = _order_templates(spark, sf)
    sound = templates.join(B.template_problems(templates).select("template_id").distinct(), "template_id", "left_anti")
    span = F.get("labels.spans", F.lit(0))
    return B.build(sound, SEED, 3).select(
        "id", F.col("labels.kind").alias("kind"), big(F.size("labels.spans")).alias("spans"), big(span["start"]).alias("start"),
        (span["end"] - span["start"] + 5 == F.length("text") - span["start"]).alias("to_the_end"),
    )


Q_BUILT = f"""WITH {_Q_OT} SELECT template_id || '-' || lpad(n::VARCHAR, 4, '0') AS id, 'positive' AS kind, 1::BIGINT AS spans, length('Order {{' || p || '}} for ') AS start, true AS to_the_end
FROM (SELECT *, unnest(range(3)) AS n FROM ot WHERE k = 0 AND NOT odd AND template_id NOT IN (SELECT template_id FROM ot GROUP BY 1 HAVING count(*) > 1))""".replace("{{", "{").replace("}}", "}")


def noisy_texts(spark, sf):
    return spread(table(spark, sf, "conversations")).select("conv_id", "turn", digest_of(B.noisy(F.col("text"), F.concat_ws("/", F.lit("noise"), F.col("conv_id").cast("string"), F.col("turn").cast("string")))).alias("noisy"))


Q_NOISY = f"""
WITH c AS (SELECT conv_id, turn, text, unnest(range(length(text))) AS i FROM conversations),
h AS (SELECT *, text[i + 1] AS ch, {q_number("sha256('noise/' || conv_id || '/' || turn || '/' || (i - 1) || '/scan')", 1, 6)} % 1000 AS u FROM c),
d AS (SELECT conv_id, turn, i, CASE WHEN i = 0 OR i = length(text) - 1 THEN ch WHEN ch = ' ' AND u < {B.BLANK_LOST} THEN '' WHEN ch = ' ' AND u < {B.BLANK_LOST + B.BLANK_TWICE} THEN '  '
  WHEN ch IN ('.', ',', ';', ':', '!', '?') AND u < {B.STOP_LOST} THEN ''
  WHEN u < {B.MISREAD} THEN CASE ch {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in B.MISREADINGS.items())} ELSE ch END ELSE ch END AS o FROM h)
SELECT conv_id, turn, md5(string_agg(o, '' ORDER BY i)) AS noisy FROM d GROUP BY 1, 2"""


def _flawed(spark, sf):
    """Samples with one flaw each, by order."""
    k = F.col("o_orderkey") % 8
    span = lambda s, e, t: F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(t).alias("entity"))
    text = F.when(k == 1, F.lit("   ")).when(k == 6, F.concat(F.lit("PAN  BCPS1234K ok "), "o_orderstatus")).otherwise(F.concat(F.lit("PAN ABCPS1234K ok "), "o_orderstatus"))
    spans = (
        F.when(k == 1, F.array().cast("array<struct<start:int,end:int,entity:string>>")).when(k == 2, F.array(span(4, 99, "PAN")))
        .when(k == 3, F.array(span(4, 14, "PAN"), span(0, 3, "PERSON_NAME"))).when(k == 4, F.array(span(4, 13, "PAN"))).when(k == 5, F.array(span(5, 5, "PAN"), span(4, 14, "PAN")))
        .when(k == 6, F.array(span(4, 14, "PERSON_NAME"))).otherwise(F.array(span(4, 14, "PAN")))
    )
    return table(spark, sf, "orders").select(
        F.concat(F.lit("q"), F.when(F.col("o_orderkey") % 100 == 7, 7).otherwise(F.col("o_orderkey")).cast("string")).alias("id"), text.alias("text"),
        F.struct(F.lit("positive").alias("kind"), spans.alias("spans"), F.lit(None).cast("string").alias("decoy")).alias("labels"),
    )


def sample_flaws(spark, sf):
    return Q.validate(_flawed(spark, sf))


Q_FLAWS = """WITH o AS (SELECT 'q' || CASE WHEN o_orderkey % 100 = 7 THEN 7 ELSE o_orderkey END AS id, o_orderkey % 8 AS k FROM orders)
SELECT id, 'id used twice' AS problem FROM o GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT id, 'blank text' FROM o WHERE k = 1
UNION ALL SELECT id, 'span 4..99 is not inside 0..19' FROM o WHERE k = 2 UNION ALL SELECT id, 'span 0..3 begins before the last one ends' FROM o WHERE k = 3
UNION ALL SELECT id, 'fails the check of PAN: "ABCPS1234"' FROM o WHERE k = 4 UNION ALL SELECT id, 'span 5..5 is not inside 0..19' FROM o WHERE k = 5
UNION ALL SELECT id, 'blank edge: " BCPS1234K"' FROM o WHERE k = 6"""


def carried_over(spark, sf):
    """Samples of the corpus that a later version, with every 50th sample changed and others added, does not hold."""
    old = corpus(spark, sf)
    number = F.regexp_extract("id", r"([0-9]+)\z", 1).cast("long")
    new = old.withColumn("text", F.when(number % 50 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    more = old.withColumn("id", F.concat("id", F.lit("-new")))
    return Q.not_carried_over(old, new.unionByName(more))


def _q_carried() -> str:
    n = len(T.TEMPLATES)
    return f"""WITH {_q_templates()} SELECT name || '-' || CASE WHEN o_orderkey // {n} > 9999 THEN (o_orderkey // {n})::VARCHAR ELSE lpad((o_orderkey // {n})::VARCHAR, 4, '0') END AS id FROM c WHERE (o_orderkey // {n}) % 50 = 3"""


def rebuilt_corpus(spark, sf):
    """Two builds of the same corpus, laid out differently, have one fingerprint; another seed has another."""
    one = SRC.fingerprint(corpus(spark, sf)).select(F.lit(0).alias("k"), "sample_count", F.col("fingerprint").alias("a"))
    two = SRC.fingerprint(corpus(spark, sf).repartition("id")).select(F.lit(0).alias("k"), F.col("fingerprint").alias("b"))
    rows = spread(table(spark, sf, "orders")).select(F.lit("en-kyc").alias("template_id"), F.col("o_orderkey").alias("n"))
    other = SRC.fingerprint(B.rendered(rows, T.builtin(spark), SEED + 1)).select(F.lit(0).alias("k"), F.col("fingerprint").alias("c"))
    return one.join(two, "k").join(other, "k").select(big("sample_count").alias("samples"), (F.col("a") == F.col("b")).alias("same"), (F.col("a") != F.col("c")).alias("differs"))


def corpus_scores(spark, sf):
    """The built-in recognizers scored on the corpus."""
    samples = frozen(corpus(spark, sf))  # read for its labels and for what is detected
    t = S.totals(S.joined(samples, D.builtin_records(samples)))
    return t.where("dimension = 'entity' and mode = 'strict' and tp + fn > 0").select(
        F.col("value").alias("entity"), big(F.col("tp") + F.col("fn")).alias("gold"), (F.col("fn") == 0).alias("all_found"), (F.col("tp") == 0).alias("none_found")
    )


def _q_scores() -> str:
    """All structural values but some cards are found (a card that also passes the other check is taken for a VID);
    names, addresses and dates never are."""
    return f"""WITH {_q_templates()}, g AS (SELECT unnest(spans) AS entity FROM c WHERE decoy IS NULL)
SELECT entity, count(*) AS gold, entity NOT IN ('PERSON_NAME', 'ADDRESS', 'DATE_OF_BIRTH', 'PAYMENT_CARD') AS all_found,
  entity IN ('PERSON_NAME', 'ADDRESS', 'DATE_OF_BIRTH') AS none_found FROM g GROUP BY 1"""


QUERIES = {
    "seeded_draws": (seeded_draws, Q_DRAWS),
    "filler_values": (filler_values, _q_fillers()),
    "corpus_stats": (corpus_stats, _q_stats()),
    "corpus_ids": (corpus_ids, _q_ids()),
    "kyc_texts": (kyc_texts, _q_kyc()),
    "template_cuts": (template_cuts, Q_CUTS),
    "template_rules": (template_rules, Q_RULES),
    "built_samples": (built_samples, Q_BUILT),
    "noisy_texts": (noisy_texts, Q_NOISY),
    "sample_flaws": (sample_flaws, Q_FLAWS),
    "carried_over": (carried_over, _q_carried()),
    "rebuilt_corpus": (rebuilt_corpus, "SELECT count(*) AS samples, true AS same, true AS differs FROM orders"),
    "corpus_scores": (corpus_scores, _q_scores()),
}
