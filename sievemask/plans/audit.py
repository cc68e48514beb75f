"""Queries for scripted conversations, the audit, and chat wire formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievemask.corpus.draws import digits, letters
from sievemask.functions.spans import unfolded
from sievemask.operators import alignment as A
from sievemask.operators import audit as U
from sievemask.operators import chat as C
from sievemask.operators import roundtrip as R
from sievemask.operators import scenario_rules as SR
from sievemask.plans.common import big, digest_of, q_digits, q_letters, scratch, table
from sievemask.schemas import SEGMENT, TOOL_CALL
from sievemask.session import frozen
from sievemask.sources import sse
from sievemask.sources.scenarios import load_scenarios, write_packed


def _seg(text=None, slot=None, start=None, end=None, mangle=None):
    text = F.lit(text) if text is None or isinstance(text, str) else text
    mangle = F.lit(mangle) if mangle is None or isinstance(mangle, str) else mangle
    return F.struct(
        text.cast("string").alias("text"), F.lit(slot).cast("int").alias("slot"), F.lit(start).cast("int").alias("from"),
        F.lit(end).cast("int").alias("to"), mangle.cast("string").alias("mangle"),
    )


def _input(*segs, kind="user", call=None):
    kind = F.lit(kind) if isinstance(kind, str) else kind
    call = F.lit(None) if call is None else call
    return F.struct(kind.alias("kind"), F.array(*segs).alias("segments"), call.cast("string").alias("call_id"))


def _reply(kind, chunks, call=None, name=None, status=None, body=None):
    return F.struct(
        F.lit(kind).alias("kind"), F.array(*[F.array(*c) for c in chunks]).cast(f"array<array<{SEGMENT}>>").alias("chunks"),
        F.lit(call).cast("string").alias("call_id"), F.lit(name).cast("string").alias("name"),
        F.lit(status).cast("int").alias("status"), F.lit(body).cast("string").alias("body"),
    )


def scenarios(spark, sf):
    """One two-turn scenario per message; its kind (0-5) follows from its conversation and turn.

    0 plain, 1 streamed with split placeholders, 2 a tool call and its result, 3 a placeholder copied in lower
    case, 4 an upstream error, 5 a value the masker does not recognize."""
    key = F.concat(F.lit("sc/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    kind = (F.col("conv_id") * 10 + F.col("turn")) % 6
    pan = F.concat(letters(key, "a", 3), F.lit("PS"), digits(key, "b", 4), letters(key, "c", 1))
    name = F.concat(F.lit("Ananya "), F.initcap(letters(key, "n", 5)))
    k = F.col("kind")
    rows = table(spark, sf, "conversations").select(
        "conv_id", "turn", "text", kind.alias("kind"), F.when(kind == 5, name).otherwise(pan).alias("first"),
        F.concat(F.lit("9"), digits(key, "d", 9)).alias("second"),
    )
    both = [_seg(F.concat(F.lit("Note: "), "text", F.lit(" ID "))), _seg(slot=0), _seg(" phone "), _seg(slot=1), _seg(".")]
    first_reply = (
        F.when(k == 1, _reply("text", [[_seg("Got "), _seg(slot=0, end=3)], [_seg(slot=0, start=3), _seg(" and "), _seg(slot=1, end=1)], [_seg(slot=1, start=1), _seg(" ok")]]))
        .when(k == 2, _reply("tool_call", [[_seg('{"id": "'), _seg(slot=0)], [_seg('"}')]], call="c1", name="verify"))
        .when(k == 3, _reply("text", [[_seg("Got "), _seg(slot=0, mangle="lowercase")]]))
        .otherwise(_reply("text", [[_seg("Got "), _seg(slot=0)]]))
    )
    second_reply = F.when(k == 4, _reply("http_error", [], status=503, body="busy")).otherwise(
        _reply("text", [[_seg("Again "), _seg(slot=0), _seg(" / "), _seg(slot=1)]])
    )
    follow = _input(
        _seg("Repeat "), _seg(slot=0), kind=F.when(k == 2, "tool_result").otherwise("user"), call=F.when(k == 2, "c1")
    )
    checks = F.array(*[F.lit(c) for c in ("no_leak_upstream", "restored_exact", "no_placeholder_fragment", "placeholder_stable_across_turns", "json_valid")])
    category = F.element_at(
        F.array(*[F.lit(c) for c in ("basic", "streaming_split", "tool_calls", "placeholder_mangling", "failure_behaviour", "multi_turn")]),
        (k + 1).cast("int"),
    )
    return rows.select(
        F.concat_ws("-", F.lit("s"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), category.alias("category"),
        F.lit("").alias("description"), F.when(k % 2 == 0, "openai_chat").otherwise("anthropic_messages").alias("api"),
        (k == 1).alias("stream"), F.array("first", "second").alias("pii"),
        F.array(F.struct(F.lit("verify").alias("name"), F.lit("").alias("description"), F.lit("{}").alias("parameters"))).alias("tools"),
        F.array(F.struct(_input(*both).alias("input"), first_reply.alias("reply")), F.struct(follow.alias("input"), second_reply.alias("reply"))).alias("turns"),
        F.when(k == 4, F.concat(checks, F.array(F.lit("fails_closed")))).otherwise(checks).alias("checks"),
        "kind",
    )


_K = "'sc/' || conv_id || '/' || turn"
Q_SCENARIOS = f"""
s AS (SELECT 's-' || conv_id || '-' || turn AS conv_id, (conv_id * 10 + turn) % 6 AS kind, text AS body,
  CASE WHEN (conv_id * 10 + turn) % 6 = 5 THEN 'Ananya ' || upper({q_letters(_K, 'n', 5)}[1]) || lower({q_letters(_K, 'n', 5)}[2:])
    ELSE {q_letters(_K, 'a', 3)} || 'PS' || {q_digits(_K, 'b', 4)} || {q_letters(_K, 'c', 1)} END AS first, '9' || {q_digits(_K, 'd', 9)} AS second FROM conversations),
sc AS (SELECT *, CASE WHEN kind = 5 THEN first ELSE '[PAN_1]' END AS p0, '[PHONE_1]' AS p1 FROM s)"""


def conversation_inputs(spark, sf):
    return A.conversation_turns(scenarios(spark, sf)).select("conv_id", big("turn").alias("turn"), "kind", "call_id", digest_of("text").alias("text"))


Q_INPUTS = f"""WITH {Q_SCENARIOS} SELECT conv_id, 0::BIGINT AS turn, 'user' AS kind, NULL::VARCHAR AS call_id, md5('Note: ' || body || ' ID ' || first || ' phone ' || second || '.') AS text FROM sc
UNION ALL SELECT conv_id, 1, CASE WHEN kind = 2 THEN 'tool_result' ELSE 'user' END, CASE WHEN kind = 2 THEN 'c1' END, md5('Repeat ' || first) FROM sc"""


def expected_replies(spark, sf):
    return A.expected_turns(scenarios(spark, sf)).select("conv_id", big("turn").alias("turn"), "expects", "text", "name", big("status").alias("status"))


Q_EXPECTED = f"""WITH {Q_SCENARIOS} SELECT conv_id, 0::BIGINT AS turn, CASE WHEN kind = 2 THEN 'call' ELSE 'text' END AS expects,
  CASE kind WHEN 1 THEN 'Got ' || first || ' and ' || second || ' ok' WHEN 2 THEN '{{"id": "' || first || '"}}' ELSE 'Got ' || first END AS text,
  CASE WHEN kind = 2 THEN 'verify' END AS name, NULL::BIGINT AS status FROM sc
UNION ALL SELECT conv_id, 1, CASE WHEN kind = 4 THEN 'error' ELSE 'text' END, CASE WHEN kind = 4 THEN '' ELSE 'Again ' || first || ' / ' || second END,
  NULL, CASE WHEN kind = 4 THEN 503 END FROM sc"""


def captured_requests(spark, sf):
    """`(conv_id, turn, body)`: request bodies as a proxy run would leave them, values replaced where the masker knew them."""
    sc = scenarios(spark, sf)
    turns = A.conversation_turns(sc).join(sc.select(F.col("id").alias("conv_id"), "api", "kind").withColumnRenamed("kind", "variant"), "conv_id")
    first, second = F.get("pii", F.lit(0)), F.get("pii", F.lit(1))
    known = F.when(F.col("variant") == 5, F.col("text")).otherwise(F.replace("text", first, F.lit("[PAN_1]")))
    said = F.to_json(F.array(F.replace(known, second, F.lit("[PHONE_1]"))))
    said = F.substring(said, F.lit(2), F.length(said) - 2)
    is_result = F.col("kind") == "tool_result"
    openai = F.when(is_result, F.concat(F.lit('{"role":"tool","tool_call_id":"c1","content":'), said, F.lit("}"))).otherwise(F.concat(F.lit('{"role":"user","content":'), said, F.lit("}")))
    blocks = F.concat(F.lit('{"role":"user","content":[{"type":"text","text":'), said, F.lit("}]}"))
    body = F.concat(F.lit('{"model":"m","messages":[{"role":"system","content":"be brief"},'), F.when(F.col("api") == "openai_chat", openai).otherwise(blocks), F.lit("]}"))
    return sc, turns.select("conv_id", "turn", body.alias("body"))


def _captured_alignments(spark, sf):
    return A.alignment_rows(A.aligned_requests(*captured_requests(spark, sf)))


def aligned_slots(spark, sf):
    return _captured_alignments(spark, sf).select("conv_id", *[big(c).alias(c) for c in ("turn", "occ", "slot")], "text")


Q_ALIGNED = f"""WITH {Q_SCENARIOS} SELECT conv_id, 0::BIGINT AS turn, 0::BIGINT AS occ, 0::BIGINT AS slot, p0 AS text FROM sc
UNION ALL SELECT conv_id, 0, 1, 1, p1 FROM sc UNION ALL SELECT conv_id, 1, 0, 0, p0 FROM sc"""


def first_slot_texts(spark, sf):
    t = A.first_placeholders(_captured_alignments(spark, sf))
    return t.select("conv_id", big("slot").alias("slot"), "text", big("since").alias("since"))


Q_FIRST = f"WITH {Q_SCENARIOS} SELECT conv_id, 0::BIGINT AS slot, p0 AS text, 0::BIGINT AS since FROM sc UNION ALL SELECT conv_id, 1, p1, 0 FROM sc"


def scripted_replies(spark, sf):
    """Replies as the upstream would send them, chunk by chunk, with placeholders of a foreign format."""
    turns = A.conversation_turns(scenarios(spark, sf)).withColumn(
        "masked",
        F.when(F.col("turn") == 0, F.replace(F.replace("text", F.get("pii", F.lit(0)), F.lit("<ID_1>")), F.get("pii", F.lit(1)), F.lit("<<Phone 1>>"))).otherwise(
            F.replace("text", F.get("pii", F.lit(0)), F.lit("<ID_1>"))
        ),
    )
    aligned = A.with_alignment(turns)
    done = R.replies(aligned, A.first_placeholders(A.alignment_rows(aligned)))
    return done.select("conv_id", big("turn").alias("turn"), F.array_join("rendered", "|").alias("chunks"), "script_error")


Q_SCRIPTED = f"""WITH {Q_SCENARIOS} SELECT conv_id, 0::BIGINT AS turn, CASE kind WHEN 1 THEN 'Got <ID|_1> and <|<Phone 1>> ok' WHEN 2 THEN '{{"id": "<ID_1>|"}}'
  WHEN 3 THEN 'Got <id_1>' ELSE 'Got <ID_1>' END AS chunks, NULL::VARCHAR AS script_error FROM sc
UNION ALL SELECT conv_id, 1, CASE WHEN kind = 4 THEN '' ELSE 'Again <ID_1> / <<Phone 1>>' END, NULL FROM sc"""


def replayed_observations(spark, sf):
    o = R.replay(scenarios(spark, sf))["observations"]
    call = F.try_element_at("tool_calls", F.lit(1))
    return o.select("conv_id", big("turn").alias("turn"), "kind", "text", call["name"].alias("call"), call["arguments"].alias("arguments"), "message", big("http_status").alias("http_status"))


Q_OBSERVED = f"""WITH {Q_SCENARIOS} SELECT conv_id, 0::BIGINT AS turn, 'completed' AS kind,
  CASE kind WHEN 1 THEN 'Got ' || first || ' and ' || second || ' ok' WHEN 2 THEN '' WHEN 3 THEN 'Got [pan_1]' ELSE 'Got ' || first END AS text,
  CASE WHEN kind = 2 THEN 'verify' END AS call, CASE WHEN kind = 2 THEN '{{"id": "' || first || '"}}' END AS arguments, NULL::VARCHAR AS message, NULL::BIGINT AS http_status FROM sc
UNION ALL SELECT conv_id, 1, CASE WHEN kind = 4 THEN 'errored' ELSE 'completed' END, CASE WHEN kind <> 4 THEN 'Again ' || first || ' / ' || second END, NULL, NULL,
  CASE WHEN kind = 4 THEN 'busy' END, CASE WHEN kind = 4 THEN 503 END FROM sc"""


def replay_verdicts(spark, sf):
    sc = scenarios(spark, sf)
    log = R.replay(sc)
    v = U.verdicts(sc, U.audit(sc, log), log)
    return v.select("conv_id", "category", "status", *[big(c).alias(c) for c in ("failures", "no_leak_upstream", "restored_exact", "no_placeholder_fragment")], digest_of("upstream_excerpt").alias("upstream"), F.col("client_excerpt").alias("client"))


Q_VERDICTS = f"""WITH {Q_SCENARIOS} SELECT conv_id, (['basic','streaming_split','tool_calls','placeholder_mangling','failure_behaviour','multi_turn'])[(kind+1)::INT] AS category,
  CASE WHEN kind IN (3, 5) THEN 'fail' ELSE 'pass' END AS status, CASE kind WHEN 3 THEN 2 WHEN 5 THEN 1 ELSE 0 END::BIGINT AS failures,
  CASE WHEN kind = 5 THEN 1 ELSE 0 END::BIGINT AS no_leak_upstream, CASE WHEN kind = 3 THEN 1 ELSE 0 END::BIGINT AS restored_exact,
  CASE WHEN kind = 3 THEN 1 ELSE 0 END::BIGINT AS no_placeholder_fragment,
  CASE WHEN kind IN (3, 5) THEN md5('["Repeat ' || p0 || '"]') END AS upstream,
  CASE WHEN kind IN (3, 5) THEN '[{{"kind":"completed","text":"Got ' || CASE WHEN kind = 3 THEN '[pan_1]' ELSE first END || '","tool_calls":[]}}, {{"kind":"completed","text":"Again ' || first || ' / ' || second || '","tool_calls":[]}}]' END AS client FROM sc"""


def captured(spark, sf):
    """Tables as a proxy run would leave them, with one fault per scenario chosen by `fault` (0-9, 0 is none)."""
    sc = scenarios(spark, sf).withColumn("fault", F.pmod(F.length("id") + F.col("kind") * 3 + F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("int"), F.lit(10)))
    f, first, second = F.col("fault"), F.get("pii", F.lit(0)), F.get("pii", F.lit(1))
    leak = F.when(f == 1, first).when(f == 2, F.concat(F.substring(second, 1, 5), F.lit("-"), F.substring(second, 6, 5))).otherwise("[PAN_1]")
    payloads = sc.select(
        F.col("id").alias("conv_id"), F.lit(0).alias("seq"),
        F.to_json(F.struct(F.lit("m").alias("model"), F.array(F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("text").alias("type"), F.concat(F.lit('say "'), leak, F.lit('"')).alias("text"))).alias("content"))).alias("messages"))).alias("body"),
    )
    slots = F.array(
        F.struct(F.lit(0).alias("turn"), F.lit(0).alias("occ"), F.lit(0).alias("slot"), F.lit("[PAN_1]").alias("text")),
        F.struct(F.lit(0).alias("turn"), F.lit(1).alias("occ"), F.lit(1).alias("slot"), second.alias("text")),
        F.struct(F.lit(1).alias("turn"), F.lit(0).alias("occ"), F.lit(0).alias("slot"), F.when(f == 3, "[PAN_2]").otherwise("[PAN_1]").alias("text")),
    )
    alignments = sc.select(F.col("id").alias("conv_id"), F.explode(slots).alias("a")).select("conv_id", "a.*")
    expected = A.expected_turns(sc).join(sc.select(F.col("id").alias("conv_id"), "fault"), "conv_id")
    call, error = F.col("expects") == "call", F.col("expects") == "error"
    text = F.when(f == 4, F.concat("text", F.lit("!"))).when(f == 5, F.concat("text", F.lit(" [pan"))).otherwise(F.col("text"))
    arguments = F.when(f == 6, F.concat("text", F.lit("}"))).when(f == 7, F.replace("text", F.lit('": "'), F.lit('":"'))).otherwise(F.col("text"))
    calls = F.array(F.struct(F.lit("c9").alias("id"), F.col("name").alias("name"), arguments.alias("arguments")))
    fell_open = error & (f == 8)
    errored = (error & (f != 8)) | (~error & (f == 9) & (F.col("turn") == 0))
    observations = expected.select(
        "conv_id", "turn", F.when(errored, "errored").otherwise("completed").alias("kind"),
        F.when(errored, None).when(fell_open, "fine").when(call, "").otherwise(text).alias("text"),
        F.when(errored, None).when(call, calls).otherwise(F.array().cast(f"array<{TOOL_CALL}>")).alias("tool_calls"),
        F.when(errored, "upstream error").alias("message"), F.when(errored, F.when(f == 7, 500).otherwise(F.when(error, 503).otherwise(502))).alias("http_status"),
    )
    errors = sc.where("fault = 2").select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("turn 0: lost").alias("message"))
    return sc, {"payloads": payloads, "alignments": alignments, "observations": observations, "script_errors": errors}


_Q_FAULT = "((length(conv_id) + kind * 3 + ('0x' || substr(md5(conv_id), 1, 4))::INT) % 10)"
Q_CAPTURED = f"""WITH {Q_SCENARIOS},
f AS (SELECT *, {_Q_FAULT} AS fault FROM sc),
t AS (SELECT *, 0 AS turn, CASE WHEN kind = 2 THEN 'call' ELSE 'text' END AS expects FROM f
  UNION ALL SELECT *, 1, CASE WHEN kind = 4 THEN 'error' ELSE 'text' END FROM f),
r AS (
  SELECT conv_id, 'no_leak_upstream' AS "check", NULL AS turn FROM f WHERE fault IN (1, 2)
  UNION ALL SELECT conv_id, 'placeholder_stable_across_turns', NULL FROM f WHERE fault = 3
  UNION ALL SELECT conv_id, 'restored_exact', 0 FROM f WHERE fault = 2
  UNION ALL SELECT conv_id, 'restored_exact', turn FROM t WHERE (fault IN (4, 5) AND expects = 'text') OR (fault = 6 AND expects = 'call') OR (fault = 9 AND turn = 0 AND expects <> 'error')
  UNION ALL SELECT conv_id, 'no_placeholder_fragment', turn FROM t WHERE fault = 5 AND expects = 'text'
  UNION ALL SELECT conv_id, 'json_valid', turn FROM t WHERE fault = 6 AND expects = 'call'
  UNION ALL SELECT conv_id, 'fails_closed', turn FROM t WHERE expects = 'error' AND fault IN (7, 8))"""


def captured_failures(spark, sf):
    sc, log = captured(spark, sf)
    return U.audit(sc, log).select("conv_id", "check", big("turn").alias("turn"))


def captured_verdicts(spark, sf):
    sc, log = captured(spark, sf)
    v = U.verdicts(sc, U.audit(sc, log), log)
    from sievemask.schemas import CHECKS

    return v.groupBy("status").agg(big(F.count(F.lit(1))).alias("scenarios"), big(F.sum("failures")).alias("failures"), *[big(F.sum(c)).alias(c) for c in CHECKS])


Q_CAPTURED_VERDICTS = Q_CAPTURED + """,
n AS (SELECT f.conv_id, count(r.conv_id) AS failures, count(*) FILTER ("check" = 'no_leak_upstream') AS a, count(*) FILTER ("check" = 'restored_exact') AS b,
  count(*) FILTER ("check" = 'no_placeholder_fragment') AS c, count(*) FILTER ("check" = 'placeholder_stable_across_turns') AS d,
  count(*) FILTER ("check" = 'json_valid') AS e, count(*) FILTER ("check" = 'fails_closed') AS g FROM f LEFT JOIN r USING (conv_id) GROUP BY 1)
SELECT CASE WHEN failures > 0 THEN 'fail' ELSE 'pass' END AS status, count(*) AS scenarios, sum(failures)::BIGINT AS failures, sum(a)::BIGINT AS no_leak_upstream,
  sum(b)::BIGINT AS restored_exact, sum(c)::BIGINT AS no_placeholder_fragment, sum(d)::BIGINT AS placeholder_stable_across_turns,
  sum(e)::BIGINT AS json_valid, sum(g)::BIGINT AS fails_closed FROM n GROUP BY 1"""


def captured_failure_lists(spark, sf):
    """Every verdict's failures with their details, in order."""
    sc, log = captured(spark, sf)
    return U.failure_lists(U.audit(sc, log)).select("conv_id", big("place").alias("place"), "check", "detail")


_Q_WANT = """CASE WHEN turn = 0 THEN CASE kind WHEN 1 THEN 'Got ' || first || ' and ' || second || ' ok' WHEN 2 THEN '{"id": "' || first || '"}' ELSE 'Got ' || first END
  ELSE 'Again ' || first || ' / ' || second END"""
Q_LISTS = Q_CAPTURED.replace("SELECT *, 1, CASE", "SELECT *, 1 AS turn, CASE") + f""",
w AS (SELECT *, {_Q_WANT} AS want FROM t),
d AS (
  SELECT conv_id, 1 AS c, -1 AS turn, CASE fault WHEN 1 THEN 'value 0 leaked: "' || first || '"' ELSE 'value 1 leaked: "' || second || '"' END AS detail FROM f WHERE fault IN (1, 2)
  UNION ALL SELECT conv_id, 4, -1, 'slot 0 became "[PAN_1]", "[PAN_2]"' FROM f WHERE fault = 3
  UNION ALL SELECT conv_id, 2, 0, 'script broke: turn 0: lost' FROM f WHERE fault = 2
  UNION ALL SELECT conv_id, 2, turn, 'turn ' || turn || ': "' || want || CASE fault WHEN 4 THEN '!' ELSE ' [pan' END || '" instead of "' || want || '"' FROM w WHERE fault IN (4, 5) AND expects = 'text'
  UNION ALL SELECT conv_id, 2, turn, 'turn ' || turn || ': calls [{{"id":"c9","name":"verify","arguments":"' || replace(want, '"', '\\"') || '}}"}}] instead of verify ' || want FROM w WHERE fault = 6 AND expects = 'call'
  UNION ALL SELECT conv_id, 2, 0, 'turn 0: error 502 instead of a reply: upstream error' FROM w WHERE fault = 9 AND turn = 0 AND expects <> 'error'
  UNION ALL SELECT conv_id, 3, turn, 'turn ' || turn || ': piece "[pan" of "[PAN_1]"' FROM w WHERE fault = 5 AND expects = 'text'
  UNION ALL SELECT conv_id, 5, turn, 'turn ' || turn || ': does not parse: "' || replace(want, '"', '\\"') || '}}"' FROM w WHERE fault = 6 AND expects = 'call'
  UNION ALL SELECT conv_id, 6, turn, 'turn ' || turn || ': error 503 became ' || CASE fault WHEN 7 THEN 'status 500' ELSE 'the reply "fine"' END FROM w WHERE expects = 'error' AND fault IN (7, 8))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY c, turn, detail) AS place,
  (['no_leak_upstream', 'restored_exact', 'no_placeholder_fragment', 'placeholder_stable_across_turns', 'json_valid', 'fails_closed'])[c::INT] AS "check", detail FROM d"""


def missing_turns(spark, sf):
    """Turn counts that do not fit, with every third scenario's last turn never reported."""
    sc, log = captured(spark, sf)
    short = log["observations"].where(~((F.col("turn") == 1) & (F.length("conv_id") % 3 == 0)))
    return U.script_failures(sc, short, log["script_errors"]).select("conv_id", "check", big("turn").alias("turn"), "detail")


Q_MISSING = f"""WITH {Q_SCENARIOS}, f AS (SELECT *, {_Q_FAULT} AS fault FROM sc)
SELECT conv_id, 'restored_exact' AS "check", 0::BIGINT AS turn, 'script broke: turn 0: lost' AS detail FROM f WHERE fault = 2
UNION ALL SELECT conv_id, 'restored_exact', NULL, 'turns seen: 1 of 2' FROM f WHERE length(conv_id) % 3 = 0"""


def applicability(spark, sf):
    """Each scenario against tools with different abilities."""
    sc = scenarios(spark, sf)
    tools = F.array(
        *[
            F.struct(F.lit(n).alias("tool"), F.array(*[F.lit(c) for c in caps]).alias("caps"))
            for n, caps in (("full", ("mask", "unmask", "unmask_stream")), ("batch", ("mask", "unmask")), ("redactor", ("detect", "mask")), ("proxy", ("proxy",)))
        ]
    )
    apis = F.array(F.lit("openai_chat"))
    return sc.select("id", "category", "api", "stream", "checks", F.explode(tools).alias("t")).select(
        F.col("id").alias("conv_id"), "t.tool", U.role(F.col("t.caps")).alias("role"),
        F.when(U.role(F.col("t.caps")) == "proxy", U.driver_reason(F.lit("sdk"), apis, F.col("api"))).otherwise(
            U.library_reason(F.col("stream"), F.col("checks"), F.col("t.caps"))
        ).alias("reason"),
        U.control_reason(F.col("category")).alias("control_reason"),
    )


Q_APPLICABLE = f"""WITH {Q_SCENARIOS} SELECT conv_id, tool, CASE tool WHEN 'proxy' THEN 'proxy' WHEN 'redactor' THEN 'redact_only' ELSE 'library' END AS role,
  CASE WHEN tool = 'proxy' THEN CASE WHEN kind % 2 = 1 THEN 'sdk lacks anthropic_messages' END
    WHEN tool = 'redactor' THEN 'masks only' WHEN tool = 'batch' AND kind = 1 THEN 'cannot restore streams'
    WHEN kind = 4 THEN 'has no upstream' END AS reason,
  CASE WHEN kind = 3 THEN 'mangles what was never masked' END AS control_reason
FROM sc, (VALUES ('full'), ('batch'), ('redactor'), ('proxy')) AS t(tool)"""


def scenario_problems(spark, sf):
    """Scenarios broken in one way each, by conversation."""
    broken = F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("int") % 11
    b = F.col("b")
    sc = scenarios(spark, sf).withColumn("b", broken)
    turns = F.transform(
        "turns",
        lambda t, i: F.struct(
            F.struct(
                t["input"]["kind"].alias("kind"),
                F.when((b == 1) & (i == 0), F.array(_seg("x "), _seg(slot=5))).when((b == 2) & (i == 0), F.array(_seg(slot=0), _seg(""), _seg(slot=1))).otherwise(t["input"]["segments"]).alias("segments"),
                F.when((b == 3) & (i == 1), "zz").otherwise(t["input"]["call_id"]).alias("call_id"),
            ).alias("input"),
            F.when((b == 4) & (i == 1), _reply("http_error", [], status=200, body="")).when((b == 5) & (i == 1), _reply("text", [[_seg(slot=1), _seg(slot=7)]])).otherwise(t["reply"]).alias("reply"),
        ),
    )
    changed = sc.withColumn("turns", F.when(b == 10, F.slice("turns", 1, 0)).otherwise(turns)).withColumn(
        "pii", F.when(b == 6, F.array(F.lit(" "), F.lit("x"))).otherwise(F.col("pii"))
    ).withColumn("checks", F.when(b == 7, F.array(F.lit("fails_closed"))).when(b == 8, F.slice("checks", 1, 0)).otherwise(F.col("checks"))).withColumn(
        "tools", F.when(b == 9, F.slice("tools", 1, 0)).otherwise(F.col("tools"))
    )
    return SR.with_problem(changed).where("problem is not null").select(F.col("id").alias("conv_id"), "problem")


Q_PROBLEMS = f"""WITH {Q_SCENARIOS}, p AS (SELECT conv_id, kind, ('0x' || substr(md5(conv_id), 1, 4))::INT % 11 AS b FROM sc),
q AS (SELECT conv_id, CASE WHEN b IN (8, 10) THEN 'nothing to run' WHEN b = 6 THEN 'blank value'
  WHEN b = 1 THEN 'turn 0: slot without value: 5' WHEN b = 2 THEN 'turn 0: slot beside slot'
  WHEN b = 9 AND kind = 2 THEN 'turn 0: call of an undeclared tool: verify'
  WHEN b = 3 AND kind = 2 THEN 'turn 1: result for no open call: zz'
  WHEN b = 4 THEN 'turn 1: status is no error: 200' WHEN b = 5 THEN 'turn 1: slot replied before it was given: 7'
  WHEN b = 7 AND kind <> 4 THEN 'fails_closed and http_error go together' END AS problem FROM p)
SELECT conv_id, problem FROM q WHERE problem IS NOT NULL"""


def repeated_ids(spark, sf):
    sc = scenarios(spark, sf)
    return SR.duplicate_ids(sc.unionByName(sc.where("kind = 3")))


def loaded_scenarios(spark, sf):
    """Scenarios written to files and loaded: those that may run, and what is wrong with the others. Some lie in another's folder or break a rule."""
    sc = scenarios(spark, sf)
    root = scratch(spark, "scenarios") + "/files"
    named = F.when(F.col("kind") == 1, F.concat(F.lit("x"), "id")).otherwise(F.col("id"))
    checks = F.when(F.col("kind") == 3, F.array(F.lit("fails_closed"))).otherwise(F.col("checks"))
    folder = F.when(F.col("kind") == 4, "unicode").otherwise(F.col("category"))
    body = F.to_json(F.struct(named.alias("id"), "category", "description", "api", "stream", "pii", "tools", "turns", checks.alias("checks")))
    write_packed(sc.select(folder.alias("category"), "id", body.alias("body")), root)
    fine, problems = load_scenarios(spark, root, packed=True)
    none = F.lit(None).cast("string")
    return fine.select("id", "category", big(F.size("turns")).alias("turns"), none.alias("problem")).unionByName(
        problems.select("id", none.alias("category"), F.lit(None).cast("long").alias("turns"), "problem")
    )


Q_LOADED = f"""WITH {Q_SCENARIOS} SELECT CASE WHEN kind = 1 THEN 'x' ELSE '' END || conv_id AS id,
  CASE WHEN kind IN (0, 2, 5) THEN (['basic','streaming_split','tool_calls','placeholder_mangling','failure_behaviour','multi_turn'])[(kind+1)::INT] END AS category,
  CASE WHEN kind IN (0, 2, 5) THEN 2::BIGINT END AS turns,
  CASE kind WHEN 1 THEN 'file ' || conv_id || ' holds id x' || conv_id WHEN 3 THEN 'fails_closed and http_error go together'
    WHEN 4 THEN 'folder unicode holds category failure_behaviour' END AS problem FROM sc"""


def parsed_requests(spark, sf):
    """Requests in both formats: content as a string, as blocks, and as a tool result."""
    rows = table(spark, sf, "conversations").withColumn("api", F.when(F.col("turn") % 2 == 0, "openai_chat").otherwise("anthropic_messages"))
    text = F.expr("substring(q, 2, length(q) - 2)")
    q = F.to_json(F.array("text"))
    last = (
        F.when(F.col("turn") % 4 == 0, F.concat(F.lit('{"role":"user","content":'), text, F.lit("}")))
        .when(F.col("turn") % 4 == 1, F.concat(F.lit('{"role":"user","content":[{"type":"tool_result","tool_use_id":"t","content":[{"type":"text","text":'), text, F.lit("}]}]}")))
        .when(F.col("turn") % 4 == 2, F.concat(F.lit('{"role":"tool","tool_call_id":"t","content":[{"type":"text","text":'), text, F.lit('},{"type":"text","text":"+"}]}')))
        .otherwise(F.concat(F.lit('{"role":"user","content":[{"type":"tool_result","content":'), text, F.lit('},{"type":"text","text":"+"}]}')))
    )
    body = F.concat(F.lit('{"model":"m1","stream":'), (F.col("conv_id") % 2 == 0).cast("string"), F.lit(',"messages":[{"role":"system","content":"be"},{"role":"user","content":"first"},{"role":"assistant","content":null},'), last, F.lit("]}"))
    return rows.withColumn("q", q).select("conv_id", "turn", C.parsed_request(F.col("api"), body).alias("r")).select(
        "conv_id", "turn", big("r.turn").alias("request_turn"), digest_of("r.latest_input").alias("latest"), "r.stream", "r.model", "r.problem"
    )


Q_REQUESTS = """SELECT conv_id, turn, 1::BIGINT AS request_turn, md5(text || CASE WHEN turn % 4 >= 2 THEN '+' ELSE '' END) AS latest,
  conv_id % 2 = 0 AS stream, 'm1' AS model, NULL::VARCHAR AS problem FROM conversations"""


def api_paths(spark, sf):
    path = F.concat(F.lit("/p"), F.col("page_id").cast("string"), F.element_at(F.array(F.lit("/v1/chat/completions"), F.lit("/v1/messages//"), F.lit("/v1/embeddings")), (F.col("page_id") % 3 + 1).cast("int")))
    return table(spark, sf, "pages").select("page_id", C.api_of(path).alias("api"), C.api_of(F.col("url")).alias("own"))


Q_PATHS = """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'openai_chat' WHEN 1 THEN 'anthropic_messages' END AS api,
  CASE WHEN ends_with(rtrim(url, '/'), '/chat/completions') THEN 'openai_chat' WHEN ends_with(rtrim(url, '/'), '/messages') THEN 'anthropic_messages' END AS own FROM pages"""


def parsed_responses(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("q", F.to_json(F.array("text")))
    text = F.expr("substring(q, 2, length(q) - 2)")
    api = F.when(F.col("turn") % 2 == 0, "openai_chat").otherwise("anthropic_messages")
    body = F.when(
        F.col("turn") % 2 == 0,
        F.concat(F.lit('{"choices":[{"message":{"content":'), text, F.lit(',"tool_calls":[{"id":"c","function":{"name":"f","arguments":"{\\"a\\": 1}"}}]}}]}')),
    ).otherwise(F.concat(F.lit('{"content":[{"type":"text","text":'), text, F.lit('},{"type":"tool_use","id":"i","name":"n","input":{"b":1}},{"type":"text","text":"+"}]}')))
    call = F.col("r.tool_calls")[0]
    return rows.select("conv_id", "turn", C.parsed_response(api, body).alias("r")).select(
        "conv_id", "turn", digest_of("r.text").alias("text"), big(F.size("r.tool_calls")).alias("calls"), call["id"].alias("id"), call["name"].alias("name"), call["arguments"].alias("arguments")
    )


Q_RESPONSES = """SELECT conv_id, turn, md5(text || CASE WHEN turn % 2 = 1 THEN '+' ELSE '' END) AS text, 1::BIGINT AS calls, CASE WHEN turn % 2 = 0 THEN 'c' ELSE 'i' END AS id,
  CASE WHEN turn % 2 = 0 THEN 'f' ELSE 'n' END AS name, CASE WHEN turn % 2 = 0 THEN '{"a": 1}' ELSE '{"b":1}' END AS arguments FROM conversations"""


def captured_bodies(spark, sf):
    """Streamed replies as captured: event-stream text of both formats, with carriage returns, a comment, and an
    end that was cut off."""
    rows = table(spark, sf, "conversations")
    n = F.ceil(F.length("text") / 25).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.to_json(F.array(F.substring("text", i * 25 + 1, F.lit(25)))))
    bare = lambda p: F.substring(p, F.lit(2), F.length(p) - 2)
    openai = F.concat(
        F.lit('data: {"choices":[{"delta":{"role":"assistant","content":""}}]}\r\n\r\n'),
        F.array_join(F.transform(pieces, lambda p: F.concat(F.lit('data: {"choices":[{"delta":{"content":'), bare(p), F.lit("}}]}\r\n\r\n"))), ""),
        F.lit('data: {"choices":[{"delta":{"tool_calls":[{"index":0,"id":"c1","function":{"name":"f","arguments":"{\\"a\\""}}]}}]}\n\n: keep\n\ndata: {"choices":[{"delta":{"tool_calls":[{"index":0,"function":{"arguments":":1}"}}]}}]}\n\ndata: [DONE]\n\ndata: {"cut"'),
    )
    anthropic = F.concat(
        F.lit('event: message_start\ndata: {"type":"message_start"}\n\nevent: content_block_start\ndata: {"type":"content_block_start","index":1,"content_block":{"type":"tool_use","id":"c1","name":"f"}}\n\n'),
        F.array_join(F.transform(pieces, lambda p: F.concat(F.lit('event: content_block_delta\ndata: {"type":"content_block_delta","index":0,\ndata: "delta":{"type":"text_delta","text":'), bare(p), F.lit("}}\n\n"))), ""),
        F.lit('event: content_block_delta\ndata: {"type":"content_block_delta","index":1,"delta":{"type":"input_json_delta","partial_json":"{\\"a\\":1}"}}\n\nevent: message_stop\ndata: {"type":"message_stop"}'),
    )
    even = F.col("turn") % 2 == 0
    return rows.select(
        F.col("conv_id").cast("string").alias("conv_id"), "turn", F.when(even, "openai_chat").otherwise("anthropic_messages").alias("api"),
        F.when(even, openai).otherwise(anthropic).alias("body"),
    )


def event_counts(spark, sf):
    b = captured_bodies(spark, sf)
    strict = sse.event_rows(b, ["conv_id", "turn"]).groupBy("conv_id", "turn").agg(big(F.count(F.lit(1))).alias("events"), big(F.count("name")).alias("named"))
    tail = sse.event_rows(b, ["conv_id", "turn"], emit_tail=True).groupBy("conv_id", "turn").agg(big(F.count(F.lit(1))).alias("with_tail"), F.max_by("data", "pos").alias("last"))
    return strict.join(tail, ["conv_id", "turn"])


Q_EVENTS = """WITH c AS (SELECT conv_id::VARCHAR AS conv_id, turn, ceil(length(text) / 25.0)::BIGINT AS n FROM conversations)
SELECT conv_id, turn, n + CASE WHEN turn % 2 = 0 THEN 4 ELSE 3 END AS events, CASE WHEN turn % 2 = 0 THEN 0 ELSE n + 3 END AS named,
  n + CASE WHEN turn % 2 = 0 THEN 5 ELSE 4 END AS with_tail, CASE WHEN turn % 2 = 0 THEN '{"cut"' ELSE '{"type":"message_stop"}' END AS last FROM c"""


def pieced_events(spark, sf):
    """The same counts from bodies that were captured in pieces of seven characters, which cut lines, line ends and events anywhere."""
    cut = F.regexp_extract_all("body", F.lit("(?s).{1,7}"), F.lit(0))
    pieces = frozen(unfolded(captured_bodies(spark, sf), ["conv_id", "turn"], cut, "piece", "at"))
    keys = ["conv_id", "turn"]
    strict = sse.pieced_event_rows(pieces, keys, "at").groupBy(*keys).agg(big(F.count(F.lit(1))).alias("events"), big(F.count("name")).alias("named"))
    tail = sse.pieced_event_rows(pieces, keys, "at", emit_tail=True).groupBy(*keys).agg(big(F.count(F.lit(1))).alias("with_tail"), F.max_by("data", "pos").alias("last"))
    return strict.join(tail, keys)


def accumulated_replies(spark, sf):
    b = captured_bodies(spark, sf)
    events = sse.event_rows(b, ["conv_id", "turn", "api"])
    call = F.col("tool_calls")[0]
    return C.accumulated(events).select(
        "conv_id", "turn", "kind", digest_of("text").alias("text"), big(F.size("tool_calls")).alias("calls"), call["id"].alias("id"), call["name"].alias("name"), call["arguments"].alias("arguments")
    )


Q_ACCUMULATED = """SELECT conv_id::VARCHAR AS conv_id, turn, 'completed' AS kind, md5(text) AS text, 1::BIGINT AS calls, 'c1' AS id, 'f' AS name, '{"a":1}' AS arguments FROM conversations"""

QUERIES = {
    "conversation_inputs": (conversation_inputs, Q_INPUTS),
    "expected_replies": (expected_replies, Q_EXPECTED),
    "aligned_slots": (aligned_slots, Q_ALIGNED),
    "first_slot_texts": (first_slot_texts, Q_FIRST),
    "scripted_replies": (scripted_replies, Q_SCRIPTED),
    "replayed_observations": (replayed_observations, Q_OBSERVED),
    "replay_verdicts": (replay_verdicts, Q_VERDICTS),
    "captured_failures": (captured_failures, Q_CAPTURED + " SELECT conv_id, \"check\", turn::BIGINT AS turn FROM r"),
    "captured_failure_lists": (captured_failure_lists, Q_LISTS),
    "captured_verdicts": (captured_verdicts, Q_CAPTURED_VERDICTS),
    "missing_turns": (missing_turns, Q_MISSING),
    "applicability": (applicability, Q_APPLICABLE),
    "scenario_problems": (scenario_problems, Q_PROBLEMS),
    "repeated_ids": (repeated_ids, f"WITH {Q_SCENARIOS} SELECT conv_id AS id, 'id used twice' AS problem FROM sc WHERE kind = 3"),
    "parsed_requests": (parsed_requests, Q_REQUESTS),
    "api_paths": (api_paths, Q_PATHS),
    "parsed_responses": (parsed_responses, Q_RESPONSES),
    "event_counts": (event_counts, Q_EVENTS),
    "pieced_events": (pieced_events, Q_EVENTS),
    "loaded_scenarios": (loaded_scenarios, Q_LOADED),
    "accumulated_replies": (accumulated_replies, Q_ACCUMULATED),
}
