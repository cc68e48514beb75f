"""Queries for masking and restoring, on conversations with identifiers written into their messages."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from sievemask.corpus.draws import digits, letters
from sievemask.functions.spans import bound, unfolded
from sievemask.operators import chat as C
from sievemask.operators import holdback as H
from sievemask.operators import plugin as P
from sievemask.operators import vault as V
from sievemask.plans.common import big, digest_of, q_digits, q_letters, scratch, spread, table
from sievemask.session import frozen
from sievemask.streaming import holdback as SH
from sievemask.streaming import masking as SM


def _pan(key, name):
    return F.concat(letters(key, name + "a", 3), F.lit("PS"), digits(key, name + "b", 4), letters(key, name + "c", 1))


def _phone(key, name):
    return F.concat(F.lit("9"), digits(key, name, 9))


def messages(spark, sf, shared: bool = False):
    """`(session, seq, conv_id, turn, text)`: two PANs and a phone number come and go over a conversation's turns.
    With `shared`, all conversations are one session."""
    key = F.concat(F.lit("chat/"), F.col("conv_id").cast("string"))
    pan = F.when(F.col("turn") % 3 == 0, _pan(key, "p")).otherwise(_pan(key, "q"))
    text = F.concat(
        "text", F.lit("\nPAN "), pan, F.when(F.col("turn") % 2 == 1, F.concat(F.lit(", call "), _phone(key, "m"))).otherwise(""),
        F.lit(". [end]"),
    )
    return spread(table(spark, sf, "conversations")).select(
        (F.lit("all") if shared else F.col("conv_id").cast("string")).alias("session"),
        (F.struct("conv_id", "turn") if shared else F.col("turn")).alias("seq"), "conv_id", "turn", text.alias("text"),
    )


Q_K = "'chat/' || conv_id"


def _q_pan(name):
    return f"({q_letters(Q_K, name + 'a', 3)} || 'PS' || {q_digits(Q_K, name + 'b', 4)} || {q_letters(Q_K, name + 'c', 1)})"


Q_MESSAGES = f"""
m AS (SELECT conv_id, turn, role, text AS body, CASE WHEN turn % 3 = 0 THEN {_q_pan('p')} ELSE {_q_pan('q')} END AS pan,
  CASE WHEN turn % 2 = 1 THEN '9' || {q_digits(Q_K, 'm', 9)} END AS phone FROM conversations),
texts AS (SELECT *, body || chr(10) || 'PAN ' || pan || coalesce(', call ' || phone, '') || '. [end]' AS text FROM m)"""


def _q_vault(session: str) -> str:
    """Distinct values by first appearance within `session`."""
    return f"""
v AS (SELECT {session} AS session, 'PAN' AS label, pan AS value, min({{'c': conv_id, 't': turn}}) AS first FROM m GROUP BY 1, 2, 3
  UNION ALL SELECT {session}, 'PHONE', phone, min({{'c': conv_id, 't': turn}}) FROM m WHERE phone IS NOT NULL GROUP BY 1, 2, 3),
vault AS (SELECT *, row_number() OVER (PARTITION BY session, label ORDER BY first) AS n FROM v),
named AS (SELECT *, '[' || label || '_' || n || ']' AS placeholder FROM vault)"""


def _q_masked(session: str) -> str:
    return f"""
masked AS (SELECT m.*, text, body || chr(10) || 'PAN ' || p.placeholder || coalesce(', call ' || q.placeholder, '') || '. [end]' AS masked
  FROM texts m JOIN named p ON p.label = 'PAN' AND p.session = {session} AND p.value = m.pan
  LEFT JOIN named q ON q.label = 'PHONE' AND q.session = {session} AND q.value = m.phone)"""


def vault_of_sessions(spark, sf):
    vault = V.build_vault(V.session_spans(messages(spark, sf)))
    return vault.select("session", "label", "value", big("n").alias("n"), "placeholder")


Q_VAULT = f"WITH {Q_MESSAGES}, {_q_vault('conv_id::VARCHAR')} SELECT session, label, value, n, placeholder FROM named"


def vault_of_one_session(spark, sf):
    vault = V.build_vault(V.session_spans(messages(spark, sf, shared=True)))
    return vault.select("session", "label", "value", big("n").alias("n"), "placeholder")


Q_SHARED_VAULT = f"WITH {Q_MESSAGES}, {_q_vault(chr(39) + 'all' + chr(39))} SELECT session, label, value, n, placeholder FROM named"


def masked_messages(spark, sf):
    masked, _ = V.mask(messages(spark, sf))
    return masked.select("conv_id", "turn", digest_of("masked").alias("masked"))


Q_MASKED = f"""WITH {Q_MESSAGES}, {_q_vault('conv_id::VARCHAR')}, {_q_masked('m.conv_id::VARCHAR')}
SELECT conv_id, turn, md5(masked) AS masked FROM masked"""


def unmasked_messages(spark, sf):
    """Masked texts restored, and the same texts under another session, which must not restore them."""
    masked, vault = V.mask(messages(spark, sf))
    own = masked.select("session", "seq", "conv_id", "turn", F.col("masked").alias("text"))
    other = own.withColumn("session", F.concat(F.lit("x"), "session"))
    back = V.unmask(own, vault).select("conv_id", "turn", digest_of("unmasked").alias("own"))
    kept = V.unmask(other, vault).select("conv_id", "turn", digest_of("unmasked").alias("other"))
    return back.join(kept, ["conv_id", "turn"])


Q_UNMASKED = f"""WITH {Q_MESSAGES}, {_q_vault('conv_id::VARCHAR')}, {_q_masked('m.conv_id::VARCHAR')}
SELECT conv_id, turn, md5(text) AS own, md5(masked) AS other FROM masked"""


def redacted_messages(spark, sf):
    return V.redact(messages(spark, sf)).select("conv_id", "turn", digest_of("redacted").alias("redacted"))


Q_REDACTED = f"""WITH {Q_MESSAGES} SELECT conv_id, turn,
md5(body || chr(10) || 'PAN <PAN>' || CASE WHEN phone IS NOT NULL THEN ', call <PHONE>' ELSE '' END || '. [end]') AS redacted FROM texts"""


def swapped_values(spark, sf):
    """Stand-ins of one's own making instead of bracketed placeholders, and back."""
    rows = messages(spark, sf)
    spans = V.session_spans(rows)

    def at_least_four(n):
        return F.lpad(n.cast("string"), F.greatest(F.lit(4), F.length(n.cast("string"))), F.lit("0"))

    def stand_in(label, n):
        return F.when(label == "PAN", F.concat(F.lit("AAAPA"), at_least_four(n), F.lit("Z"))).otherwise(
            F.concat(F.lit("555-"), at_least_four(n))
        )

    vault = V.build_vault(spans, stand_in)
    swapped = V.mask_with(rows, spans, vault)
    texts = swapped.select("session", "seq", "conv_id", "turn", F.col("masked").alias("text"))
    back = V.unmask(texts, vault, pattern=r"AAAPA[0-9]{4,}Z|555-[0-9]{4,}")
    return back.select("conv_id", "turn", digest_of("text").alias("swapped"), digest_of("unmasked").alias("restored"))


Q_SWAPPED = f"""WITH {Q_MESSAGES}, {_q_vault('conv_id::VARCHAR')}
SELECT m.conv_id, m.turn, md5(body || chr(10) || 'PAN AAAPA' || lpad(p.n::VARCHAR, greatest(4, length(p.n::VARCHAR))::INT, '0') || 'Z' || coalesce(', call 555-' || lpad(q.n::VARCHAR, greatest(4, length(q.n::VARCHAR))::INT, '0'), '') || '. [end]') AS swapped,
  md5(text) AS restored FROM texts m JOIN named p ON p.label = 'PAN' AND p.session = m.conv_id::VARCHAR AND p.value = m.pan
  LEFT JOIN named q ON q.label = 'PHONE' AND q.session = m.conv_id::VARCHAR AND q.value = m.phone"""


def _bodies(spark, sf):
    """One chat request per message: protocol fields, a string and a block as content."""
    rows = messages(spark, sf)
    content = F.when(F.col("turn") % 2 == 0, F.to_json(F.array("text"))).otherwise(
        F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))))
    )
    inner = F.when(F.col("turn") % 2 == 0, F.expr("substring(content, 2, length(content) - 2)")).otherwise(F.col("content"))
    return rows.withColumn("content", content).select(
        "session", "seq", "conv_id", "turn",
        F.concat(
            F.lit('{"model":"m","temperature":0.5,"system":"be brief","messages":[{"role":"user","id":"9876543210","content":'),
            inner, F.lit("}]}"),
        ).alias("body"),
    )


def masked_requests(spark, sf):
    masked, _ = C.mask_requests(_bodies(spark, sf))
    content = F.coalesce(
        F.get_json_object("masked_body", "$.messages[0].content[0].text"), F.get_json_object("masked_body", "$.messages[0].content")
    )
    return masked.select(
        "conv_id", "turn", digest_of(content).alias("content"), F.get_json_object("masked_body", "$.messages[0].id").alias("id"),
        F.get_json_object("masked_body", "$.model").alias("model"),
    )


Q_REQUESTS = f"""WITH {Q_MESSAGES}, {_q_vault('conv_id::VARCHAR')}, {_q_masked('m.conv_id::VARCHAR')}
SELECT conv_id, turn, md5(masked) AS content, '9876543210' AS id, 'm' AS model FROM masked"""


def restored_responses(spark, sf):
    """Replies that quote the masked text, restored with the request's vault."""
    masked, vault = V.mask(messages(spark, sf))
    reply = F.concat(
        F.lit('{"model":"[PAN_1]","choices":[{"message":{"role":"assistant","content":'), F.expr("substring(q, 2, length(q) - 2)"), F.lit("}}]}")
    )
    bodies = masked.withColumn("q", F.to_json(F.array("masked"))).select("session", "seq", "conv_id", "turn", reply.alias("body"))
    done = C.unmask_responses(bodies, vault)
    return done.select(
        "conv_id", "turn", digest_of(F.get_json_object("restored_body", "$.choices[0].message.content")).alias("content"),
        F.get_json_object("restored_body", "$.model").alias("model"),
    )


Q_RESPONSES = f"WITH {Q_MESSAGES} SELECT conv_id, turn, md5(text) AS content, '[PAN_1]' AS model FROM texts"

WIDTH = 7


def _chunks(spark, sf):
    """Masked messages cut into seven-character chunks, the last one final."""
    masked, vault = V.mask(messages(spark, sf))

    def cut(m):
        n = F.ceil(F.length(m) / WIDTH).cast("int")
        part = lambda i, at: F.struct(F.substring(m, i * WIDTH + 1, F.lit(WIDTH)).alias("chunk"), (at == n - 1).alias("is_final"))
        return F.transform(F.sequence(F.lit(0), n - 1), part)

    pieces = unfolded(masked, ["session", F.col("turn").cast("string").alias("stream"), "conv_id", "turn"], bound(F.col("masked"), cut), "c", "seq")
    chunks = pieces.select("session", "stream", "conv_id", "turn", big("seq").alias("seq"), "c.*")
    # Stands for a captured table: written once, then read by every branch of the query.
    return frozen(chunks), vault


Q_CHUNKS = f"""WITH {Q_MESSAGES}, {_q_vault('conv_id::VARCHAR')}, {_q_masked('m.conv_id::VARCHAR')},
c AS (SELECT conv_id, turn, masked, unnest(range(ceil(length(masked) / {WIDTH}.0)::BIGINT)) AS seq FROM masked),
d AS (SELECT *, least((seq + 1) * {WIDTH}, length(masked)) AS upto, (seq + 1) * {WIDTH} >= length(masked) AS is_final FROM c),
h AS (SELECT *, CASE WHEN is_final THEN 0 ELSE length(regexp_extract(masked[1:upto], '(\\[[^\\[\\]]{{0,30}})$', 1, 's')) END AS held,
  CASE WHEN seq = 0 THEN 0 ELSE length(regexp_extract(masked[1:seq * {WIDTH}], '(\\[[^\\[\\]]{{0,30}})$', 1, 's')) END AS held_before FROM d)
SELECT conv_id, turn, seq, masked[(seq * {WIDTH} - held_before + 1):(upto - held)] AS released FROM h"""


def released_chunks(spark, sf):
    chunks, _ = _chunks(spark, sf)
    return H.released(chunks).select("conv_id", "turn", "seq", "released")


def restored_streams(spark, sf):
    """Chunks restored one by one, read back as whole texts."""
    chunks, vault = _chunks(spark, sf)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "restored"))), lambda x: x["restored"]), "")
    return H.restored_chunks(chunks, vault).groupBy("conv_id", "turn").agg(digest_of(whole).alias("text"))


Q_RESTORED = f"WITH {Q_MESSAGES} SELECT conv_id, turn, md5(text) AS text FROM texts"


def _arriving(spark, rows, schema, parts, read):
    """Rows that arrive in parts: each is appended to a folder, then `read` drains the stream of that folder."""
    source = scratch(spark, "arriving")
    for part in parts:
        rows.where(part).write.mode("append").parquet(source)
        read(spark.readStream.schema(schema).parquet(source))


def streamed_unmask(spark, sf):
    """The hold-back rule over micro-batches that each hold a part of every stream, then restored from the vault."""
    chunks, vault = _chunks(spark, sf)
    out, mark = (scratch(spark, f"chunks-{x}") for x in ("out", "mark"))
    slim = chunks.select("session", "stream", "seq", "chunk", "is_final")
    parts = [F.col("seq") < 7, F.col("seq").between(7, 19), F.col("seq") >= 20]
    _arriving(spark, slim, slim.schema, parts, lambda stream: SH.unmask_stream(stream, vault, out, mark))
    done = spark.read.parquet(out)
    whole = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", c))), lambda x: x[c]), "")
    return done.groupBy(F.col("session").cast("long").alias("conv_id"), F.col("stream").cast("long").alias("turn")).agg(
        digest_of(whole("released")).alias("released"), digest_of(whole("restored")).alias("restored")
    )


Q_STREAMED_UNMASK = f"""WITH {Q_MESSAGES}, {_q_vault('conv_id::VARCHAR')}, {_q_masked('m.conv_id::VARCHAR')}
SELECT conv_id, turn, md5(masked) AS released, md5(text) AS restored FROM masked"""


def streamed_masking(spark, sf):
    """Messages masked batch by batch; the numbers of a session outlive the batches."""
    vault, out, mark = (scratch(spark, f"mask-{x}") for x in ("vault", "out", "mark"))
    rows = messages(spark, sf)
    parts = [F.col("turn") < 3, F.col("turn") >= 3]
    _arriving(spark, rows, rows.schema, parts, lambda stream: SM.mask_stream(stream, vault, out, mark))
    return spark.read.parquet(out).select("conv_id", "turn", digest_of("masked").alias("masked"))


def tolerant_requests(spark, sf):
    """Requests with null and broken bodies among them: each fails alone, and nothing of it goes on."""
    k = (F.col("conv_id") * 7 + F.col("turn")) % 5
    body = F.when(k == 0, F.expr("substring(body, 1, length(body) - 3)")).when(k == 1, None).when(k == 2, F.concat(F.lit("["), "body", F.lit("]"))).otherwise(F.col("body"))
    masked, _ = C.mask_requests(_bodies(spark, sf).withColumn("body", body))
    raw = F.coalesce(F.col("masked_body").rlike("[A-Z]{3}PS[0-9]{4}[A-Z]"), F.lit(False))
    return masked.select("conv_id", "turn", "status", F.col("masked_body").isNull().alias("withheld"), raw.alias("leaks"))


Q_TOLERANT = """SELECT conv_id, turn, CASE WHEN (conv_id * 7 + turn) % 5 < 3 THEN 'failed' ELSE 'done' END AS status, (conv_id * 7 + turn) % 5 < 3 AS withheld, false AS leaks FROM conversations"""


def _events(spark, sf, api):
    """Masked messages as streamed reply events: text deltas and tool-argument deltas of the same text."""
    chunks, vault = _chunks(spark, sf)
    piece = F.to_json(F.array("chunk"))
    bare = F.expr("substring(p, 2, length(p) - 2)")
    rows = chunks.withColumn("p", piece)
    conv = F.concat("session", F.lit("/"), "stream")
    if api == "openai_chat":
        body = F.concat(
            F.lit('{"choices":[{"index":0,"delta":{"content":'), bare,
            F.lit(',"tool_calls":[{"index":1,"function":{"arguments":'), bare, F.lit('}}]},"finish_reason":null}]}'),
        )
        deltas = rows.select("session", conv.alias("conv_id"), F.col("seq").alias("pos"), body.alias("data"))
        last = F.lit('{"choices":[{"index":0,"delta":{},"finish_reason":"stop"}]}')
        ends = rows.where("is_final").select("session", conv.alias("conv_id"), (F.col("seq") + 1).alias("pos"), last.alias("data"))
        return frozen(deltas.unionByName(ends)), vault
    body = lambda kind, field, i: F.concat(F.lit(f'{{"type":"content_block_delta","index":{i},"delta":{{"type":"{kind}","{field}":'), bare, F.lit("}}"))
    events = F.array(
        F.struct((F.col("seq") * 2).alias("pos"), body("text_delta", "text", 0).alias("data")),
        F.struct((F.col("seq") * 2 + 1).alias("pos"), body("input_json_delta", "partial_json", 1).alias("data")),
    )
    stops = F.array(
        *[F.struct((F.col("seq") * 2 + 2 + i).alias("pos"), F.lit(f'{{"type":"content_block_stop","index":{i}}}').alias("data")) for i in (0, 1)]
    )
    both = rows.select(
        "session", conv.alias("conv_id"), F.explode(F.when(F.col("is_final"), F.concat(events, stops)).otherwise(events)).alias("e")
    ).select("session", "conv_id", "e.*")
    return frozen(both), vault


def _restored_deltas(spark, sf, api):
    events, vault = _events(spark, sf, api)
    whole = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("part"), F.col("text")))), lambda x: x["text"]), ""
    )
    return H.restored_deltas(events, vault, api).groupBy("conv_id", "stream").agg(digest_of(whole).alias("text"))


def openai_deltas(spark, sf):
    return _restored_deltas(spark, sf, "openai_chat")


def anthropic_deltas(spark, sf):
    return _restored_deltas(spark, sf, "anthropic_messages")


def _streamed_deltas(spark, sf, api):
    """The same over micro-batches that cut every reply: what is held, and what its end flushes, is remembered between them."""
    events, vault = _events(spark, sf, api)
    out, mark = (scratch(spark, f"deltas-{x}") for x in ("out", "mark"))
    parts = [F.col("pos") < 9, F.col("pos").between(9, 30), F.col("pos") > 30]
    _arriving(spark, events, events.schema, parts, lambda stream: SH.restore_delta_stream(stream, vault, api, out, mark))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part", "restored"))), lambda x: x["restored"]), "")
    return spark.read.parquet(out).groupBy("conv_id", "stream").agg(digest_of(whole).alias("text"))


def streamed_openai_deltas(spark, sf):
    return _streamed_deltas(spark, sf, "openai_chat")


def streamed_anthropic_deltas(spark, sf):
    return _streamed_deltas(spark, sf, "anthropic_messages")


def _q_deltas(first: str, second: str) -> str:
    return f"""WITH {Q_MESSAGES} SELECT conv_id || '/' || turn AS conv_id, unnest(['{first}', '{second}']) AS stream, md5(text) AS text FROM texts"""


class Stand:
    """A masker with a memory: identifiers become made-up ones, numbered in the order they come."""

    SHAPE, MADE = re.compile(r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"), re.compile(r"\bZZZZZ[0-9]{4}Z\b")

    def __init__(self):
        self.of, self.back = {}, {}

    def mask(self, text):
        return self.SHAPE.sub(lambda m: self._made(m.group()), text)

    def _made(self, value):
        if value not in self.of:
            self.of[value] = f"ZZZZZ{len(self.of) + 1:04d}Z"
            self.back[self.of[value]] = value
        return self.of[value]

    def unmask(self, text):
        return self.MADE.sub(lambda m: self.back.get(m.group(), m.group()), text)

    def save(self):
        return json.dumps(self.of).encode()

    def load(self, data):
        self.of = json.loads(data)
        self.back = {made: value for value, made in self.of.items()}


def _requests(spark, sf):
    """Each turn is masked, then a reply that names the first two stand-ins is unmasked; a request before all others finds no session."""
    rows = messages(spark, sf)
    asked = F.array(
        F.struct((F.col("turn") * 2).alias("seq"), F.lit("mask").alias("op"), F.col("text")),
        F.struct((F.col("turn") * 2 + 1).alias("seq"), F.lit("unmask").alias("op"), F.lit("ZZZZZ0001Z, ZZZZZ0002Z").alias("text")),
    )
    early = F.array(F.struct(F.lit(-1).cast("long").alias("seq"), F.lit("unmask").alias("op"), F.lit("ZZZZZ0001Z").alias("text")))
    asked = F.when(F.col("turn") == 0, F.concat(early, asked)).otherwise(asked)
    return rows.select("session", "conv_id", F.explode(asked).alias("r")).select("session", "conv_id", big("r.seq").alias("seq"), "r.op", "r.text")


def user_masking(spark, sf):
    """A user's masker that remembers, per session and in turn order."""
    return P.answered_by(_requests(spark, sf), Stand).select("conv_id", "seq", "op", "status", digest_of("result").alias("result"), "message")


def streamed_user_masking(spark, sf):
    """The same over micro-batches that cut every session."""
    rows = _requests(spark, sf).select("session", "seq", "op", "text")
    out, mark = (scratch(spark, f"user-{x}") for x in ("out", "mark"))
    parts = [F.col("seq") < 2, F.col("seq").between(2, 5), F.col("seq") > 5]
    _arriving(spark, rows, rows.schema, parts, lambda stream: SM.answer_stream(stream, Stand, out, mark))
    return spark.read.parquet(out).select(F.col("session").cast("long").alias("conv_id"), "seq", "op", "status", digest_of("result").alias("result"), "message")


_Q_KNOWN = "CASE WHEN {n} IN (SELECT n FROM pans p WHERE p.conv_id = m.conv_id AND p.first <= m.turn) THEN (SELECT value FROM pans p WHERE p.conv_id = m.conv_id AND p.n = {n}) ELSE 'ZZZZZ000{n}Z' END"
Q_USER = f"""WITH {Q_MESSAGES}, pans AS (SELECT conv_id, pan AS value, min(turn) AS first, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) AS n FROM m GROUP BY 1, 2)
SELECT conv_id, turn * 2 AS seq, 'mask' AS op, 'done' AS status, md5(replace(text, pan, 'ZZZZZ000' || (SELECT n FROM pans p WHERE p.conv_id = t.conv_id AND p.value = t.pan) || 'Z')) AS result, NULL::VARCHAR AS message FROM texts t
UNION ALL SELECT conv_id, turn * 2 + 1, 'unmask', 'done', md5({_Q_KNOWN.format(n=1)} || ', ' || {_Q_KNOWN.format(n=2)}), NULL FROM m
UNION ALL SELECT conv_id, -1, 'unmask', 'failed', NULL, 'ValueError: the session has masked nothing yet' FROM m WHERE turn = 0"""


QUERIES = {
    "user_masking": (user_masking, Q_USER),
    "streamed_user_masking": (streamed_user_masking, Q_USER),
    "vault_of_sessions": (vault_of_sessions, Q_VAULT),
    "vault_of_one_session": (vault_of_one_session, Q_SHARED_VAULT),
    "masked_messages": (masked_messages, Q_MASKED),
    "unmasked_messages": (unmasked_messages, Q_UNMASKED),
    "redacted_messages": (redacted_messages, Q_REDACTED),
    "swapped_values": (swapped_values, Q_SWAPPED),
    "masked_requests": (masked_requests, Q_REQUESTS),
    "restored_responses": (restored_responses, Q_RESPONSES),
    "released_chunks": (released_chunks, Q_CHUNKS),
    "restored_streams": (restored_streams, Q_RESTORED),
    "streamed_unmask": (streamed_unmask, Q_STREAMED_UNMASK),
    "streamed_masking": (streamed_masking, Q_MASKED),
    "tolerant_requests": (tolerant_requests, Q_TOLERANT),
    "openai_deltas": (openai_deltas, _q_deltas("content", "args:1")),
    "anthropic_deltas": (anthropic_deltas, _q_deltas("block:0:text", "block:1:json")),
    "streamed_openai_deltas": (streamed_openai_deltas, _q_deltas("content", "args:1")),
    "streamed_anthropic_deltas": (streamed_anthropic_deltas, _q_deltas("block:0:text", "block:1:json")),
}
