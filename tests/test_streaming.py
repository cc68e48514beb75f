"""Keyed state of streams: what outlives a micro-batch, what a batch touches, and what expires."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sievemask.streaming.holdback import restore_stream, unmask_stream
from sievemask.streaming.masking import mask_stream, read_vault
from sievemask.streaming.state import FIRST_VALUES, Numbers, held_of

MESSAGES = "session string, seq long, text string"
PANS = ["ABCPK1234M", "BCDPL2345N", "CDEPM3456O"]


def arrive(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def masked(spark, folder, out="masked"):
    return {(r["session"], r["seq"]): r[out] for r in spark.read.parquet(folder).collect()}


@pytest.mark.parametrize("idle_ms,second", [(None, "[PAN_2]"), (1, "[PAN_1]")])
def test_numbers_outlive_batches_until_a_session_is_idle(spark, tmp_path, idle_ms, second):
    source, vault, out, mark = (str(tmp_path / x) for x in ("in", "vault", "out", "mark"))
    for seq, pan in enumerate(PANS[:2]):
        stream = arrive(spark, source, [("s", seq, f"PAN {pan} and {pan}"), ("t", seq, f"PAN {PANS[0]}"), ("u", seq, None)], MESSAGES)
        mask_stream(stream, vault, out, mark, idle_ms)
    got = masked(spark, out)
    assert got["s", 0] == "PAN [PAN_1] and [PAN_1]" and got["s", 1] == f"PAN {second} and {second}"
    assert got["t", 0] == got["t", 1] == "PAN [PAN_1]" and got["u", 0] is None
    entries = read_vault(spark, vault).groupBy("session").count().collect()
    assert {r["session"]: r["count"] for r in entries} == {"s": 2, "t": 1 if idle_ms is None else 2}


def test_a_batch_touches_its_own_sessions(spark, tmp_path):
    source, vault, out, mark = (str(tmp_path / x) for x in ("in", "vault", "out", "mark"))
    for batch in range(8):
        rows = [(f"s{batch}-{i}", batch, f"PAN {PANS[0]}") for i in range(20)] + [("shared", batch, f"PAN {PANS[batch % 3]}")]
        stream = arrive(spark, source, rows, MESSAGES)
    query = mask_stream(stream, vault, out, mark)
    seen = [p["stateOperators"][0] for p in query.recentProgress if p["numInputRows"]]
    assert len(seen) == 8
    assert [s["numRowsTotal"] for s in seen] == sorted(s["numRowsTotal"] for s in seen) and seen[-1]["numRowsTotal"] > 300
    assert max(s["numRowsUpdated"] for s in seen) <= 2 * 21  # a value and a counter for each session of the batch
    got = masked(spark, out)
    assert [got["shared", b] for b in range(8)] == [f"PAN [PAN_{b % 3 + 1}]" for b in range(8)]


def test_entries_may_come_as_a_stream(spark, tmp_path):
    texts, entries, out, mark = (str(tmp_path / x) for x in ("texts", "entries", "out", "mark"))
    kinds = "session string, placeholder string, value string"
    for seq, row in enumerate([("s", "[PAN_1]", "one"), ("s", "[PAN_2]", "two")]):
        vault = arrive(spark, entries, [row], kinds)
        stream = arrive(spark, texts, [("s", seq, "[PAN_1] [PAN_2] [PAN_3]"), ("t", seq, "[PAN_1]")], MESSAGES)
        restore_stream(stream, ["seq"], vault, out, mark)
    assert masked(spark, out, "restored") == {("s", 0): "one [PAN_2] [PAN_3]", ("s", 1): "one two [PAN_3]", ("t", 0): "[PAN_1]", ("t", 1): "[PAN_1]"}


def test_a_placeholder_cut_over_batches(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    kinds = "session string, stream string, seq long, chunk string, is_final boolean"
    vault = spark.createDataFrame([("s", "[PAN_1]", "ABC"), ("s", "[PAN_2]", "DEF")], "session string, placeholder string, value string")
    pieces = ["a [P", "AN_", "1] b [", "x [PAN_2]", "", " [PAN_1", ""]
    for seq, piece in enumerate(pieces):
        stream = arrive(spark, source, [("s", "m", seq, piece, seq == len(pieces) - 1)], kinds)
        unmask_stream(stream, vault, out, mark)
    rows = spark.read.parquet(out).orderBy("seq").collect()
    assert "".join(r["restored"] for r in rows) == "a ABC b [x DEF [PAN_1"
    assert [r["released"] for r in rows][:3] == ["a ", "", "[PAN_1] b "]


def test_held_of():
    assert [held_of(s) for s in ("a [P", "a [P]", "[" + "x" * 30, "[" + "x" * 31, "[[", "a[b[c", "")] == ["[P", "", "[" + "x" * 30, "", "[", "[c", ""]


class Calls:
    """State variables in memory that count the messages a processor sends."""

    def __init__(self):
        self.sent, self.held, self.kept, self.one = 0, {}, [], None

    def __getattr__(self, name):
        self.sent += 1
        return {
            "getValue": self.held.get, "updateValue": self.held.__setitem__, "appendList": self.kept.extend, "update": lambda v: setattr(self, "one", v),
            "get": lambda: self.one if not self.kept else iter(self.kept), "iterator": lambda: iter(self.held.items()),
        }[name]


class Handle:
    def __init__(self):
        self.states = []

    def _state(self, *_):
        self.states.append(Calls())
        return self.states[-1]

    getValueState = getListState = getMapState = _state


def test_a_session_takes_few_state_calls():
    numbers, handle = Numbers(None), Handle()
    numbers.init(handle)
    span = Row("session", "seq", "start", "end", "label", "value")
    rows = lambda seq, count: [span("s", seq, i, i + 1, "AB"[i % 2], f"v{i}") for i in reversed(range(count))]
    got = list(numbers.handleInputRows(("s",), iter(rows(0, 20)), None))
    assert [(r["value"], r["n"], r["fresh"]) for r in got] == [(f"v{i}", i // 2 + 1, True) for i in range(20)]
    assert sum(s.sent for s in handle.states) <= 4  # two calls a value, and two a label, before
    got = list(numbers.handleInputRows(("s",), iter(rows(1, 21)), None))
    assert [r["n"] for r in got if r["fresh"]] == [11] and sum(s.sent for s in handle.states) <= 8
    for seq in (2, 3):  # beyond the list every value has an entry of its own
        got = list(numbers.handleInputRows(("s",), iter(rows(seq, FIRST_VALUES + 10)), None))
        assert [r["n"] for r in got] == [i // 2 + 1 for i in range(FIRST_VALUES + 10)]
        assert [r["fresh"] for r in got] == [seq == 2 and i > 20 for i in range(FIRST_VALUES + 10)]
    assert len(handle.states[2].held) == 10
