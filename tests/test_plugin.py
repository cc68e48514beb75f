"""A user's masker, event streams in pieces, and lines of files in many splits."""

import pytest
from pyspark.sql import functions as F

from sievemask.operators.plugin import answered_by
from sievemask.plans.masking import Stand
from sievemask.sources import samples as SRC
from sievemask.sources.sse import event_rows, pieced_event_rows


def test_user_masker(spark):
    class Moody(Stand):
        def mask(self, text):
            if text == "boom":
                raise RuntimeError("no")
            return 7 if text == "seven" else Stand.mask(self, text)

    rows = [
        ("s", 0, "unmask", "ZZZZZ0001Z"), ("s", 1, "mask", "a ABCDE1234F"), ("s", 2, "mask", "boom"), ("s", 3, "unmask", "ZZZZZ0001Z ZZZZZ0002Z"), ("s", 4, "mask", "seven"),
        ("s", 5, "mask", None), ("s", 6, "look", "x"), ("t", 0, "mask", "ABCDE1234F FGHIJ1234K ABCDE1234F"), ("t", 1, "unmask", "ZZZZZ0002Z"), (None, 0, "mask", "ABCDE1234F"), (None, 1, "unmask", "ZZZZZ0001Z"),
    ]
    rows += [("hot", i, "mask", f"{chr(65 + i % 26)}BCDE1234F") for i in range(30_000)]  # more than one batch
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "session string, seq long, op string, text string, _deal long").repartition(5)
    got = {(r["session"], r["seq"]): (r["status"], r["result"], r["message"]) for r in answered_by(df.drop("_deal"), Moody).collect()}
    assert got["s", 0] == ("failed", None, "ValueError: the session has masked nothing yet") and got["s", 1] == ("done", "a ZZZZZ0001Z", None)
    assert got["s", 2] == ("failed", None, "RuntimeError: no") and got["s", 3][1] == "ABCDE1234F ZZZZZ0002Z" and got["s", 4][2].startswith("TypeError")
    assert got["s", 5] == ("done", None, None) and got["s", 6][0] == "failed" and got["t", 0][1] == "ZZZZZ0001Z ZZZZZ0002Z ZZZZZ0001Z" and got["t", 1][1] == "FGHIJ1234K"
    assert got[None, 0][1] == "ZZZZZ0001Z" and got[None, 1][0] == "failed"
    assert [got["hot", i][1] for i in (0, 25, 26, 29_999)] == [f"ZZZZZ{n:04d}Z" for n in (1, 26, 1, 29_999 % 26 + 1)]


BODIES = [
    "event: a\ndata: 1\n\ndata: 2\r\n\r\ndata:3\n\n\n\n: c\n\nevent: only\n\ndata: x\ndata:  y\n\n\ndata: z\n\ndata: cut", "\n\n\n", "\n", "data: q\n\n", "", "data: é\n\n\n\ndata: 2\n", "x",
]


@pytest.mark.parametrize("tail", [False, True])
def test_events_of_bodies_cut_anywhere(spark, tail):
    whole = spark.createDataFrame(list(enumerate(BODIES)), "id int, body string")
    want = {i: [] for i in range(len(BODIES))}
    for r in event_rows(whole, ["id"], emit_tail=tail).orderBy("id", "pos").collect():
        want[r["id"]].append((r["pos"], r["name"], r["data"]))
    rows = []
    for i, body in enumerate(BODIES):
        for at in range(len(body) + 1):
            rows += [(i, f"two/{at}", 0, body[:at]), (i, f"two/{at}", 1, body[at:])]
        for size in (1, 2, 3, 5):
            rows += [(i, f"each/{size}", k, body[k * size : (k + 1) * size]) for k in range(-(-len(body) // size))]
    got = {(i, how): [] for i, how, *_ in rows}
    df = spark.createDataFrame(rows, "id int, how string, at int, piece string").repartition(4)
    for r in pieced_event_rows(df, ["id", "how"], "at", emit_tail=tail).orderBy("id", "how", "pos").collect():
        got[r["id"], r["how"]].append((r["pos"], r["name"], r["data"]))
    assert all(events == want[i] for (i, _), events in got.items())


def test_line_numbers_over_splits(spark, tmp_path):
    good = '{"id":"%d","text":"t","labels":{"kind":"negative","spans":[],"decoy":null},"lang":"en","difficulty":"easy","source":"template","generator_version":"1"}'
    for name, bad in (("a", {700, 1500}), ("b", {3}), ("c", set())):
        lines = ["" if i % 7 == 0 else "{oops" if i in bad else good % i for i in range(1, 2001)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        assert SRC.lines(spark, str(tmp_path)).select("file", "block").distinct().count() > 30
        _, rejected = SRC.read_samples(spark, str(tmp_path))
        rows = rejected.select(F.regexp_extract("file", r"(\w)\.jsonl", 1).alias("f"), "line_no").collect()
        first = SRC.first_rejected(rejected).select(F.regexp_extract("file", r"(\w)\.jsonl", 1).alias("f"), "line_no", "reason").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    # 700 is blank: every seventh line is.
    assert {(r["f"], r["line_no"]) for r in rows} == {("a", 1500), ("b", 3)}
    assert {tuple(r) for r in first} == {("a", 1500, "does not parse"), ("b", 3, "does not parse")}


def test_small_bodies_are_pieced_in_a_task(spark, monkeypatch):
    """Both ways to piece bodies together give the rows of the whole body; small ones are not laid out over tasks."""
    from pyspark.sql import functions as F

    from sievemask.sources import sse

    body = "event: a\r\n\r\n\ndata: 1\n\n\n\n: c\n\ndata: x\ndata: y\r\n\r\nevent: z\ndata: tail"
    whole = spark.createDataFrame([(i, body[i:]) for i in range(12)], "id long, body string")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("body") - 1) / 3).cast("int")), lambda i: F.substring("body", i * 3 + 1, F.lit(3)))
    pieces = whole.select("id", F.posexplode(cut).alias("at", "piece"))
    for tail in (False, True):
        want = sorted(tuple(r) for r in event_rows(whole, ["id"], emit_tail=tail).select("id", "pos", "name", "data").collect() if not tail)
        spread = sorted(tuple(r) for r in sse._pieced(pieces, ["id"], "at", "piece", tail, True).collect())
        with monkeypatch.context() as m:
            m.setattr(sse, "running_total", None)
            m.setattr(sse, "numbered", None)
            got = sorted(tuple(r) for r in pieced_event_rows(pieces, ["id"], "at", emit_tail=tail).collect())
        assert got == spread and (tail or got == want)
