"""Streaming mask: a session's numbers are keyed state, its entries go to a table, its texts are masked by a join with the batch's own spans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from sievemask.functions import recognizers
from sievemask.operators.detection import span_rows
from sievemask.operators.plugin import answered
from sievemask.operators.vault import placeholder, with_replacements
from sievemask.streaming.state import NUMBERED, Expiring, Numbers, drain, in_order, remembered

VAULT = "session string, label string, value string, seq long, start int, n long, placeholder string"


def read_vault(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{VAULT}, batch long").parquet(path)


def mask_stream(messages: DataFrame, vault_path: str, out_path: str, checkpoint: str, idle_ms: int | None = None):
    """Drains the available `(session, seq, text, ...)` messages, `seq` being a number; output and vault entries are parquet folders by batch.

    A session that no span has come for in `idle_ms` milliseconds (None: never) is forgotten: its values are numbered from 1 again, as those of
    a new session. Its entries stay in the table."""
    rows = messages.select(F.col("session").alias("session"), F.col("seq").cast("long").alias("seq"), "text")
    spans = span_rows(rows, ["session", "seq"]).select("session", "seq", "start", "end", "label", "value")
    numbered = remembered(spans, ["session"], Numbers(idle_ms), NUMBERED, idle_ms).withColumn("placeholder", placeholder(F.col("label"), F.col("n")))

    def write(of: dict[str, DataFrame], batch_id: int) -> None:
        entries = of["spans"].where("fresh").select("session", "label", "value", "seq", "start", "n", "placeholder")
        entries.write.mode("overwrite").parquet(f"{vault_path}/batch={batch_id}")
        replaced = of["spans"].select("session", "seq", "start", "end", F.col("placeholder").alias("replacement"))
        masked = with_replacements(of["messages"], replaced, recognizers.may_hold(F.col("text")), "masked")
        masked.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return drain({"spans": numbered, "messages": messages}, write, checkpoint)


ANSWERED = "session string, seq long, op string, status string, result string, message string"


class UserMasker(Expiring):
    """A user's masker, kept between micro-batches as the bytes its `save` gives and `load` takes."""

    def __init__(self, make: Callable[[], object], idle_ms: int | None):
        super().__init__(idle_ms)
        self._make = make

    def states(self, handle: StatefulProcessorHandle) -> list:
        self._saved = handle.getValueState("saved", "active boolean, memory binary")
        return [self._saved]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self.touch(timerValues)
        masker, active = self._make(), False
        if self._saved.exists():
            active, memory = self._saved.get()
            masker.load(bytes(memory))
        out = []
        for r in in_order(rows, "seq"):
            status, result, message = answered(masker, active, r["op"], r["text"])
            out.append(Row(session=r["session"], seq=r["seq"], op=r["op"], status=status, result=result, message=message))
            active = active or r["op"] == "mask"
        self._saved.update((active, masker.save()))
        yield from out


def answer_stream(requests: DataFrame, make: Callable[[], object], out_path: str, checkpoint: str, idle_ms: int | None = None):
    """Drains the available `(session, seq, op, text)` requests through a user's masker per session (`operators.plugin.Masker`, with `save` and
    `load`), whose memory outlives the micro-batches. A micro-batch's requests of one session are handled by one task, in order."""
    rows = requests.where("session is not null").select("session", F.col("seq").cast("long").alias("seq"), "op", "text")
    answers = remembered(rows, ["session"], UserMasker(make, idle_ms), ANSWERED, idle_ms)

    def write(of: dict[str, DataFrame], batch_id: int) -> None:
        of["answers"].write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return drain({"answers": answers}, write, checkpoint)
