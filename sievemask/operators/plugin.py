"""A user's own masker and unmasker, one per session, which may remember what it has seen.

Requests are `(session, seq, op, text)` with `op` `mask` or `unmask`. Rows are dealt out by session and sorted by (session, seq); a task goes
through them in Arrow batches and hands each session's requests to a masker of its own, in order. A session of any size passes through in
batches, and only the masker's memory lasts from one to the next. When a session ends its masker is dropped: memory is that of the one active
session. Sessions cannot be split, because each answer may depend on all requests before it; many sessions spread over tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DONE = "status string, result string, message string"


class Masker(Protocol):
    """What a user supplies. `save` and `load` are needed for streams only."""

    def mask(self, text: str) -> str: ...

    def unmask(self, text: str) -> str: ...


def answered(masker: Masker, active: bool, op: str, text: str | None) -> tuple[str, str | None, str | None]:
    """(status, result, message) of a request; whatever foreign code raises is this request's result."""
    try:
        if op not in ("mask", "unmask"):
            raise ValueError(f"unknown op {op}")
        if op == "unmask" and not active:
            raise ValueError("the session has masked nothing yet")
        result = None if text is None else getattr(masker, op)(text)
        if result is not None and not isinstance(result, str):
            raise TypeError(f"{op} gave {type(result).__name__} instead of a text")
        return "done", result, None
    except Exception as error:  # noqa: BLE001
        return "failed", None, f"{type(error).__name__}: {error}"


def answered_by(requests: DataFrame, make: Callable[[], Masker]) -> DataFrame:
    """Adds status, result and message to `(session, seq, op, text, ...)`; `make()` gives a new masker for a session.

    A session is active from its first `mask` on; an `unmask` before fails, as does a request whose code raises. Failures change nothing for
    the requests behind them. Rows without a session are each a session of their own."""
    schema = requests.schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + ", " + DONE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, masker, active = None, None, False
        for batch in batches:
            rows = []
            for session, op, text in zip(*(batch.column(c).to_pylist() for c in ("session", "op", "text")), strict=True):
                if masker is None or session is None or session != current:
                    current, masker, active = session, make(), False
                rows.append(answered(masker, active, op, text))
                active = active or op == "mask"
            columns = [pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "status", "result", "message"])

    # Rows without a session need not meet.
    spread = F.when(F.col("session").isNull(), F.xxhash64("seq", "text")).otherwise(F.xxhash64("session"))
    dealt = requests.withColumn("_deal", spread).repartition("_deal").sortWithinPartitions("session", "seq").drop("_deal")
    return dealt.mapInArrow(run, out)

