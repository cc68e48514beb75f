"""Token counts by section: a document is encoded once, as a whole, and its tokens are attributed to sections by offsets.

A token's span of code points goes from the one that holds its first byte to the one that holds its last. Sections are
intervals that follow each other and cover the text; a sorted search joins spans to them. A token that touches several
sections is allocated by a rule:

* `most`: to the section that holds most of its code points, the earliest of equals (the default);
* `first`: to the section that holds its first code point.

Counts of a document's sections always add up to its tokens.

Defined cases: a null or empty text is one empty section without tokens; empty lines are sections; rows that repeat an id are
counted each on its own; a null id stays null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemask.llm.common import table
from sievemask.llm.tokens import default_path, encoder

SCHEMA = "doc_id long, section long, start long, n_chars long, n_tokens long, n_crossing long"


def line_starts(points: np.ndarray) -> np.ndarray:
    """Sections are lines; a line feed belongs to the line that it ends."""
    starts = np.concatenate(([0], np.flatnonzero(points == 10) + 1))
    return starts[:-1] if len(points) and starts[-1] == len(points) else starts


def attributed(text: str, ids: np.ndarray, sizes: np.ndarray, starts: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of those that touch it also touch another. `starts` are the sections' starts, 0 first."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    none = np.zeros(len(starts), np.int64)
    if not len(ids):
        return none, none
    point = np.cumsum((data & 0xC0) != 0x80) - 1  # code point of each byte
    ends = np.cumsum(sizes[ids])
    if ends[-1] != len(data):
        raise ValueError("the tokens do not spell the text")
    first, last = point[ends - sizes[ids]], point[ends - 1]
    low = np.searchsorted(starts, first, side="right") - 1
    high = np.searchsorted(starts, last, side="right") - 1
    owner = low.copy()
    crossing = np.zeros(len(starts), np.int64)
    stops = np.append(starts[1:], int(point[-1]) + 1)
    for i in np.flatnonzero(low != high).tolist():
        touched = np.arange(low[i], high[i] + 1)
        inside = np.minimum(stops[touched], last[i] + 1) - np.maximum(starts[touched], first[i])
        crossing[touched[inside > 0]] += 1
        if rule == "most":
            owner[i] = touched[inside.argmax()]
    return np.bincount(owner, minlength=len(starts)), crossing


def section_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections: Callable[[np.ndarray], np.ndarray] = line_starts, rule: str = "most",
    tokenizer_path: str | None = None,
) -> DataFrame:
    """One row per section: doc_id, section (from 0), start, n_chars, n_tokens, n_crossing. Nothing is shuffled."""
    if rule not in ("most", "first"):
        raise ValueError(f"no rule {rule}")
    path = tokenizer_path or default_path()
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        sizes = encode.sizes()
        for batch in batches:
            held, n = [], 0
            for name, value in zip(batch.column(0), batch.column(1), strict=True):
                text = value.as_py() or ""
                points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                starts = sections(points)
                tokens, crossing = attributed(text, np.frombuffer(encode.ids(text), "<u4"), sizes, starts, rule)
                held.append((np.full(len(starts), -1 if name.as_py() is None else name.as_py()), name.as_py() is None, starts, np.diff(np.append(starts, len(points))), tokens, crossing))
                n += len(starts)
                if n > 100_000:
                    yield _batch(held, names)
                    held, n = [], 0
            if held:
                yield _batch(held, names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(count, SCHEMA)


def _batch(held: list[tuple], names: list[str]) -> pa.RecordBatch:
    ids = np.concatenate([h[0] for h in held])
    missing = np.concatenate([np.full(len(h[2]), h[1]) for h in held])
    number = np.concatenate([np.arange(len(h[2])) for h in held])
    columns = [pa.array(ids, pa.int64(), mask=missing), pa.array(number, pa.int64())]
    columns += [pa.array(np.concatenate([h[k] for h in held]), pa.int64()) for k in (2, 3, 4, 5)]
    return pa.RecordBatch.from_arrays(columns, names)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op6_token_counts": (op6_token_counts, None)}
