"""Shared pieces of the registered queries: table access, and SQL text for the checking engine."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemask.functions.checkdigits import GSTIN_ALPHABET, VERHOEFF_D, VERHOEFF_INVERSE, VERHOEFF_P
from sievemask.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df`, its rows dealt out where its scan has fewer tasks than there are cores: one row group cannot be read by two tasks, but the
    expressions over its rows may take much longer than the reading. A scan with tasks enough stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    base = shared_dir(spark)
    if spark.sparkContext.master.startswith("local") and "://" not in base:
        return tempfile.mkdtemp(prefix=f"{name}-", dir=base)
    import uuid

    return f"{base}/{name}-{uuid.uuid4().hex}"


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def digest_of(c: Column | str) -> Column:
    """Long texts are compared by digest."""
    return F.md5(F.col(c) if isinstance(c, str) else c)


# --- the same draws and check digits in SQL, written for the checking engine ---


def _flat(rows) -> str:
    return "[" + ",".join(str(v) for row in rows for v in row) + "]"


def q_digest(key: str, name: str) -> str:
    return f"sha256({key} || '/{name}')"


def q_number(hexes: str, at: int, width: int) -> str:
    return f"('0x' || substr({hexes}, {at}, {width}))::BIGINT"


def q_below(key: str, name: str, n: int) -> str:
    return f"({q_number(q_digest(key, name), 1, 8)} % {n})"


def q_between(key: str, name: str, low: int, high: int) -> str:
    return f"({q_below(key, name, high - low + 1)} + {low})"


def q_list(items) -> str:
    return "[" + ",".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


def q_pick(key: str, name: str, items) -> str:
    return f"({q_list(items)})[{q_below(key, name, len(items))} + 1]"


def q_digits(key: str, name: str, n: int) -> str:
    return f"lpad(({q_number(q_digest(key, name), 1, 15)} % {10**n})::VARCHAR, {n}, '0')"


def q_letters(key: str, name: str, n: int, alphabet: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZ") -> str:
    h = q_digest(key, name)
    return "(" + " || ".join(
        f"substr('{alphabet}', ({q_number(h, 1 + 4 * i, 4)} % {len(alphabet)} + 1)::INT, 1)" for i in range(n)
    ) + ")"


def q_verhoeff_state(d: str, first: int) -> str:
    permuted = (
        f"list_transform(range(length({d})), lambda i: ({_flat(VERHOEFF_P)})[(((i + {first}) % 8) * 10 "
        f"+ substr(reverse({d}), (i + 1)::INT, 1)::INT + 1)::INT])"
    )
    return f"list_reduce(list_prepend(0, {permuted}), lambda c, p: ({_flat(VERHOEFF_D)})[c * 10 + p + 1])"


def q_verhoeff_digit(d: str) -> str:
    return f"({_flat([VERHOEFF_INVERSE])})[{q_verhoeff_state(d, 1)} + 1]"


def q_luhn_sum(d: str, first: int) -> str:
    digit = f"substr(reverse({d}), (i + 1)::INT, 1)::INT"
    return (
        f"list_sum(list_transform(range(length({d})), lambda i: CASE WHEN (i + {first}) % 2 = 0 THEN {digit} "
        f"WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END))"
    )


def q_luhn_digit(d: str) -> str:
    return f"((10 - {q_luhn_sum(d, 1)} % 10) % 10)"


def q_gstin_index(body: str) -> str:
    product = f"((strpos('{GSTIN_ALPHABET}', substr({body}, (i + 1)::INT, 1)) - 1) * (1 + i % 2))"
    return f"((36 - list_sum(list_transform(range(14), lambda i: {product} // 36 + {product} % 36)) % 36) % 36)"


def q_grouped(s: str, sep: str) -> str:
    """Four-character groups of a 12 or 16 character string."""
    return (
        f"(substr({s}, 1, 4) || {sep} || substr({s}, 5, 4) || {sep} || substr({s}, 9, 4) "
        f"|| CASE WHEN length({s}) > 12 THEN {sep} || substr({s}, 13, 4) ELSE '' END)"
    )
