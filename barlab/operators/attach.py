"""Attach a small table per group to many rows without gathering a group's rows in one task; find a row's place in an array."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

SALTS = 64


def attach(rows: DataFrame, table: DataFrame, keys: Sequence[str], spread: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``rows`` joined to ``table``, which has one row per group, on ``keys``.

    The table is repeated once per salt and the rows of a group are dealt over the salts by ``spread``, so a group that holds
    a third of all rows still joins in many tasks; the result is that of the plain join. Without keys the table is a
    single row and is broadcast.
    """
    if not keys:
        return rows.join(F.broadcast(table), how=how)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return dealt.join(salted, [*keys, "_salt"], how).drop("_salt")


def row_hash(rows: DataFrame) -> Column:
    """A hash of the whole row to ``spread`` by; columns that hold maps have none and are left out."""
    return F.xxhash64(*[c for c, kind in rows.dtypes if "map<" not in kind])


def below(rows: DataFrame, array: str, value: Column, limit: int, out: str) -> DataFrame:
    """``rows`` with the number of entries of the ascending column ``array``, fewer than ``limit``, that are smaller than ``value``.

    Halving in plain column steps: an array is read in place, not copied with the row as a lambda function would need, so a
    row costs the logarithm of its length. The count is never null, also where ``array`` is.
    """
    rows = rows.withColumn(out, F.lit(0))
    step = 1 << (limit - 1).bit_length()
    while step > 1:
        step //= 2
        rows = rows.withColumn(out, F.col(out) + F.when(F.get(array, F.col(out) + (step - 1)) < value, step).otherwise(0))
    return rows
