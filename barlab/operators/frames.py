"""Row-exact window frames that still run in parallel within one symbol.

Frames count rows, not time, so a row needs its position inside its key. Positions come from ranges of
(key, order columns): a sample of all rows places their bounds, so that a busy hour or a single symbol with most of
the rows is cut as finely as its rows demand; range counts are summed up and rows are ranked inside
their range. No window spans a whole key except over the table of range counts. Rows are then cut into chunks of consecutive
positions, each chunk carrying copies of the neighbouring rows its frames reach, and the window runs
per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from barlab.operators.attach import below
from barlab.operators.sketch import slot_sample

MIN_CHUNK_ROWS = 4096
RANGE_ROWS = 1 << 15
MAX_RANGES = 1 << 16
_PICK = 64


def range_bounds(df: DataFrame, columns: Sequence[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row: ``_bounds``, ascending tuples of ``columns`` that cut ``df`` into ranges of about ``range_rows`` rows.

    The tuples come from a slot sample of one row in 64, at most ``4 * MAX_RANGES`` of them however many rows there are; they are the same
    on every evaluation. Rows with equal tuples share a range.
    """
    picked = df.select(*columns).filter(F.pmod(F.xxhash64(*columns, F.lit("range")), F.lit(_PICK)) == 0)
    sample = slot_sample(picked, [], columns, 4 * MAX_RANGES)
    all_ = sample.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("_s"), F.coalesce(F.sum("_seen"), F.lit(0)).alias("_n"))
    parts = F.least(F.lit(MAX_RANGES), F.floor(F.col("_n") * _PICK / range_rows), F.size("_s")).cast("int")
    steps = F.when(F.col("_parts") > 1, F.sequence(F.lit(1), F.col("_parts") - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda j: F.get("_s", F.floor(j * F.size("_s") / F.col("_parts")).cast("int"))
    return all_.withColumn("_parts", parts).select(F.array_distinct(F.transform(steps, at)).alias("_bounds"))


def with_range(df: DataFrame, columns: Sequence[str], out: str = "_slice", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with the number of its row's range of ``columns``; ranges ascend with them."""
    bounds = range_bounds(df, columns, range_rows)
    at = F.struct(*columns).cast(bounds.schema["_bounds"].dataType.elementType)
    rows = df.withColumn("_at", at).crossJoin(F.broadcast(bounds))  # one row
    return below(rows, "_bounds", F.col("_at"), MAX_RANGES, out).drop("_at", "_bounds")


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str = "_rn",
    total: str | None = None,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """0-based position of each row within ``keys`` under ``order``.

    ``total`` names an extra column with the row count of the key. A total order gives one result; tied rows take
    neighbouring positions in any order. Rows with a null key have no position and are left out.
    """
    part = [*keys, "_slice"]
    rows = with_range(df, [*keys, *order], "_slice", range_rows)
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *part,
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
            *([F.sum("_n").over(whole).alias(total)] if total else []),
        )
    )
    local = F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1
    return rows.join(offsets, part).withColumn(out, F.col("_off") + local).drop("_slice", "_off")


def stable_sort(df: DataFrame, keys: Sequence[str], order: Sequence[str], tie: Sequence[str], out: str = "pos") -> DataFrame:
    """1-based position under ``order`` within ``keys``; rows that tie keep the order of ``tie`` (their arrival)."""
    return number_rows(df, keys, [*order, *tie], out).withColumn(out, (F.col(out) + 1).cast("long"))


def add_halo(df: DataFrame, back: int, ahead: int, chunk_rows: int | None = None) -> DataFrame:
    """Copy each numbered row into every chunk whose frames can reach it; ``_core`` marks the owner."""
    size = chunk_rows or max(MIN_CHUNK_ROWS, 4 * (back + ahead))
    rn = F.col("_rn")
    first = F.greatest(F.lit(0), F.floor((rn - ahead) / size)).cast("int")
    last = F.floor((rn + back) / size).cast("int")
    return (
        df.withColumn("_chunk", F.explode(F.sequence(first, last)))
        .withColumn("_core", F.col("_chunk") == F.floor(rn / size).cast("int"))
    )


def over_chunks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    back: int,
    ahead: int,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    chunk_rows: int | None = None,
) -> DataFrame:
    """Run ``build(rows, window)`` per chunk and keep each row once.

    ``back`` and ``ahead`` must cover the *nested* reach of everything ``build`` computes.
    """
    spread = add_halo(number_rows(df, keys, order), back, ahead, chunk_rows)
    spec = Window.partitionBy(*keys, "_chunk").orderBy("_rn")
    return build(spread, spec).filter("_core").drop("_rn", "_chunk", "_core")


def gated(agg: Callable[[Column], Column], x: Column, frame: WindowSpec, n: int) -> Column:
    """Rolling aggregate that is null unless the frame holds ``n`` non-null values."""
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def trailing(spec: WindowSpec, n: int) -> WindowSpec:
    return spec.rowsBetween(-(n - 1), 0)


def following(spec: WindowSpec, n: int) -> WindowSpec:
    return spec.rowsBetween(1, n)
