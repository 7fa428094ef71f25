"""Pearson correlation that is null, not an error, when either side is constant."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec, functions as F


def pearson(x: Column, y: Column, frame: WindowSpec | None = None) -> Column:
    """As an aggregate, or over ``frame``. Rows with a null on either side do not count."""
    over = (lambda c: c) if frame is None else (lambda c: c.over(frame))
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = over(F.stddev_pop(a)) * over(F.stddev_pop(b))
    return F.when(spread > 0, over(F.covar_pop(x, y)) / spread)
