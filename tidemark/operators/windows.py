"""Ordered-window helpers: every one reads rows up to its own row only."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEY, ORDER = "ticker", "date"


def by_key(key: str | list[str] = KEY, order: str = ORDER) -> WindowSpec:
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(order)


def full(agg, x: Column, n: int, w: WindowSpec | None = None, skip: int = 0) -> Column:
    """Aggregate of the last ``n`` rows, NULL unless all of them have a value.

    ``skip`` 1 leaves the present row out.
    """
    frame = (w or by_key()).rowsBetween(-(n - 1) - skip, -skip)
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def rolling_mean(x: Column, n: int, **kw) -> Column:
    """Mean of a full window, from exact decimal sums so that no order of
    addition shows."""
    return full(lambda c: F.sum(c.cast("decimal(20,6)")), x, n, **kw).cast("double") / n


def lag(x: Column, k: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lag(x, k).over(w or by_key())


def truth(x: Column) -> Column:
    """NULL counts as false."""
    return F.coalesce(x, F.lit(False))


def islands(df, key: str, order: str, label: str):
    """Runs of equal labels: (key, label, start, end, rows); NULL labels go."""
    w = Window.partitionBy(key).orderBy(order)
    changed = F.when(F.col(label).eqNullSafe(F.lag(label).over(w)), 0).otherwise(1)
    run = df.withColumn("_change", changed).withColumn("_run", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.where(F.col(label).isNotNull()).groupBy(key, "_run", label).agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("rows")).drop("_run")
