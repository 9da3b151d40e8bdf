"""Indicators as Column builders over (ticker, date) windows.

All are NULL until their window is full and NULL where an input is missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.operators.windows import full, lag, rolling_mean


def positive(x: Column) -> Column:
    """NULL unless finite and above zero."""
    return F.when((x > 0) & ~F.isnan(x) & (x < float("inf")), x)


def sma(n: int, x: str = "close") -> Column:
    return rolling_mean(F.col(x), n)


def rsi(n: int) -> Column:
    """Simple-mean RSI: 100 without losses, NULL without any move."""
    move = F.col("close") - lag(F.col("close"))
    side = lambda x: rolling_mean(F.when(x.isNotNull(), F.greatest(x, F.lit(0.0))), n)
    up, down = side(move), side(-move)
    return F.when((down == 0) & (up > 0), 100.0).otherwise(100 - 100 / (1 + F.try_divide(up, down)))


def bollinger(n: int, k: float, side: int = -1) -> Column:
    """Mean plus ``side`` times k population deviations."""
    return rolling_mean(F.col("close"), n) + side * k * full(F.stddev_pop, F.col("close"), n)


def vwap(n: int) -> Column:
    """Typical price weighted by volume; NULL without volume."""
    typical = F.col("high") + F.col("low") + F.col("close")
    return F.try_divide(rolling_mean(typical * F.col("volume"), n) / 3, F.nullif(rolling_mean(F.col("volume").cast("double"), n), F.lit(0.0)))


def previous_max(n: int, x: str = "high") -> Column:
    """Largest of the n rows before this one."""
    return full(F.max, F.col(x), n, skip=1)


def previous_mean(n: int, x: str = "volume") -> Column:
    return rolling_mean(F.col(x).cast("double"), n, skip=1)


def average_value(n: int) -> Column:
    return rolling_mean(F.coalesce("value", F.lit(0.0)), n)


def stochastic(n: int) -> Column:
    """Place of the close between the lowest low and the highest high, in %."""
    high, low = full(F.max, F.col("high"), n), full(F.min, F.col("low"), n)
    return F.when(high > low, (F.col("close") - low) / (high - low) * 100)


def with_emas(df: DataFrame, means: dict[str, tuple[str, float, int]], key: str = "ticker", order: str = "date") -> DataFrame:
    """Recursive means of each key: y = (1-alpha)·y + alpha·x, as new columns.

    ``means`` gives (column, alpha, least count) of each. A recursion is no
    window aggregate, so sorted rows stream through one vectorised pass that
    carries the last mean of the present key. Rows with a missing value repeat
    the mean while older values lose weight; the first values give NULL.
    """
    names = [key, *(x for x, _, _ in means.values())]
    spots = [df.columns.index(x) for x in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, {}
        for batch in batches:
            keys = np.array(batch.column(spots[0]).to_pylist(), object)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]
            columns = []
            for k, (out, (_, alpha, least)) in enumerate(means.items()):
                x, y = batch.column(spots[k + 1]).cast(pa.float64()).to_numpy(zero_copy_only=False), np.full(len(keys), np.nan)
                for a, b in zip(cuts, cuts[1:]):
                    # the mean so far stands before the rows, with the gap after it
                    seen, mean, gap = state.get(out, (0, np.nan, 0)) if a == 0 and keys[0] == last else (0, np.nan, 0)
                    before = [mean, *[np.nan] * gap] if seen else []
                    values = pd.Series(np.r_[before, x[a:b]]).ewm(alpha=alpha, adjust=False, min_periods=1).mean().to_numpy()[len(before) :]
                    count = seen + np.cumsum(~np.isnan(x[a:b]))
                    y[a:b] = np.where(count >= least, values, np.nan)
                    held = np.flatnonzero(~np.isnan(x[a:b]))
                    state[out] = (int(count[-1]), values[-1], b - a - 1 - held[-1] if len(held) else gap + b - a)
                columns.append(pa.array(y, from_pandas=True))
            last = keys[-1] if len(keys) else last
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *means])

    schema = StructType([*df.schema.fields, *(StructField(out, DoubleType()) for out in means)])
    return df.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def with_ema(df: DataFrame, out: str, x: str, alpha: float, min_periods: int, key: str = "ticker", order: str = "date") -> DataFrame:
    return with_emas(df, {out: (x, alpha, min_periods)}, key, order)


def indicator_bundle() -> dict[str, Column]:
    """The eleven indicator columns of a prepared bar, over one window order."""
    return {
        "sma5": sma(5),
        "sma20": sma(20),
        "sma60": sma(60),
        "sma200": sma(200),
        "rsi14": rsi(14),
        "bb_lower": bollinger(20, 2.0),
        "bb_upper": bollinger(20, 2.0, 1),
        "vwap20": vwap(20),
        "high_prev20": previous_max(20),
        "vol_prev20": previous_mean(20),
        "avg_value20": average_value(20),
    }
