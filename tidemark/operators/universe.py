"""Eligibility with reasons, cross-sectional groups and regimes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.indicators import average_value
from tidemark.operators.windows import by_key, lag, rolling_mean

c = F.col


def listed_rows() -> Column:
    return F.row_number().over(by_key())


#: Reasons for exclusion; of several that hold the first is given.
REASONS = ("warmup", "not_common_stock", "market", "listed_lt_250", "managed_or_warning", "low_liquidity")


@dataclass(frozen=True)
class Rules:
    """What a row needs to be eligible."""

    min_listed: int
    min_value: float
    kind: str
    markets: tuple[str, ...]
    excluded_depts: tuple[str, ...] = ()
    window: int = 20


def with_universe(bars: DataFrame, rules: Rules, first_rows: Column | None = None) -> DataFrame:
    """Adds listed_days, avg_value, exclude_reason (the first that holds) and eligible.

    ``bars`` has ticker, date, value, kind, market and dept, and may have
    is_warmup. An unknown kind or market is not eligible, nor is a mean value that
    is unknown; an unknown dept is. ``first_rows`` counts the rows since the
    listing where that is known better than by the rows at hand.
    """
    df = bars.withColumns({"listed_days": listed_rows() if first_rows is None else first_rows, "avg_value": average_value(rules.window)})
    sure = lambda test: F.coalesce(test, F.lit(False))
    holds = {
        "warmup": sure(c("is_warmup")) if "is_warmup" in bars.columns else F.lit(False),
        "not_common_stock": ~sure(c("kind") == rules.kind),
        "market": ~sure(c("market").isin(*rules.markets)),
        "listed_lt_250": sure(c("listed_days") < rules.min_listed),
        "managed_or_warning": sure(c("dept").isin(*rules.excluded_depts)) if rules.excluded_depts else F.lit(False),
        "low_liquidity": ~sure(c("avg_value") >= rules.min_value),
    }
    reason = F.coalesce(*(F.when(holds[name], F.lit(name)) for name in REASONS))
    return df.withColumn("exclude_reason", reason).withColumn("eligible", c("exclude_reason").isNull())


def split_labels(value: str, part: list[str], tie: str = "ticker", top: float = 0.3, low: float = 0.7) -> Column:
    """large, mid or small by descending percent rank; NULL values get none."""
    rank = F.row_number().over(Window.partitionBy(*part).orderBy(c(value).desc_nulls_last(), tie))
    n = F.count(value).over(Window.partitionBy(*part))
    share = F.when(n > 1, (rank - 1) / (n - 1)).otherwise(F.lit(0.0))
    return F.when(c(value).isNotNull(), F.when(share <= top, "large").when(share >= low, "small").otherwise("mid"))


def classify(close: Column, ma: Column, before: Column, band: float) -> Column:
    """bull, bear or sideways by level and slope of the mean; NULL if unknown."""
    slope = F.try_divide(ma, before) - 1
    label = F.when((close > ma) & (slope > band), "bull").when((close < ma) & (slope < -band), "bear").otherwise("sideways")
    return F.when(close.isNotNull() & ma.isNotNull() & before.isNotNull(), label)


def with_regime(bars: DataFrame, n: int, slope: int, band: float, out: str = "regime", price: str = "close", key: str = "ticker") -> DataFrame:
    w = by_key(key)
    df = bars.withColumn("_ma", rolling_mean(c(price), n, w=w))
    return df.withColumn(out, classify(c(price), c("_ma"), lag(c("_ma"), slope, w), band)).drop("_ma")
