"""History in front of a store: linked by price, checked for jumps, attached."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
#: Added to the listed days of a key that traded before any history begins.
LONG_HISTORY = 100_000


def link_ratios(bars: DataFrame, warm: DataFrame, start: Column) -> DataFrame:
    """(ticker, ratio): close in the store over close in the history on the
    first day of the store; keys without both, or not above zero, have none."""
    both = bars.where(c("date") == start).select("ticker", c("close").alias("a")).join(warm.where(c("date") == start).select("ticker", c("close").alias("b")), "ticker")
    return both.select("ticker", F.try_divide("a", "b").alias("ratio")).where("ratio > 0")


def jumping(scaled: DataFrame, bars: DataFrame, start: Column, most: float) -> DataFrame:
    """Keys whose scaled history, up to the store's first close, moves by more
    than ``most`` in a step: some adjustment is missing there."""
    link = bars.where(c("date") == start).select("ticker", "date", "close").join(scaled.select("ticker").distinct(), "ticker", "left_semi")
    both = scaled.select("ticker", "date", "close").unionByName(link).where("close > 0")
    move = F.try_divide(c("close"), F.lag("close").over(Window.partitionBy("ticker").orderBy("date"))) - 1
    return both.withColumn("move", move).where(F.abs("move") > most).select("ticker").distinct()


def attach(bars: DataFrame, warm: DataFrame | None, start: Column, begin: Column, most: float, unit: float = 1.0) -> DataFrame:
    """The store's bars with scaled history before them, marked is_warmup."""
    own = bars.withColumn("is_warmup", F.lit(False))
    if warm is None:
        return own
    ratios = link_ratios(bars, warm, start)
    past = warm.where((c("date") >= begin) & (c("date") < start)).join(ratios, "ticker")
    prices = {x: c(x) * c("ratio") for x in ("open", "high", "low", "close")}
    past = past.withColumns(prices).withColumn("value", c("value") * unit).drop("ratio")
    past = past.join(jumping(past, bars, start, most), "ticker", "left_anti")
    missing = c("open").isNull() | (c("open") <= 0)
    past = past.withColumn("halted", missing | (c("volume") <= 0)).withColumns({x: F.when(~missing, c(x)) for x in ("high", "low", "open")})
    return past.withColumn("is_warmup", F.lit(True)).unionByName(own, allowMissingColumns=True)


def attach_index(index: DataFrame, warm: DataFrame | None, begin: Column) -> DataFrame:
    """An index with its history before the first day of each market; where both
    have a day the store's row counts."""
    if warm is None:
        return index
    first = index.groupBy("market").agg(F.min("date").alias("_first"))
    past = warm.join(first, "market").where((c("date") >= begin) & (c("date") < c("_first"))).drop("_first")
    return past.select(*index.columns).unionByName(index)


def first_trade_dates(bars: DataFrame, first: DataFrame | None, start: Column) -> DataFrame:
    """(ticker, first_date): of the store, earlier by the history for keys that
    the store has from its first day."""
    own = bars.where("not is_warmup").groupBy("ticker").agg(F.min("date").alias("first_date"))
    if first is None:
        return own
    known = own.join(first.select("ticker", c("first_date").alias("_known")), "ticker", "left")
    return known.select("ticker", F.when(c("first_date") == start, F.least("first_date", "_known")).otherwise(c("first_date")).alias("first_date"))


def listed_days(bars: DataFrame, first: DataFrame, begin: Column) -> DataFrame:
    """Adds listed_days: rows so far, and many more for keys older than the history."""
    rows = F.row_number().over(Window.partitionBy("ticker").orderBy("date"))
    known = bars.withColumn("_n", rows).join(first, "ticker", "left")
    return known.withColumn("listed_days", c("_n") + F.when(c("first_date") < begin, LONG_HISTORY).otherwise(0)).drop("_n", "first_date")
