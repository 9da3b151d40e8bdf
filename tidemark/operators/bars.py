"""Minute rows to bars of unequal slots, price basis and daily validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
#: Minute of day at which each slot begins, and the end.
SLOT_EDGES = {"1h": [540, 600, 660, 720, 780, 840, 900, 931], "3h": [540, 720, 931]}


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def slot(ts: Column, edges: list[int]) -> Column:
    """1-based slot of a time, NULL outside the session. The last slot may be longer."""
    m = minute_of_day(ts)
    out = F.lit(None).cast("int")
    for k in range(len(edges) - 2, -1, -1):
        out = F.when((m >= edges[k]) & (m < edges[k + 1]), k + 1).otherwise(out)
    return out


def cumulative_to_rows(df: DataFrame, value: str, part: list[str], order: list[str]) -> DataFrame:
    """A running total within a day becomes the value of each row.

    Must come before rows are filtered, else a dropped row's share would move
    to the next.
    """
    before = F.lag(value).over(Window.partitionBy(*part).orderBy(*order))
    return df.withColumn(value, c(value) - F.coalesce(before, F.lit(0)))


def valid_minutes(rows: DataFrame) -> Column:
    """Whether open and close lie between low and high; missing prices do not."""
    o, h, l, z = (c(x) for x in ("open", "high", "low", "close"))
    return F.coalesce((o <= h) & (o >= l) & (h >= l) & (z <= h) & (z >= l), F.lit(False))


def normalize_minutes(raw: DataFrame, edges: list[int], order: list[str]) -> DataFrame:
    """Minute rows of the session with their own traded value.

    Running totals are differenced over all rows of a day first, then rows with
    impossible prices go, then those outside the session.
    """
    day = F.to_date("ts")
    rows = cumulative_to_rows(raw.withColumn("day", day), "value", ["code", "day"], order)
    return rows.where(valid_minutes(rows)).where(slot(c("ts"), edges).isNotNull())


def _at_minute(day: Column, minute: Column) -> Column:
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minute)


def in_slots(rows: DataFrame, edges: list[int]) -> DataFrame:
    """Rows of the session with the day and slot that they fall in."""
    return rows.withColumns({"day": F.to_date("ts"), "slot": slot(c("ts"), edges)}).where("slot is not null")


def slot_values(rows: DataFrame) -> list[Column]:
    """What a bar says of its rows; prices that are missing are the value."""
    at = F.struct("ts", "event_id")
    o, h, l, z, v = (c(x) if x in rows.columns else c("value") for x in ("open", "high", "low", "close", "volume"))
    total = lambda x: F.sum(x.cast("decimal(20,4)")).cast("double")
    return [F.min_by(o, at).alias("open"), F.max(h).alias("high"), F.min(l).alias("low"), F.max_by(z, at).alias("close"), total(v).alias("volume"), total(c("value")).alias("value"), F.count("*").alias("rows")]


def slot_bounds(edges: list[int]) -> dict[str, Column]:
    """Start, end and minutes of the slot of a day."""
    bounds = F.array(*(F.lit(x) for x in edges))
    start, end = F.get(bounds, c("slot") - 1), F.get(bounds, c("slot"))
    return {"bar_start": _at_minute(c("day"), start), "available_at": _at_minute(c("day"), end), "bar_minutes": end - start}


def aggregate_slots(rows: DataFrame, edges: list[int]) -> DataFrame:
    """One bar per (code, day, slot), usable from the end of its slot."""
    return in_slots(rows, edges).groupBy("code", "day", "slot").agg(*slot_values(rows)).withColumns(slot_bounds(edges))


def daily_validity(df: DataFrame) -> DataFrame:
    """no_trade, bad or keep for each raw daily row."""
    o, h, l, z = (c(x) for x in ("open", "high", "low", "close"))
    fine = (l <= o) & (o <= h) & (l <= z) & (z <= h) & (l > 0)
    return df.withColumn("state", F.when(c("volume") <= 0, "no_trade").when(~F.coalesce(fine, F.lit(False)), "bad").otherwise("keep"))


def price_basis(intraday: DataFrame, daily: DataFrame, tolerance: float) -> DataFrame:
    """raw, mismatch or no_daily for each (code, day)."""
    j = intraday.join(daily, ["code", "day"], "left")
    gap = F.abs(F.try_divide(c("close"), c("daily_close")) - 1)
    return j.withColumn("basis", F.when(c("daily_close").isNull(), "no_daily").when(F.coalesce(gap <= tolerance, F.lit(False)), "raw").otherwise("mismatch"))


def next_day_verdicts(verdicts: DataFrame, open_minute: int) -> DataFrame:
    """Verdicts with the time they are known from: the open of the next day that
    any code has a daily price for. Days are few: the window without a key is over them."""
    days = verdicts.where("daily_close is not null").select("day").distinct()
    last = Window.orderBy(c("day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    calendar = verdicts.select("day").distinct().join(days.withColumn("traded", F.lit(True)), "day", "left")
    calendar = calendar.withColumn("next", F.last(F.when(c("traded"), c("day")), ignorenulls=True).over(last)).select("day", "next")
    return verdicts.join(calendar, "day", "left").withColumn("available_at", _at_minute(c("next"), F.lit(open_minute))).drop("next")


def apply_yesterday(days: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The (code, day) rows whose last earlier verdict is raw; without one a day goes."""
    marked = verdicts.select("code", "day", c("basis").alias("_basis"), F.lit(1).alias("_side"))
    both = days.withColumn("_side", F.lit(0)).unionByName(marked, allowMissingColumns=True)
    # strictly earlier: a row of the same day sorts before that day's verdict
    w = Window.partitionBy("code").orderBy("day", "_side").rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("basis", F.last("_basis", ignorenulls=True).over(w)).where("_side = 0")
    return seen.where("basis = 'raw'").drop("_side", "_basis")
