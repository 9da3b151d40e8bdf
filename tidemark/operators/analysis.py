"""Aggregation and statistical validation of trades."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import t_pvalue, uniform
from tidemark.operators.windows import by_key

c = F.col


def trade_stats() -> list[Column]:
    """Aggregates of a set of trades; a mean of nothing is NULL."""
    r = c("net_ret")
    wins, losses = F.avg(F.when(r > 0, r)), F.avg(F.when(r < 0, r))
    sd = F.stddev_samp(r)
    return [
        F.count(r).alias("trades"),
        F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.avg(r).alias("mean_ret"),
        F.median(r).alias("median_ret"),
        F.avg("gross_ret").alias("mean_hold_ret"),
        F.avg("excess_ret").alias("mean_excess"),
        F.try_divide(wins, F.abs(losses)).alias("payoff_ratio"),
        F.when(sd > 0, F.avg(r) / sd).alias("sharpe"),
    ]


def included(trades: DataFrame) -> DataFrame:
    return trades.where(~c("excluded") & c("excess_ret").isNotNull())


def cells(trades: DataFrame, keys: list[str], min_trades: int) -> DataFrame:
    """Statistics by cell; missing keys are 'unavailable', thin cells flagged."""
    named = [F.coalesce(c(k), F.lit("unavailable")).alias(k) for k in keys]
    return trades.where(~c("excluded")).groupBy(*named).agg(*trade_stats()).withColumn("sample_ok", c("trades") >= min_trades)


def pnl_histogram(trades: DataFrame, spark) -> DataFrame:
    """32 left-closed bins of 2 percentage points from -30 to 30; none is missing."""
    cents = F.round(c("net_ret") * 100, 9)
    bin_ = F.when(cents < -30, 0).when(cents >= 30, 31).otherwise(F.floor((cents + 30) / 2) + 1).cast("int")
    counted = trades.where(~c("excluded")).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))
    return spark.range(32).select(c("id").cast("int").alias("bin")).join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def ticker_table(trades: DataFrame, min_trades: int) -> DataFrame:
    """Statistics by key, with the market most of its trades are in."""
    counted = trades.where(~c("excluded")).withColumn("market_trades", F.count("*").over(Window.partitionBy("ticker", "market")))
    return counted.groupBy("ticker").agg(*trade_stats(), F.min_by("market", F.struct((-c("market_trades")).alias("n"), "market")).alias("market")).withColumn("sample_ok", c("trades") >= min_trades)


def period_split(trades: DataFrame, split: Column, min_trades: int, key: str = "strategy") -> DataFrame:
    """Judges each strategy by its excess before and after ``split``."""
    early = c("entry_date") <= split
    half = lambda cond, f: f(F.when(cond, c("excess_ret")))
    df = included(trades).groupBy(key).agg(half(early, F.count).alias("h1_trades"), half(~early, F.count).alias("h2_trades"), half(early, F.avg).alias("h1_mean"), half(~early, F.avg).alias("h2_mean"))
    rank = lambda x: F.when(c(x).isNotNull(), F.rank().over(Window.orderBy(c(x).desc_nulls_last())))
    df = df.withColumns({"h1_rank": rank("h1_mean"), "h2_rank": rank("h2_mean")})
    thin = (c("h1_trades") < min_trades) | (c("h2_trades") < min_trades)
    verdict = F.when(thin, "sample_insufficient").when(F.signum("h1_mean") != F.signum("h2_mean"), "reversed").when(c("h1_mean") <= 0, "negative_both")
    return df.withColumn("judgement", verdict.when(c("h2_rank") <= c("h1_rank"), "maintained").otherwise("weakened"))


def t_statistics(trades: DataFrame, key: str = "strategy") -> DataFrame:
    """One-sided t statistic of the mean excess; NULL without spread."""
    sd = F.stddev_samp("excess_ret")
    df = included(trades).groupBy(key).agg(F.count("*").alias("n"), F.when(sd > 0, F.avg("excess_ret") / (sd / F.sqrt(F.count("*")))).alias("t"))
    return df


def with_pvalues(stats: DataFrame) -> DataFrame:
    return stats.withColumn("p_value", t_pvalue(c("t"), (c("n") - 1).cast("double")))


def benjamini_hochberg(df: DataFrame, q: float, p: str = "p_value", tie: str = "strategy") -> DataFrame:
    """Step-up rejection; a NULL p-value is never rejected and not counted.

    The rows are strategies of one request, so their order needs one window.
    """
    order = Window.orderBy(c(p).asc_nulls_last(), tie)
    everything = Window.partitionBy()
    k, m = F.row_number().over(order), F.count(p).over(everything)
    df = df.withColumns({"_k": k, "_m": m})
    df = df.withColumn("_last", F.max(F.when(c(p) <= F.lit(q) * c("_k") / c("_m"), c("_k"))).over(everything))
    return df.withColumn("fdr_pass", F.coalesce(c("_k") <= c("_last"), F.lit(False)) & c(p).isNotNull()).drop("_k", "_m", "_last")


def holm(df: DataFrame, alpha: float, p: str = "p_value", tie: str = "strategy") -> DataFrame:
    """Step-down: passes while every smaller p-value passes."""
    order = Window.orderBy(c(p).asc_nulls_last(), tie)
    m = F.count(p).over(Window.partitionBy())
    df = df.withColumn("_ok", F.coalesce(c(p) <= alpha / (m - F.row_number().over(order) + 1), F.lit(False)))
    return df.withColumn("holm_pass", F.every("_ok").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_ok")


@dataclass(frozen=True)
class Period:
    """Times from which and up to which an entry may lie, both included."""

    start: str | None = None
    end: str | None = None

    def may_start(self) -> Column:
        return F.lit(True) if self.start is None else c("date") >= F.lit(self.start).cast("timestamp_ntz")

    def still_in(self) -> Column:
        return F.lit(True) if self.end is None else c("date") <= F.lit(self.end).cast("timestamp_ntz")


def random_benchmark(trades: DataFrame, bars: DataFrame, index: DataFrame, market: Column, iterations: int = 1000, cost: float = 0.003, period: Period = Period(), key: str = "strategy") -> DataFrame:
    """(key, n, actual, random_mean, percentile): mean excess over the market
    against entries at random rows of the same key, held for as many rows.

    An entry lies after the warm-up (is_warmup, if there) and inside the period,
    and its exit among the rows; a trade for which no row is left is not drawn.
    A draw is a hash of trade and iteration, so any engine gives the same one.
    Draws with an open that is missing or not above zero do not count; half of
    the ties count as below.
    """
    b = bars.withColumn("rn", F.row_number().over(by_key())).withColumn("market", market)
    fresh = ~F.coalesce(c("is_warmup"), F.lit(False)) if "is_warmup" in bars.columns else F.lit(True)
    rows = b.groupBy("ticker").agg(F.max("rn").alias("n"), F.min(F.when(fresh & period.may_start(), c("rn"))).alias("low"), F.max(F.when(period.still_in(), c("rn"))).alias("last"))
    above = lambda x: F.when(c(x) > 0, c(x))
    b = b.join(index.select("market", "date", "index_open"), ["market", "date"], "left").select("ticker", "rn", above("open").alias("o"), above("index_open").alias("i"))
    held = F.greatest(c("x") - c("t") - 1, F.lit(1))
    every = included(trades)
    inc = every.select(key, "ticker", "t", held.alias("h")).join(rows, "ticker").withColumn("high", F.least(c("n") - c("h"), c("last"))).where("high >= low")
    draws = inc.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    start = c("low") + F.floor(uniform("ticker", c("t").cast("string"), c("draw").cast("string")) * (c("high") - c("low") + 1))
    draws = draws.select(key, "ticker", "draw", start.cast("int").alias("a"), (start + c("h")).cast("int").alias("z"))
    first, last = (b.select("ticker", c("rn").alias(k), c("o").alias(f"o_{k}"), c("i").alias(f"i_{k}")) for k in "az")
    made = draws.join(first, ["ticker", "a"]).join(last, ["ticker", "z"])
    excess = F.try_divide("o_z", "o_a") - 1 - cost - (F.try_divide("i_z", "i_a") - 1)
    finite = lambda x: F.abs(x) < float("inf")
    # Exact decimal sums; a value that is not finite makes the mean what it makes any mean.
    exact = lambda x: F.when(F.count_if(~finite(x)) > 0, F.avg(x)).otherwise(F.avg(F.when(finite(x), F.round(x, 9)).cast("decimal(20,9)")).cast("double"))
    means = made.groupBy(key, "draw").agg(exact(excess).alias("mean"))
    actual = every.groupBy(key).agg(exact(c("excess_ret")).alias("actual"))
    share = F.avg(F.when(c("mean") < c("actual"), 1.0).when(c("mean") == c("actual"), 0.5).otherwise(0.0))
    found = means.join(actual, key).groupBy(key).agg(F.max("actual").alias("actual"), F.avg("mean").alias("random_mean"), share.alias("percentile"))
    return found.join(inc.groupBy(key).agg(F.count("*").alias("n")), key)


def validate(trades: DataFrame, bars: DataFrame, index: DataFrame, market: Column, split: Column, min_trades: int, q: float, iterations: int = 1000, cost: float = 0.003, period: Period = Period(), least: float = 0.95) -> DataFrame:
    """Period split, false-discovery control and random entries, which must all agree."""
    halves = period_split(trades, split, min_trades).select("strategy", "judgement")
    fdr = benjamini_hochberg(with_pvalues(t_statistics(trades)), q).select("strategy", "n", "p_value", "fdr_pass")
    chance = random_benchmark(trades, bars, index, market, iterations, cost, period).select("strategy", "percentile")
    both = fdr.join(halves, "strategy").join(chance, "strategy", "left")
    both = both.withColumns({"split_pass": c("judgement").isin("maintained", "weakened"), "random_pass": F.coalesce(c("percentile") >= least, F.lit(False)), "family": F.count("*").over(Window.partitionBy())})
    return both.withColumn("analysis_target", c("split_pass") & c("fdr_pass") & c("random_pass"))
