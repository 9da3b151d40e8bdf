"""Leak-free samples, targets, splits, baselines and scores of a bar forecaster."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.boosting import QuantileForest

c = F.col
QUANTILES = (0.1, 0.5, 0.9)
LAGS = (1, 3, 7, 14)
VOLATILITY = (7, 35)


def _w() -> Window:
    return Window.partitionBy("ticker").orderBy("date")


def targets(bars: DataFrame, h: int = 1) -> DataFrame:
    """Log return to the h-th next bar of the same segment, and when it is known."""
    w = _w()
    same = F.lead("segment", h).over(w) == c("segment")
    y = F.when(same, F.ln(F.lead("close", h).over(w) / c("close")))
    when = F.when(same, F.lead("date", h).over(w))
    return bars.withColumns({"y": y, "realized_at": when, "cross_day": F.when(same, F.to_date(F.lead("date", h).over(w)) > F.to_date("date"))})


def features(bars: DataFrame, late: str | None = None) -> DataFrame:
    """Past-only features of each bar, within its segment.

    The gap and the day's return refer to the last close of the last earlier
    day of the segment. ``late`` marks bars from that day on in nxt.
    """
    s = Window.partitionBy("ticker", "segment").orderBy("date")
    df = bars.withColumns({"_day": F.to_date("date"), "slot": F.hour("date")} | {f"r{k}": F.ln(c("close") / F.lag("close", k).over(s)) for k in LAGS})
    day = Window.partitionBy("ticker", "_day").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    # the close of the day before stands on the first row of a day, within its segment
    df = df.withColumn("_first", F.coalesce(F.lag("_day").over(s) != c("_day"), F.lit(True)))
    df = df.withColumn("_start", F.when(c("_first"), F.struct(F.lag("close").over(s).alias("x"))))
    df = df.withColumn("_before", F.last("_start", ignorenulls=True).over(s.rowsBetween(Window.unboundedPreceding, 0))["x"])
    slot = Window.partitionBy("ticker", "slot").orderBy("date").rowsBetween(-20, -1)
    prior = lambda x: F.when(F.count(x).over(slot) >= 5, F.avg(x).over(slot))
    deviation = lambda n: F.when(F.count("r1").over(s.rowsBetween(1 - n, 0)) >= max(3, n // 2), F.stddev_samp("r1").over(s.rowsBetween(1 - n, 0)))
    df = df.withColumns(
        {f"vol{n}": deviation(n) for n in VOLATILITY}
        | {
            "range": F.ln(c("high") / c("low")),
            "day_ret": F.ln(c("close") / c("_before")),
            "gap": F.ln(F.first("open").over(day) / c("_before")),
            "vol_rel": F.log1p(c("volume").cast("double")) - F.log1p(prior("volume")),
            "value_rel": F.log1p("value") - F.log1p(prior("value")),
            "dow": F.weekday("date"),
            "nxt": (c("_day") >= F.lit(late).cast("date")).cast("int") if late else F.lit(0),
        }
    )
    market = Window.partitionBy("date")
    return df.withColumns({f"mkt_r{k}": F.avg(f"r{k}").over(market) for k in (1, 7)}).drop("_day", "_first", "_start", "_before")


def attach_external(samples: DataFrame, extra: DataFrame, keys: list[str], value: str) -> DataFrame:
    """External features by key; no row is missing, which is not zero."""
    return samples.join(extra.withColumn("_there", F.lit(True)), keys, "left").withColumn("docs_missing", c("_there").isNull()).withColumn(value, F.when(~c("docs_missing"), c(value))).drop("_there")


def time_split(df: DataFrame, train_end: Column, valid_end: Column) -> DataFrame:
    """train, valid or test by date; purged where the target is only known after
    the end of its part, the midnight that closes the boundary day."""
    close = lambda x: F.date_add(x, 1).cast("timestamp_ntz")
    part = F.when(c("date") < close(train_end), "train").when(c("date") < close(valid_end), "valid").otherwise("test")
    end = F.when(c("date") < close(train_end), close(train_end)).when(c("date") < close(valid_end), close(valid_end))
    late = c("realized_at").isNull() | F.coalesce(c("realized_at") > end, F.lit(False))
    return df.withColumn("split", F.when(late, "purged").otherwise(part))


def persistence(df: DataFrame) -> DataFrame:
    """The forecast that nothing changes: all quantiles 0, even odds."""
    return df.withColumns({f"q{q:g}": F.lit(0.0) for q in QUANTILES} | {"p_up": F.lit(0.5)})


def historical_baseline(df: DataFrame, window: int = 60, least: int = 20) -> DataFrame:
    """Quantiles and share of rises over the last realized targets of a key.

    A sample may use targets realized by its own time only: a union of samples
    and targets by time, in which the latest finished window is carried on.
    """
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(-(window - 1), 0)
    enough = F.count("y").over(w) >= least
    stats = [F.when(enough, F.percentile("y", F.lit(q)).over(w)).alias(f"q{q:g}") for q in QUANTILES]
    stats.append(F.when(enough, F.avg(F.when(c("y") > 0, 1.0).otherwise(0.0)).over(w)).alias("p_up"))
    realized = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    done = df.where("y is not null").select("ticker", F.max("realized_at").over(realized).alias("at"), F.lit(0).alias("side"), F.col("date").alias("d"), F.struct(*stats).alias("s"))
    asked = df.select("ticker", c("date").alias("at"), F.lit(1).alias("side"), c("date").alias("d"))
    both = done.unionByName(asked, allowMissingColumns=True)
    order = Window.partitionBy("ticker").orderBy("at", "side", "d").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("s", F.last("s", ignorenulls=True).over(order)).where("side = 1")
    return df.join(carried.select("ticker", c("d").alias("date"), "s.*"), ["ticker", "date"], "left")


def direction(p: Column, up: float = 0.55, down: float = 0.45) -> Column:
    return F.when(p.isNotNull(), F.when(p >= up, "up").when(p <= down, "down").otherwise("uncertain"))


def pinball(y: Column, q: Column, level: float) -> Column:
    return F.greatest(level * (y - q), (level - 1) * (y - q))


def hits(p: Column, **bounds) -> tuple[Column, Column]:
    """(called, right): whether a direction is given, and whether it came true."""
    way = direction(p, **bounds)
    called = F.coalesce(way.isin("up", "down"), F.lit(False))
    return called, called & F.coalesce(((way == "up") & (c("y") > 0)) | ((way == "down") & (c("y") < 0)), F.lit(False))


def direction_policy(df: DataFrame, by: list[str], baseline: Column, least: int, alpha: float, **bounds) -> DataFrame:
    """Whether a direction may be shown: called often enough, better than a coin
    by a one-sided binomial test, and better than the baseline, which counts as
    a coin where it calls nothing."""
    from tidemark.functions.stats import binomial_pvalue

    ok = df.where("y is not null")
    (called, right), (base, base_right) = hits(c("p_up"), **bounds), hits(baseline, **bounds)
    n = ok.groupBy(*by).agg(F.count_if(called).alias("n"), F.count_if(right).alias("k"), F.count_if(base).alias("base_n"), F.count_if(base_right).alias("base_k"))
    n = n.withColumns({"p_value": F.when(c("n") > 0, binomial_pvalue("k", "n")).otherwise(1.0), "hit": F.try_divide("k", "n"), "base_hit": F.coalesce(F.try_divide("base_k", "base_n"), F.lit(0.5))})
    shown = (c("n") >= least) & (c("p_value") < alpha) & (c("hit") > c("base_hit"))
    return n.withColumn("enabled", F.coalesce(shown, F.lit(False)))


def score(df: DataFrame, by: list[str]) -> DataFrame:
    """n, coverage, pinball, and share and hits of called directions, by group."""
    low, high = f"`q{QUANTILES[0]:g}`", f"`q{QUANTILES[-1]:g}`"
    called, hit = hits(c("p_up"))
    loss = sum((pinball(c("y"), c(f"`q{q:g}`"), q) for q in QUANTILES), F.lit(0.0)) / len(QUANTILES)
    ok = df.where("y is not null and p_up is not null")
    return ok.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(((c("y") >= c(low)) & (c("y") <= c(high))).cast("double")).alias("coverage"),
        F.avg(loss).alias("pinball"),
        F.avg(called.cast("double")).alias("dir_share"),
        F.avg(F.when(called, hit.cast("double"))).alias("dir_hit"),
    )


class Forecaster:
    """Boosted quantiles and direction, corrected on a later part of the data.

    Each quantile has trees of its own (``boosting.QuantileForest``); where they
    would cross, a row's are put in order. The outer ones are widened until they
    hold as much of the second part as they should, and the chance of a rise is
    a boosted classifier's, made monotone against what happened there. The
    classifier takes the median of the first part for missing inputs.
    """

    def __init__(self, inputs: list[str], rounds: int = 16, **trees) -> None:
        self.inputs, self.rounds = inputs, rounds
        self.forest = QuantileForest(inputs, QUANTILES, rounds, **trees)

    def fit(self, train: DataFrame, valid: DataFrame) -> Forecaster:
        # Some hundred jobs read the first part: it is dealt to as many tasks as there are cores and kept.
        cores = train.sparkSession.sparkContext.defaultParallelism
        learnt = lambda df: df.where("y is not null").select("y", *self.inputs).withColumn("up", (c("y") > 0).cast("double")).repartition(cores)
        known = learnt(train).persist()
        try:
            self.forest.fit(known)
            counts = known.agg(*(F.count(x).alias(x) for x in self.inputs)).first()
            inputs = [x for x in self.inputs if counts[x]]  # one without any value has no median
            filled = [f"_{x}" for x in inputs]
            prepare = [Imputer(inputCols=inputs, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="features", handleInvalid="keep")]
            rise = GBTClassifier(featuresCol="features", labelCol="up", predictionCol="_up", maxIter=min(self.rounds, 10), maxDepth=3, seed=7)
            self.model = Pipeline(stages=[*prepare, rise]).fit(known)
        finally:
            known.unpersist()
        later = self._raw(learnt(valid)).persist()
        try:
            self.calibrator = IsotonicRegression(featuresCol="p_raw", labelCol="up", predictionCol="p_up").fit(later)
            outside = F.greatest(c("bands")[0] - c("y"), c("y") - c("bands")[len(QUANTILES) - 1])
            share = QUANTILES[-1] - QUANTILES[0]
            self.widen = max(0.0, later.agg(F.percentile_approx(outside, F.lit(share), F.lit(100_000))).first()[0] or 0.0)
        finally:
            later.unpersist()
        return self

    def _raw(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df.withColumn("bands", self.forest.predict([c(x) for x in self.inputs])))
        return out.withColumn("p_raw", vector_to_array("probability")[1])

    def predict(self, df: DataFrame) -> DataFrame:
        extra = {QUANTILES[0]: -self.widen, QUANTILES[-1]: self.widen}
        out = self.calibrator.transform(self._raw(df))
        return out.select(*df.columns, "p_up", *((c("bands")[k] + extra.get(q, 0.0)).alias(f"q{q:g}") for k, q in enumerate(QUANTILES)))


def holdout(df: DataFrame, share: float) -> DataFrame:
    """Marks each row calibrate, decide or purged: the last ``share`` of the days
    decide; earlier rows whose target is only known then are of no use.

    Days are few: the windows without a key are over them.
    """
    days = df.select(F.to_date("date").alias("_d")).distinct()
    order = Window.orderBy("_d")
    n = F.count("*").over(Window.partitionBy())
    first = days.withColumns({"_k": F.row_number().over(order), "_n": n}).where(c("_k") == c("_n") - F.round(c("_n") * share) + 1).select(c("_d").alias("_first"))
    late = F.to_date("date") >= c("_first")
    role = F.when(late, "decide").when(c("realized_at") < c("_first").cast("timestamp_ntz"), "calibrate").otherwise("purged")
    return df.join(F.broadcast(first)).withColumn("role", role).drop("_first")  # one row


def paired_bootstrap(daily: DataFrame, draws: int) -> DataFrame:
    """(p_value, low, high): one-sided p-value and 95 % interval of a mean
    difference by resampling days.

    ``daily`` has day, total and n; a draw picks as many days as there are, by
    hash. Days are few, so the draws are one row per draw and day.
    """
    from tidemark.functions.stats import uniform

    numbered = daily.withColumn("k", F.row_number().over(Window.orderBy("day")) - 1)
    size = numbered.agg(F.count("*").alias("m"))
    picks = numbered.select(c("k").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).join(F.broadcast(size))  # one row
    picks = picks.select("draw", F.floor(uniform(c("draw").cast("string"), c("slot").cast("string")) * c("m")).cast("int").alias("k"))
    means = picks.join(numbered.select("k", "total", "n"), "k").groupBy("draw").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("mean"))
    return means.agg(((F.count_if(c("mean") >= 0) + 1) / (draws + 1)).alias("p_value"), F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))
