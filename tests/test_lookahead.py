"""Deleting everything after a time must not change any result up to it."""

import pytest
from compare import DATA, rows
from pyspark.sql import functions as F

from tidemark.plans import market

CUT = "2024-01-18 00:00:00"
TIMED = ["sma", "rsi_sma", "bollinger", "vwap", "prev_high", "avg_value", "ema", "rsi_wilder", "listed_days", "stock_regime", "universe_reason", "cap_liq_groups", "attach_regimes", "price_segments", "pat_ma_cross", "pat_engulfing", "pat_macd_cross", "pat_stochastic_rebound"]


@pytest.fixture(scope="module")
def truncated(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("cut"))
    spark.read.parquet(f"{DATA}/events.parquet").where(F.col("ts") < F.lit(CUT).cast("timestamp_ntz")).write.parquet(f"{out}/events.parquet")
    # What a key is does not change with time.
    spark.read.parquet(f"{DATA}/part.parquet").write.parquet(f"{out}/part.parquet")
    return out


@pytest.mark.parametrize("name", TIMED)
def test_truncation(spark, truncated, name):
    before = market.QUERIES[name](spark, DATA).where(F.col("date") < F.lit(CUT).cast("timestamp_ntz")).toPandas()
    after = market.QUERIES[name](spark, truncated).toPandas()
    assert rows(before) == rows(after)


@pytest.mark.parametrize("n", ["1", "7"])
def test_partition_count_does_not_matter(spark, n):
    from tidemark.plans import trading

    usual = rows(trading.QUERIES["trades"](spark, DATA).toPandas())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        assert rows(trading.QUERIES["trades"](spark, DATA).toPandas()) == usual
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
