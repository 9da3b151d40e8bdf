"""Declared schemas, default parameters and the adapters of the supplied tables.

The engine works on keyed bars, versioned documents and minute rows. The
supplied tables are mapped onto those shapes here, so every operator below
takes plain DataFrames of a fixed schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parameters of indicators and regimes as used by the registered queries;
#: scaled to the supplied data, where a key has some hundred bars.
DEFAULTS = {
    "sma_fast": 5,
    "sma_slow": 20,
    "rsi": 14,
    "bollinger": 20,
    "bollinger_k": 2.0,
    "vwap": 20,
    "value": 20,
    "regime_ma": 60,
    "regime_slope": 10,
    "regime_band": 0.01,
    "min_listed": 40,
    "min_value": 100.0,
    "cost": 0.003,
    "min_trades": 30,
}

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ebars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the events: one key per event type and user group.

    First and last are taken by (ts, event_id), which is unique.
    """
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    at = F.struct("ts", "event_id")
    keyed = e.withColumn("ticker", F.concat_ws("-", "event_type", (F.col("user_id") % 4).cast("string"))).withColumn("date", F.date_trunc("hour", "ts"))
    return keyed.groupBy("ticker", "date").agg(
        F.min_by("value", at).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", at).alias("close"),
        F.count("*").alias("volume"),
        F.round(F.sum(F.col("value").cast("decimal(18,4)")), 4).cast("double").alias("value"),
    )


#: The same bars in DuckDB, as a WITH clause that other oracles build on.
EBARS_SQL = """e AS (SELECT event_id, ts, event_type || '-' || CAST(user_id % 4 AS VARCHAR) AS ticker, date_trunc('hour', ts) AS date, value AS v FROM events),
ebars AS (SELECT ticker, date, arg_min(v, row(ts, event_id)) AS open, max(v) AS high, min(v) AS low, arg_max(v, row(ts, event_id)) AS close,
  count(*) AS volume, CAST(round(sum(CAST(v AS DECIMAL(18,4))), 4) AS DOUBLE) AS value FROM e GROUP BY 1, 2)"""


def market_of(ticker) -> F.Column:
    """Market label of a key: parity of its user group."""
    return F.when(F.substring_index(ticker, "-", -1).cast("int") % 2 == 0, F.lit("M0")).otherwise(F.lit("M1"))


MARKET_SQL = "CASE WHEN CAST(split_part(ticker, '-', 2) AS INT) % 2 = 0 THEN 'M0' ELSE 'M1' END"


def index_frame(bars: DataFrame) -> DataFrame:
    """One index per market: the mean open and close of its keys that hour."""
    return bars.groupBy(market_of("ticker").alias("market"), "date").agg(
        F.round(F.avg(F.col("open").cast("decimal(18,6)")), 8).cast("double").alias("index_open"),
        F.round(F.avg(F.col("close").cast("decimal(18,6)")), 8).cast("double").alias("index_close"),
    )


INDEX_SQL = f"""idx AS (SELECT {MARKET_SQL} AS market, date, round(CAST(sum(CAST(open AS DECIMAL(18,6))) AS DOUBLE) / count(*), 8) AS index_open,
  round(CAST(sum(CAST(close AS DECIMAL(18,6))) AS DOUBLE) / count(*), 8) AS index_close FROM ebars GROUP BY 1, 2)"""


def doc_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versioned documents from the conversations: a turn is a version."""
    c = table(spark, sf_dir, "conversations")
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    at = F.make_dt_interval(F.lit(0), (F.col("conv_id") % 500 + 3 * F.col("turn")).cast("int"))
    return c.select(
        F.col("conv_id").alias("doc_id"),
        F.col("turn").alias("version"),
        F.col("role").alias("source"),
        F.col("text").alias("title"),
        (base + at).alias("available_at"),
        (base + at + F.make_dt_interval(F.lit(0), (F.col("conv_id") % 7).cast("int"))).alias("first_seen_at"),
    )


DOCS_SQL = """docs AS (SELECT conv_id AS doc_id, turn AS version, role AS source, text AS title,
  TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id % 500 + 3 * turn AS INT)) AS available_at,
  TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id % 500 + 3 * turn + conv_id % 7 AS INT)) AS first_seen_at FROM conversations)"""
