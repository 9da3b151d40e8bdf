"""All registered queries and their SQL oracles."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import functions as F

from tidemark.operators.patterns import with_signal
from tidemark.schema import ebars

MODULES = ("market", "trading", "documents", "forecasting", "tables", "streams", "ingest", "retrieval", "stores")


def flagship(spark, sf_dir):
    """Crossings of a short over a longer moving average, counted by key."""
    bars = with_signal(ebars(spark, sf_dir), "ma_cross", fast=3, slow=8)
    return bars.groupBy("ticker").agg(F.count("*").alias("bars"), F.count_if("signal").alias("signals"))


def _merged(name):
    out = {}
    for module in MODULES:
        out |= getattr(import_module(f"tidemark.plans.{module}"), name)
    return out


def queries():
    return _merged("QUERIES") | {"flagship": flagship}


def oracle_sql():
    from tidemark.plans.market import EBARS_SQL, s_lag, s_mean

    flag = f"WITH {EBARS_SQL}, a AS (SELECT *, {s_mean('close', 3)} AS f, {s_mean('close', 8)} AS s FROM ebars), b AS (SELECT ticker, volume > 0 AND coalesce({s_lag('f')} <= {s_lag('s')} AND f > s, false) AS x FROM a) SELECT ticker, count(*) AS bars, count(*) FILTER (x) AS signals FROM b GROUP BY 1"
    return _merged("SQL") | {"flagship": flag}
