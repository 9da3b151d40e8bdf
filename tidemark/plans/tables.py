"""Scans, joins, set operations and windows over the star schema, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.documents import compare_stores
from tidemark.schema import table

c = F.col


def _t(spark, d, name):
    return table(spark, d, name)


def scan_filter_project(spark, d):
    """Filter and two columns reach the scan."""
    return _t(spark, d, "lineitem").where((c("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz")) & (c("l_quantity") > 40)).select("l_orderkey", "l_extendedprice")


def left_join_bars(spark, d):
    """Daily order totals with customer, nation and region kept where missing."""
    o, k, n, r = (_t(spark, d, x) for x in ("orders", "customer", "nation", "region"))
    j = o.join(k, c("o_custkey") == c("c_custkey"), "left").join(n, c("c_nationkey") == c("n_nationkey"), "left").join(r, c("n_regionkey") == c("r_regionkey"), "left")
    price = c("o_totalprice").cast("decimal(18,4)")
    return j.groupBy("r_name", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("orders"), F.sum(price).cast("double").alias("total"), F.max("o_totalprice").alias("largest"))


def dedup_first_wins(spark, d):
    order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return _t(spark, d, "lineitem").withColumn("k", F.row_number().over(order)).where("k = 1").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


def key_uniqueness(spark, d):
    """Keys that break uniqueness; a check passes when there is none."""
    return _t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").count().where("count > 1").agg(F.count("*").alias("broken"), F.coalesce(F.max("count"), F.lit(0)).alias("most"))


def semi_join(spark, d):
    return _t(spark, d, "customer").join(_t(spark, d, "orders").where("o_totalprice > 300000"), c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey", "c_name")


def anti_join(spark, d):
    return _t(spark, d, "customer").join(_t(spark, d, "orders"), c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey", "c_name")


def union_by_name(spark, d):
    """Two kinds of party, columns by name, what one lacks is NULL."""
    a = _t(spark, d, "supplier").select(c("s_name").alias("name"), c("s_acctbal").alias("balance"))
    b = _t(spark, d, "customer").select(c("c_mktsegment").alias("segment"), c("c_name").alias("name"))
    return a.unionByName(b, allowMissingColumns=True)


def except_keys(spark, d):
    return _t(spark, d, "part").select(c("p_partkey").alias("k")).subtract(_t(spark, d, "lineitem").where("l_quantity > 45").select(c("l_partkey").alias("k")))


def intersect_keys(spark, d):
    return _t(spark, d, "customer").select(c("c_nationkey").alias("k")).intersect(_t(spark, d, "supplier").select(c("s_nationkey").alias("k")))


def compare(spark, d):
    """A store against a copy with prices changed, rows added and removed."""
    old = _t(spark, d, "part").select("p_partkey", "p_name", "p_retailprice")
    changed = F.when(c("p_partkey") % 11 == 0, c("p_retailprice") + 1).otherwise(c("p_retailprice"))
    new = old.withColumn("p_retailprice", changed).withColumn("p_partkey", F.when(c("p_partkey") % 13 == 0, -c("p_partkey")).otherwise(c("p_partkey")))
    return compare_stores(old, new, ["p_partkey"], ["p_name", "p_retailprice"]).groupBy("state").agg(F.count("*").alias("n"))


def latest_revision(spark, d):
    """Latest order of each customer, by date then key."""
    newest = F.max_by(F.struct("o_orderkey", "o_orderdate", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey")).alias("o")
    return _t(spark, d, "orders").groupBy("o_custkey").agg(newest).select("o_custkey", "o.o_orderkey", "o.o_orderdate", "o.o_orderstatus")


def append_revisions(spark, d):
    """Rows of a new delivery that the store does not have yet, by key and hash."""
    h = lambda df: df.select("o_orderkey", F.md5(F.concat_ws("|", "o_orderstatus", "o_orderpriority")).alias("hash"))
    old = h(_t(spark, d, "orders"))
    new = h(_t(spark, d, "orders").withColumn("o_orderstatus", F.when(c("o_orderkey") % 9 == 0, "X").otherwise(c("o_orderstatus"))))
    return new.join(old, ["o_orderkey", "hash"], "left_anti")


def nulls_last_order(spark, d):
    """Ranks by a mixed order in which missing totals come last."""
    t = _t(spark, d, "customer").join(_t(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top")), c("c_custkey") == c("o_custkey"), "left")
    order = Window.partitionBy("c_mktsegment").orderBy(c("top").desc_nulls_last(), "c_custkey")
    return t.select("c_custkey", "c_mktsegment", F.row_number().over(order).alias("place"))


def page_of_orders(spark, d):
    return _t(spark, d, "orders").orderBy(c("o_totalprice").desc(), "o_orderkey").offset(20).limit(20).select("o_orderkey", "o_totalprice")


def daily_returns(spark, d):
    """Weekly mean price of each nation, its change, and running peak."""
    j = _t(spark, d, "orders").join(_t(spark, d, "customer"), c("o_custkey") == c("c_custkey"))
    bars = j.groupBy(c("c_nationkey").alias("k"), F.date_trunc("week", "o_orderdate").alias("week")).agg((F.sum(c("o_totalprice").cast("decimal(18,4)")).cast("double") / F.count("*")).alias("close"))
    w = Window.partitionBy("k").orderBy("week")
    return bars.select("k", "week", F.round(c("close") / F.lag("close").over(w) - 1, 6).alias("ret"), F.round(F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("peak"))


def mode_median(spark, d):
    p = _t(spark, d, "part")
    counts = p.groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    mode = counts.groupBy("p_brand").agg(F.min_by("p_size", F.struct((-c("n")).alias("a"), c("p_size").alias("b"))).alias("mode_size"))
    return p.groupBy("p_brand").agg(F.median("p_size").alias("median_size"), F.percentile("p_retailprice", F.lit(0.9)).alias("p90")).join(mode, "p_brand").select("p_brand", "median_size", F.round("p90", 6).alias("p90"), "mode_size")


def json_props(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return _t(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.max(k).alias("most"))


def tumbling(spark, d):
    e = _t(spark, d, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum(c("value").cast("decimal(18,4)")), 4).cast("double").alias("total"))


def sliding(spark, d):
    e = _t(spark, d, "events").withColumn("start", F.explode(F.array(F.date_trunc("hour", "ts"), F.date_trunc("hour", "ts") - F.expr("interval 1 hour"))))
    return e.groupBy("start", "event_type").agg(F.count("*").alias("n"))


def session(spark, d):
    """Sessions of a user: gaps of up to 30 hours."""
    w = Window.partitionBy("user_id").orderBy("ts")
    gap = F.col("ts") - F.lag("ts").over(w) > F.expr("interval 30 hours")
    e = _t(spark, d, "events").withColumn("new", F.coalesce(gap, F.lit(True)).cast("int"))
    e = e.withColumn("s", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "s").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n")).drop("s")


QUERIES = {
    f.__name__: f
    for f in (scan_filter_project, left_join_bars, dedup_first_wins, key_uniqueness, semi_join, anti_join, union_by_name, except_keys, intersect_keys)
    + (latest_revision, append_revisions, nulls_last_order, page_of_orders, daily_returns, mode_median, json_props, tumbling, sliding, session)
} | {"compare_stores": compare}

_PART = "CASE WHEN p_partkey % 13 = 0 THEN -p_partkey ELSE p_partkey END AS k, p_name, CASE WHEN p_partkey % 11 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS r"
SQL = {
    "scan_filter_project": "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_quantity > 40",
    "left_join_bars": "SELECT r_name, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total, max(o_totalprice) AS largest FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "dedup_first_wins": "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1",
    "key_uniqueness": "SELECT count(*) AS broken, coalesce(max(n), 0) AS most FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)",
    "semi_join": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "anti_join": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "union_by_name": "SELECT s_name AS name, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL SELECT c_name, NULL, c_mktsegment FROM customer",
    "except_keys": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45",
    "intersect_keys": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "compare_stores": f"WITH o AS (SELECT p_partkey AS k, p_name, p_retailprice AS r FROM part), n AS (SELECT {_PART} FROM part) SELECT CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN o.p_name = n.p_name AND o.r = n.r THEN 'same' ELSE 'changed' END AS state, count(*) AS n FROM o FULL JOIN n ON o.k = n.k GROUP BY 1",
    "latest_revision": "SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "append_revisions": "WITH o AS (SELECT o_orderkey, md5(o_orderstatus || '|' || o_orderpriority) AS hash FROM orders), n AS (SELECT o_orderkey, md5(CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END || '|' || o_orderpriority) AS hash FROM orders) SELECT * FROM n ANTI JOIN o USING (o_orderkey, hash)",
    "nulls_last_order": "WITH t AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY 1) SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY top DESC NULLS LAST, c_custkey) AS place FROM customer LEFT JOIN t ON o_custkey = c_custkey",
    "page_of_orders": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 20",
    "daily_returns": "WITH b AS (SELECT c_nationkey AS k, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS week, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS close FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT k, week, round(close / lag(close) OVER (PARTITION BY k ORDER BY week) - 1, 6) AS ret, round(max(close) OVER (PARTITION BY k ORDER BY week ROWS UNBOUNDED PRECEDING), 4) AS peak FROM b",
    "mode_median": "WITH n AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2), m AS (SELECT p_brand, p_size AS mode_size FROM n QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) = 1) SELECT p.p_brand, median(p_size) AS median_size, round(quantile_cont(p_retailprice, 0.9), 6) AS p90, any_value(mode_size) AS mode_size FROM part p JOIN m ON m.p_brand = p.p_brand GROUP BY 1",
    "json_props": "SELECT event_type, CAST(sum(CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT)) AS BIGINT) AS total, max(CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT)) AS most FROM events GROUP BY 1",
    "tumbling": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, CAST(round(sum(CAST(value AS DECIMAL(18,4))), 4) AS DOUBLE) AS total FROM events GROUP BY 1, 2",
    "sliding": """WITH x AS (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS "start", event_type FROM events) SELECT "start", event_type, count(*) AS n FROM x GROUP BY 1, 2""",
    "session": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS "start", max(ts) AS "end", count(*) AS n FROM s GROUP BY user_id, s""",
}
