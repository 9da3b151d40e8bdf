"""Streaming queries, checked against what a batch over the same rows gives."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tidemark.operators import bars as br
from tidemark.plans.documents import _VC
from tidemark.plans.forecasting import _SLOTS
from tidemark.schema import DOCS_SQL, doc_versions, table
from tidemark.sources.commits import CommitLog
from tidemark.sources.sinks import shared_path
from tidemark.streaming import observed as ob
from tidemark.streaming import pages as pg
from tidemark.streaming import streams as st

c = F.col


def _events(spark, d):
    return st.read_stream(spark, f"{d}/events.parquet")


def stream_bars(spark, d):
    return st.drain(st.finished_bars(_events(spark, d)), "stream-bars")


def stream_slots(spark, d):
    rows = _events(spark, d).select(c("event_type").alias("code"), "ts", "event_id", "value")
    bars = st.drain(st.finished_slots(rows, br.SLOT_EDGES["3h"]), "stream-slots")
    return bars.select("code", c("day").cast("string").alias("day"), "slot", "open", "high", "low", "close", F.round("value", 4).alias("value"), "rows", "bar_start", "available_at", "bar_minutes")


def stream_dedup(spark, d):
    return st.drain(st.first_seen(_events(spark, d), ["event_type", "user_id"]), "stream-dedup")


def stream_versions(spark, d):
    docs = st.read_stream(spark, f"{d}/conversations.parquet").select(c("conv_id").alias("doc_id"), c("turn").alias("version"), c("text").alias("title"))
    return st.drain(st.classify_stream(docs), "stream-versions")


def stream_observed(spark, d):
    """Versions seen before and after a restart, with their availability, and
    the closings of documents that were quiet for 90 minutes."""
    at = shared_path(spark, "stream-observed")
    v = doc_versions(spark, d).select("doc_id", "title", F.to_date("available_at").alias("published"), c("first_seen_at").cast("timestamp").alias("observed"))
    half = c("observed") < F.lit("2024-01-10").cast("timestamp")
    before = spark.conf.get(ob.STATE_STORE[0])
    spark.conf.set(*ob.STATE_STORE)
    try:
        for part in (half, ~half):
            v.where(part).write.mode("append").parquet(f"{at}/in")
            rows = spark.readStream.schema(v.schema).parquet(f"{at}/in")
            out = st.drain(ob.observe(rows, timedelta(minutes=90)), "stream-observed", f"{at}/out")
    finally:
        spark.conf.set(ob.STATE_STORE[0], before)
    return out.withColumns({x: c(x).cast("timestamp_ntz") for x in ("observed", "available")})


def stream_pages(spark, d):
    """Pages of customers in two deliveries; some pages of the second state a
    wrong number at first, which leaves the table of the first."""
    at = shared_path(spark, "stream-pages")
    n = F.floor(c("c_custkey") / 100)
    item = F.struct(c("c_custkey").alias("id"), F.when(c("c_custkey") % 5 != 0, c("c_name")).alias("title"))
    pages = table(spark, d, "customer").groupBy(n.alias("n")).agg(F.count("*").alias("total"), F.collect_list(item).alias("items"))
    first, name = c("n") % 3 == 0, F.concat(F.when(c("n") % 3 == 0, "a").otherwise("b"), F.lpad(c("n").cast("string"), 9, "0"))
    named = pages.select(first.alias("first"), name.alias("name"), c("total"), "items")
    bad = named.where(~c("first")).drop("first").withColumn("total", c("total") + F.when(F.substring("name", -1, 1).cast("int") % 2 == 1, 1).otherwise(0))
    states = []
    for delivery in (named.where("first").drop("first"), bad, named.where(~c("first")).drop("first")):
        pg.deliver(delivery, f"{at}/pages")
        states.append(pg.refresh(spark, f"{at}/pages", f"{at}/store"))
    rows = CommitLog(spark, f"{at}/store/rows").read()
    out = rows.groupBy(F.substring("page", 1, 1).alias("delivery")).agg(F.count("*").alias("items"), F.count("title").alias("titles"), F.sum("id").alias("ids"))
    return out.withColumn("went", F.lit(",".join(f"{x['status']}{x['number']}" for x in states)))


QUERIES = {f.__name__: f for f in (stream_bars, stream_slots, stream_dedup, stream_versions, stream_observed, stream_pages)}

SQL = {
    "stream_bars": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, max(value) AS high, min(value) AS low FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR",
    "stream_slots": f"WITH {_SLOTS} SELECT * FROM sb WHERE available_at <= (SELECT max(available_at) FROM sb) - INTERVAL 1 HOUR",
    "stream_dedup": "SELECT DISTINCT event_type, user_id, date_trunc('hour', ts) AS hour FROM events",
    "stream_versions": f"WITH {DOCS_SQL}, {_VC} SELECT doc_id, version, hash, kind FROM vc",
    "stream_observed": f"""WITH {DOCS_SQL}, o AS (SELECT doc_id, substr(sha256(title), 1, 16) AS hash, first_seen_at AS observed, first_seen_at >= TIMESTAMP '2024-01-10' AS after,
  CASE WHEN CAST(available_at AS DATE) < CAST(first_seen_at AS DATE) THEN CAST(available_at AS DATE) + INTERVAL 1 DAY ELSE first_seen_at END AS own FROM docs WHERE doc_id IS NOT NULL AND title IS NOT NULL AND first_seen_at IS NOT NULL),
m AS (SELECT max(observed) FILTER (NOT after) AS mark, max(observed) AS mark2 FROM o), l AS (SELECT doc_id, max(observed) FILTER (NOT after) AS seen FROM o GROUP BY 1),
g AS (SELECT o.*, coalesce(after AND seen + INTERVAL 90 MINUTE < mark, false) AS anew FROM o JOIN l USING (doc_id), m),
k AS (SELECT *, lag(hash) OVER w AS b FROM g WINDOW w AS (PARTITION BY doc_id, anew ORDER BY observed, hash)), v AS (SELECT *, CASE WHEN b IS NULL THEN 'new' WHEN b = hash THEN 'duplicate' ELSE 'changed' END AS kind FROM k),
x AS (SELECT *, count(*) FILTER (kind <> 'duplicate') OVER w AS version, max(own) FILTER (kind <> 'duplicate') OVER w AS available FROM v WINDOW w AS (PARTITION BY doc_id, anew ORDER BY observed, hash ROWS UNBOUNDED PRECEDING))
SELECT doc_id, version, hash, kind, observed, available, NULL AS forms FROM x
UNION ALL SELECT doc_id, max(version), arg_max(hash, row(observed, hash)), 'closed', max(observed), max(available), count(DISTINCT hash) FROM x, m GROUP BY doc_id, anew, mark2 HAVING max(observed) + INTERVAL 90 MINUTE < mark2""",
    "stream_pages": """SELECT CASE WHEN c_custkey // 100 % 3 = 0 THEN 'a' ELSE 'b' END AS delivery, count(*) AS items, count(*) FILTER (c_custkey % 5 <> 0) AS titles, CAST(sum(c_custkey) AS BIGINT) AS ids,
  (SELECT CASE WHEN bool_or(c_custkey // 100 % 3 <> 0 AND c_custkey // 100 % 2 = 1) THEN 'ok1,stale1,ok2' WHEN bool_or(c_custkey // 100 % 3 <> 0) THEN 'ok1,ok2,ok2' ELSE 'ok1,ok1,ok1' END FROM customer) AS went FROM customer GROUP BY 1""",
}
