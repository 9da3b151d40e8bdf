"""Round trips through stores: written to the shared folder, read by the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import documents as dc
from tidemark.operators import indicators as ind
from tidemark.plans.market import s_mean
from tidemark.schema import DOCS_SQL, EBARS_SQL, INDEX_SQL, doc_versions, ebars, index_frame, market_of, table
from tidemark.sources import readers as rd
from tidemark.sources import sinks as sk
from tidemark.sources.commits import CommitLog, Refused, Revisions
from tidemark.sources.sinks import shared_path

c = F.col
END = "2024-01-20"


def _prices(spark, d):
    """Last bar of each key and day."""
    b = ebars(spark, d).withColumn("day", F.to_date("date"))
    last = b.groupBy("ticker", c("day").alias("d")).agg(*(F.max_by(x, "date").alias(x) for x in ("open", "high", "low", "close", "volume", "value")))
    return last.select(c("d").alias("date"), "ticker", F.when(F.day("d") % 6 == 0, -1.0).otherwise(c("open")).alias("open"), "high", "low", "close", c("volume").cast("double").alias("volume"), "value")


def store_daily_bars(spark, d):
    """Prices, market values and master data written, then read with filters."""
    at, p = shared_path(spark, "daily"), _prices(spark, d)
    p.write.parquet(f"{at}/prices.parquet")
    p.where("day(date) % 2 = 0").select("date", "ticker", F.round(c("close") * 1000).cast("bigint").alias("marketcap"), F.lit(1000).cast("bigint").alias("shares"), market_of("ticker").alias("market")).write.parquet(f"{at}/marketcap.parquet")
    master = p.select("ticker").distinct().select("ticker", c("ticker").alias("name"), market_of("ticker").alias("market"), F.lit("s").alias("sector"), F.lit(None).cast("date").alias("listing_date"), F.lit("common").alias("kind"), c("ticker").endswith("3").alias("is_delisted"))
    master.write.parquet(f"{at}/master.parquet")
    r = rd.daily_bars(spark, at, end=END)
    return r.select(c("date").cast("string").alias("date"), "ticker", "open", "close", "marketcap", "kind", "is_delisted", "halted")


def store_raw_daily(spark, d):
    """Unadjusted rows, a file a day; distinct keys of a sample as filter."""
    at = shared_path(spark, "raw")
    p = _prices(spark, d).select("date", "ticker", c("ticker").alias("name"), market_of("ticker").alias("market"), F.lit("d").alias("dept"), *(c(x).alias(f"{x}_raw") for x in ("open", "high", "low", "close", "volume")), "value", F.lit(1).cast("bigint").alias("marketcap"), F.lit(1).cast("bigint").alias("shares"))
    p.repartition("date").write.parquet(f"{at}/raw/krx_daily")
    sample = [r[0] for r in table(spark, d, "events").select(F.concat("event_type", F.lit("-1")).alias("t")).distinct().collect()]  # a sample list of keys
    return rd.raw_daily(spark, at, sample).groupBy("ticker").agg(F.count("*").alias("days"), F.max("close_raw").alias("most"))


def store_index(spark, d):
    at = shared_path(spark, "index")
    i = index_frame(ebars(spark, d)).where(F.hour("date") == 12).select(F.to_date("date").alias("date"), c("market").alias("index"), c("index_open").alias("open"), c("index_open").alias("high"), c("index_open").alias("low"), c("index_close").alias("close"), F.lit(0.0).alias("volume"))
    i.write.parquet(f"{at}/index.parquet")
    return rd.index_bars(spark, at, END).select(c("date").cast("string").alias("date"), "market", F.round("close", 6).alias("close"))


def store_sectors(spark, d):
    """Snapshots of three days as files of their own; a stray file is not read."""
    at, p = shared_path(spark, "sectors"), _prices(spark, d)
    for day in ("2024-01-05", "2024-01-12", "2024-01-19"):
        p.where(c("date") == day).select("date", "ticker", F.concat(F.lit("s"), (F.floor("close") % 4).cast("string")).alias("sector")).coalesce(1).write.mode("append").parquet(f"{at}/raw/sector")
    return rd.sector_snapshots(spark, at).groupBy(c("date").cast("string").alias("date"), "sector").agg(F.count("*").alias("n"))


def store_optional(spark, d):
    """A source that is there and one that is not."""
    at = shared_path(spark, "optional")
    _prices(spark, d).groupBy("ticker").agg(F.min("date").alias("first_date")).write.parquet(f"{at}/first.parquet")
    there, missing = rd.optional(spark, f"{at}/first.parquet"), rd.optional(spark, f"{at}/none.parquet")
    return there.select("ticker", c("first_date").cast("string").alias("first"), F.lit(missing is None).alias("other_missing"))


def store_minutes(spark, d):
    """Tab-separated rows to months and back, with months and keys pruned."""
    at = shared_path(spark, "minutes")
    e = table(spark, d, "events")
    ts = F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd HH:mm:ss")
    e.select("event_type", ts.alias("dt"), *(F.floor("value").cast("int").alias(x) for x in ("open_p", "high_p", "low_p", "close_p")), F.lit(1).alias("volume"), F.floor("value").cast("bigint").alias("value")).write.option("sep", "\t").csv(f"{at}/tsv")
    sk.append_months(rd.minutes_from_tsv(spark, f"{at}/tsv"), f"{at}/store")
    r = rd.minutes(spark, f"{at}/store", ["click", "error"], "2024-01-05 00:00:00", "2024-01-20 00:00:00")
    return r.groupBy("code").agg(F.count("*").alias("rows"), F.sum("value").alias("value"), F.min("dt").alias("first"))


def manifest_check(spark, d):
    """Rows by month of a written store against a manifest with one wrong month and one too many."""
    at = shared_path(spark, "manifest")
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMM").alias("ym"))
    sk.append_months(o, at)
    stated = {r["ym"]: r["count"] for r in o.groupBy("ym").count().collect()}  # one row a month
    stated |= {"199501": stated.get("199501", 0) + 2, "190001": 5}
    return rd.manifest_faults(spark.read.parquet(at).withColumn("ym", c("ym").cast("string")), stated)


def store_documents(spark, d):
    """Committed versions are read, what another writer has not finished is not."""
    at = shared_path(spark, "docs")
    v = doc_versions(spark, d).select(c("doc_id").cast("string").alias("doc_id"), "version", "source", F.date_format("available_at", "yyyy-MM").alias("date"), "title")
    v.where("version < 4").write.partitionBy("source", "date").parquet(f"{at}/docs")
    v.where("version >= 4").coalesce(1).write.json(f"{at}/docs/unfinished.tmp")
    return rd.documents(spark, f"{at}/docs").groupBy("doc_id").agg(F.max("version").alias("version"), F.count("*").alias("n"))


def store_two_phase(spark, d):
    """Two runs staged, one committed before a loss: recovery keeps it and drops the other."""
    at = shared_path(spark, "months")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy").alias("ym"))
    for run, part in (("a", 0), ("b", 1), ("c", 2)):
        sk.stage_months(o.where(c("o_orderkey") % 3 == part), at, run)
    sk.commit_months(spark, at, "a")
    fs, mark = sk._fs(spark, f"{at}/_committed/c")
    fs.create(mark, False).close()  # lost between the mark and the moves
    finished, discarded = sk.recover_months(spark, at)
    sk.commit_months(spark, at, "a")  # again: nothing moves twice
    return spark.read.parquet(at).groupBy(c("ym").cast("string").alias("year")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys")).withColumns({"finished": F.lit(finished), "discarded": F.lit(discarded)})


def store_prepared(spark, d):
    """A prepared table is built once and read the second time."""
    at = shared_path(spark, "prepared")
    build = lambda: index_frame(ebars(spark, d)).groupBy("market").agg(F.count("*").alias("rows"))
    _, before = sk.prepared(spark, at, {"n": 1, "data": d}, build)
    again, after = sk.prepared(spark, at, {"data": d, "n": 1}, build)
    return again.withColumns({"before": F.lit(before), "after": F.lit(after)})


def store_keyed(spark, d):
    """Bars stored by key for as long as their events stay; the mean reads them without an exchange."""
    at = shared_path(spark, "keyed")
    build = lambda: ebars(spark, d).select("ticker", "date", "close")
    keep = {"sources": (f"{d}/events.parquet",), "key": "ticker", "order": ("date",)}
    _, before = sk.prepared(spark, at, {"bars": "hourly"}, build, **keep)
    again, after = sk.prepared(spark, at, {"bars": "hourly"}, build, **keep)
    return again.select("ticker", "date", F.round(ind.sma(5), 6).alias("sma"), F.lit(before).alias("before"), F.lit(after).alias("after"))


def store_raw_json(spark, d):
    """Raw bodies appended twice as compressed JSON lines, then decoded."""
    at = shared_path(spark, "json")
    k = table(spark, d, "nation").select(c("n_name").alias("title"), F.concat(F.lit("http://x/"), c("n_nationkey").cast("string")).alias("link"), F.lit("Mon, 1 Jan 2024 09:00:00 +0900").alias("pubDate"), c("n_regionkey").alias("r"))
    items = F.collect_list(F.struct(F.when(c("title") != "n", c("title")).alias("title"), F.when(c("r") != 2, c("link")).alias("link"), "pubDate"))
    bodies = k.groupBy("r").agg(F.to_json(F.struct(F.count("*").cast("string").alias("total"), items.alias("items"))).alias("body"))
    sk.append_raw(bodies.where("r < 2"), at)
    sk.append_raw(bodies.where("r >= 2"), at)
    page = rd.decode_search_page(spark.read.schema("r long, body string").json(at))
    return page.select("title", "link", F.unix_timestamp("published_at").alias("at"))


def store_feed(spark, d):
    """RSS and Atom bodies, some items without link or date."""
    k = table(spark, d, "nation").select(c("n_nationkey").alias("k"), "n_name")
    s = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    key = c("k").cast("string")
    rss = s("<rss><channel><item><title>", c("n_name"), "</title>", F.when(c("k") % 3 == 0, "").otherwise(s("<link>u", key, "</link>")), "</item><item><title>two</title><link>v", key, "</link><pubDate>d</pubDate></item></channel></rss>")
    atom = s("<feed><entry><title>", c("n_name"), '</title><link href="a', key, '"/><updated>e</updated></entry></feed>')
    return rd.decode_feed(k.select(F.when(c("k") % 2 == 0, rss).otherwise(atom).alias("body")))


def store_dump(spark, d):
    """Rows of one table out of a dump that inserts into two."""
    at = shared_path(spark, "dump")
    n = table(spark, d, "nation")
    tuples = lambda k: F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("("), c("n_nationkey").cast("string"), F.lit(",'"), c("n_name"), F.lit(f", {k}',NULL)")))), ",\n")
    sql = n.agg(F.concat(F.lit("CREATE TABLE x;\nINSERT INTO `prices` VALUES\n"), tuples("p"), F.lit(";\nINSERT INTO `other` VALUES\n"), tuples("o"), F.lit(";\nUNLOCK TABLES;\n")).alias("value"))
    sql.write.text(at)
    return rd.dump_rows(spark, at, "prices").select(F.get("values", F.lit(0)).cast("long").alias("k"), F.get("values", F.lit(1)).alias("name"), F.get("values", F.lit(2)).isNull().alias("none"))


def store_predictions(spark, d):
    """A forecast run published as a whole: one key's rows and the range of its times."""
    at = shared_path(spark, "run")
    p = ebars(spark, d).select(c("ticker").alias("code"), c("date").alias("as_of"), F.round(c("close"), 4).alias("base_close"), F.lit(1).alias("h"))
    sk.publish(spark, at, {"predictions": p, "scores": p.groupBy("h").count()}, {"timeframe": "1h"})
    span = rd.as_of_range(spark, at)
    one = rd.predictions(spark, at, "click-1").agg(F.count("*").alias("rows"), F.max("base_close").alias("most"))
    return one.join(F.broadcast(span))  # one row each


def store_coverage(spark, d):
    """The state of each day replaced as a whole, read back by number."""
    at = shared_path(spark, "coverage")
    log = table(spark, d, "events").select(c("event_id").alias("seq"), c("event_type").alias("source"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.lit("Y").alias("corp_cls"), F.when(c("event_id") % 4 == 0, "gap").otherwise("collected").alias("state"), F.lit("r").alias("run_id"), F.lit("t").alias("observed_at"))
    store = CommitLog(spark, f"{at}/coverage")
    store.replace(log.where("seq < 200"))
    store.replace(log)
    rolled = []
    for number in (1, 2):
        s = dc.coverage_state(rd.coverage_log(spark, at, number), ["source", "day"])
        rolled.append(s.groupBy("source").agg(F.lit(number).alias("number"), F.count("*").alias("days"), F.count_if(c("state") == "gap").alias("gaps")))
    return rolled[0].unionByName(rolled[1])


def store_revisions(spark, d):
    """Orders delivered, delivered with changes, again, and without some of their
    keys: two revisions of what changed, nothing for the repetition, a refusal."""
    store = Revisions(spark, shared_path(spark, "revisions"), ["o_orderkey"])
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    changed = o.withColumn("o_orderstatus", F.when(c("o_orderkey") % 9 == 0, "X").otherwise(c("o_orderstatus")))
    store.deliver(o)
    second, third = store.deliver(changed), store.deliver(changed)
    refused = 0
    for part, within in (("o_orderkey % 7 <> 0", None), ("o_orderkey % 7 = 0", "o_orderkey % 7 = 0")):
        try:
            store.deliver(changed.where(part), within)
        except Refused:
            refused += 1
    return store.current().groupBy("o_orderstatus", "revision").agg(F.count("*").alias("keys"), F.lit(third - second).alias("again"), F.lit(refused).alias("refused"))


def store_commits(spark, d):
    """Two writers start from one snapshot; the one that comes second starts
    again, and every number still reads as it was."""
    store = CommitLog(spark, shared_path(spark, "commits"))
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    store.append(o.where("o_orderkey % 3 = 0"))
    other = []

    def top_up(old):
        if not other:
            other.append(store.append(o.where("o_orderkey % 3 = 1")))
        return o.join(old, "o_orderkey", "left_anti")

    store.change(top_up)
    store.compact()
    reads = [store.read(k).groupBy("o_orderstatus").agg(F.lit(k).alias("number"), F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys")) for k in range(1, store.last() + 1)]
    out = reads[0]
    for r in reads[1:]:
        out = out.unionByName(r)
    return out


def store_influence(spark, d):
    """Models published with their weights; the last one trained before a day is
    picked, its rows in the order of display."""
    at = shared_path(spark, "models")
    w = table(spark, d, "customer").groupBy(c("c_mktsegment").alias("grp")).agg(F.count("*").alias("n"), F.round(F.avg(c("c_acctbal").cast("decimal(18,4)")).cast("double"), 4).alias("w"))
    for k, end in enumerate(("2024-01-05", "2024-01-12", "2024-01-25")):
        sk.publish(spark, f"{at}/m{k}", {"weights": w.withColumn("weight", F.round(c("w") - k * 4400, 4)).drop("w"), "meta": spark.createDataFrame([(f"m{k}", end)], "model string, train_end string")}, {"format_version": 1})
    meta = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").schema("model string, train_end string").parquet(*[f"{at}/m{k}/meta.parquet" for k in range(3)])
    picked = meta.where("train_end < '2024-01-20'").agg(F.max_by("model", F.struct("train_end", "model"))).first()[0]  # one name
    rows = spark.read.parquet(f"{at}/{picked}/weights.parquet").withColumn("sample_ok", c("n") >= 28)
    order = F.row_number().over(dc.Window.orderBy((~c("sample_ok")).cast("int"), F.abs("weight").desc(), "grp"))
    return rows.select(F.lit(picked).alias("model"), "grp", "weight", "sample_ok", order.alias("place"))


def snapshot_faults(spark, d):
    """Documents against a manifest that states one source too few and one wrongly."""
    v = doc_versions(spark, d)
    rows = v.select("doc_id", "version", "source", F.to_json(F.struct("doc_id", "version", "title")).alias("document"))
    rows = rows.withColumn("record_sha256", F.when((c("source") == "user") & (c("version") == 2), "0").otherwise(F.sha2("document", 256)))
    counts = rows.groupBy("source").agg(F.count("*").alias("document_versions"))
    stated = counts.where("source <> 'system'").withColumn("document_versions", F.when(c("source") == "assistant", c("document_versions") + 1).otherwise(c("document_versions")))
    return rd.verified_snapshot(rows, stated)


QUERIES = {
    f.__name__: f
    for f in (store_daily_bars, store_raw_daily, store_index, store_sectors, store_optional, store_minutes, manifest_check, store_documents, store_two_phase, store_prepared, store_keyed, store_raw_json, store_feed, store_dump)
    + (store_predictions, store_coverage, store_revisions, store_commits, store_influence, snapshot_faults)
}

_PRICES = "pr AS (SELECT CAST(date AS DATE) AS date, ticker, CASE WHEN day(CAST(date AS DATE)) % 6 = 0 THEN NULL ELSE arg_max(open, date) END AS open, arg_max(close, date) AS close FROM ebars GROUP BY CAST(date AS DATE), ticker)"

SQL = {
    "store_daily_bars": f"WITH {EBARS_SQL}, {_PRICES} SELECT CAST(date AS VARCHAR) AS date, ticker, CASE WHEN open > 0 THEN open END AS open, close, CASE WHEN day(date) % 2 = 0 THEN CAST(round(close * 1000) AS BIGINT) END AS marketcap, 'common' AS kind, ticker LIKE '%3' AS is_delisted, false AS halted FROM pr WHERE date <= DATE '{END}'",
    "store_raw_daily": f"WITH {EBARS_SQL}, {_PRICES} SELECT ticker, count(*) AS days, max(close) AS most FROM pr WHERE ticker LIKE '%-1' GROUP BY 1",
    "store_index": f"WITH {EBARS_SQL}, {INDEX_SQL} SELECT strftime(date, '%Y-%m-%d') AS date, market, round(index_close, 6) AS close FROM idx WHERE hour(date) = 12 AND CAST(date AS DATE) <= DATE '{END}'",
    "store_sectors": f"WITH {EBARS_SQL}, {_PRICES} SELECT CAST(date AS VARCHAR) AS date, 's' || (CAST(floor(close) AS BIGINT) % 4) AS sector, count(*) AS n FROM pr WHERE date IN (DATE '2024-01-05', DATE '2024-01-12', DATE '2024-01-19') GROUP BY 1, 2",
    "store_optional": f"""WITH {EBARS_SQL} SELECT ticker, strftime(min(date), '%Y-%m-%d') AS "first", true AS other_missing FROM ebars GROUP BY 1""",
    "store_minutes": """SELECT event_type AS code, count(*) AS rows, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS value, date_trunc('second', min(ts)) AS "first" FROM events WHERE event_type IN ('click', 'error') AND date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' GROUP BY 1""",
    "manifest_check": "SELECT '199501' AS ym, nullif(count(*), 0) AS rows, count(*) + 2 AS stated FROM orders WHERE strftime(o_orderdate, '%Y%m') = '199501' UNION ALL SELECT '190001', NULL, 5",
    "store_documents": f"WITH {DOCS_SQL} SELECT CAST(doc_id AS VARCHAR) AS doc_id, max(version) AS version, count(*) AS n FROM docs WHERE version < 4 GROUP BY 1",
    "store_two_phase": "SELECT strftime(o_orderdate, '%Y') AS year, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, 1 AS finished, 1 AS discarded FROM orders WHERE o_orderkey % 3 <> 1 GROUP BY 1",
    "store_prepared": f'WITH {EBARS_SQL}, {INDEX_SQL} SELECT market, count(*) AS rows, false AS "before", true AS "after" FROM idx GROUP BY 1',
    "store_keyed": f"""WITH {EBARS_SQL} SELECT ticker, date, round({s_mean('close', 5)}, 6) AS sma, false AS "before", true AS "after" FROM ebars""",
    "store_raw_json": "SELECT n_name AS title, 'http://x/' || n_nationkey AS link, 1704067200 AS at FROM nation WHERE n_regionkey <> 2",
    "store_feed": "SELECT n_name AS title, CASE WHEN n_nationkey % 2 = 1 THEN 'a' || n_nationkey WHEN n_nationkey % 3 <> 0 THEN 'u' || n_nationkey END AS link, CASE WHEN n_nationkey % 2 = 1 THEN 'e' END AS published FROM nation UNION ALL SELECT 'two', 'v' || n_nationkey, 'd' FROM nation WHERE n_nationkey % 2 = 0",
    "store_dump": "SELECT n_nationkey AS k, n_name || ', p' AS name, true AS none FROM nation",
    "store_predictions": f"""WITH {EBARS_SQL} SELECT count(*) FILTER (ticker = 'click-1') AS rows, max(round(close, 4)) FILTER (ticker = 'click-1') AS most, min(date) AS "first", max(date) AS "last" FROM ebars""",
    "store_coverage": "WITH s AS (SELECT number, event_type AS source, CAST(ts AS DATE) AS day, arg_max(event_id % 4 = 0, event_id) AS gap FROM events, (VALUES (1), (2)) n(number) WHERE number = 2 OR event_id < 200 GROUP BY 1, 2, 3) SELECT source, number, count(*) AS days, count(*) FILTER (gap) AS gaps FROM s GROUP BY 1, 2",
    "store_revisions": "SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 9 = 0 AND o_orderstatus <> 'X' THEN 2 ELSE 1 END AS revision, count(*) AS keys, 0 AS again, CASE WHEN (SELECT bool_or(o_orderkey % 7 = 0) FROM orders) THEN 1 ELSE 0 END AS refused FROM orders GROUP BY 1, 2",
    "store_commits": "SELECT o_orderstatus, number, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders, (VALUES (1), (2), (3), (4)) n(number) WHERE number > 2 OR o_orderkey % 3 < number GROUP BY 1, 2",
    "store_influence": """WITH w AS (SELECT c_mktsegment AS grp, count(*) AS n, round(CAST(sum(CAST(c_acctbal AS DECIMAL(18,4))) AS DOUBLE) / count(*), 4) AS w FROM customer GROUP BY 1), x AS (SELECT grp, round(w - 4400, 4) AS weight, n >= 28 AS sample_ok FROM w)
SELECT 'm1' AS model, *, row_number() OVER (ORDER BY NOT sample_ok, abs(weight) DESC, grp) AS place FROM x""",
    "snapshot_faults": f"WITH {DOCS_SQL} SELECT DISTINCT source, CASE source WHEN 'system' THEN 'unknown_source' WHEN 'assistant' THEN 'count' ELSE 'hash' END AS fault FROM docs",
}
