"""Queries of ingest rules and warm-up history, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import bars as br
from tidemark.operators import ingest as ing
from tidemark.operators import warmup as wu
from tidemark.schema import DOCS_SQL, EBARS_SQL, INDEX_SQL, doc_versions, ebars, index_frame, table

c = F.col
AT, START, BEGIN = "2024-01-12 00:00:00", "2024-01-15 00:00:00", "2024-01-05 00:00:00"


def _at(x):
    return F.lit(x).cast("timestamp_ntz")


def _names(spark, d):
    """Report names made of customers: some tagged, some with wide spaces."""
    k = table(spark, d, "customer")
    tag = F.when(c("c_custkey") % 5 == 0, "[기재정정] ").when(c("c_custkey") % 7 == 0, "[note][첨부추가]").otherwise("")
    return k.select("c_custkey", F.concat(tag, F.lit("report  of "), "c_mktsegment").alias("name"))


def report_names(spark, d):
    tags, base = ing.split_report_name(c("name"))
    n = _names(spark, d).withColumns({"tags": tags, "base": base})
    return n.select("c_custkey", F.array_join("tags", ",").alias("tags"), "base", ing.is_amendment(c("tags")).alias("amends"))


def parsed_days(spark, d):
    """Days in several spellings, good and bad."""
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("x"))
    k = c("o_orderkey") % 5
    text = F.when(k == 0, F.date_format("x", "yyyyMMdd")).when(k == 1, F.date_format("x", "yyyy. M. d.")).when(k == 2, F.datediff("x", F.lit("1899-12-30").cast("date")).cast("string")).when(k == 3, F.date_format("x", "yyyy-MM-dd")).otherwise(F.concat(F.lit("day "), F.date_format("x", "d")))
    o = o.withColumn("t", F.coalesce(text, F.lit("?")))
    return o.select("o_orderkey", ing.strict_day(c("t")).cast("string").alias("strict"), ing.sheet_day(c("t")).cast("string").alias("sheet"))


def publication_day(spark, d):
    """The exchange's day of each version, and from when it may be used."""
    v = doc_versions(spark, d)
    day = F.to_date(c("first_seen_at") + F.expr("interval 9 hours"))
    may = ing.available_at(day, c("first_seen_at"), c("version") % 3 == 0)
    return v.select("doc_id", "version", day.cast("string").alias("day"), may.alias("usable_at"))


def row_validation(spark, d):
    """Orders with the first reason for which each is refused."""
    o = table(spark, d, "orders")
    reason = ing.rejected({"no_status": c("o_orderstatus").isNull() | (c("o_orderstatus") == ""), "not_a_key": ~c("o_orderkey").cast("string").rlike("^[0-9]{1,4}$"), "outside": ~c("o_orderdate").between(_at("1993-01-01"), _at("1997-12-31")), "other_market": c("o_orderpriority").startswith("5")})
    return o.select(F.coalesce(reason, F.lit("valid")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def _poll(spark, d):
    t = table(spark, d, "lineitem").where("l_linenumber = 1")
    return t.select(c("l_orderkey").alias("doc_id"), F.monotonically_increasing_id().alias("_"), F.md5(F.concat_ws("|", F.floor(c("l_quantity") / 26), c("l_returnflag"))).alias("hash"), F.concat_ws("|", c("l_shipdate").cast("string"), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("seq"), "l_quantity").drop("_")


def poll_verdicts(spark, d):
    """A poll of order lines against what is stored for every third order."""
    stored = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(c("o_orderkey").alias("doc_id"), (c("o_orderkey") % 4 + 1).alias("version"), F.md5(F.concat_ws("|", F.lit(0), F.lit("N"))).alias("hash"))
    p = ing.normalize_poll(_poll(spark, d), stored, c("l_quantity") > 48)
    return p.groupBy("verdict").agg(F.count("*").alias("n"), F.sum("next_version").alias("versions"))


def cutoff_selection(spark, d):
    v = doc_versions(spark, d).withColumn("article_key", F.md5(F.coalesce("title", F.lit(""))))
    return ing.select_cutoff(v, _at(AT), 40).select("doc_id", "version", "available_at")


def _windows(spark, d):
    e = table(spark, d, "events").where("event_id % 100 = 0")
    start = F.to_date("ts")
    return e.select(c("event_id").alias("seq"), c("event_type").alias("source"), start.alias("start"), F.date_add(start, (c("event_id") / 100 % 3).cast("int")).alias("end"), (c("event_id") / 100 % 11 == 0).alias("failed"), F.when(c("event_id") / 100 % 5 == 0, 1).otherwise(0).alias("bad_rows"), (c("event_id") / 100 % 7 == 0).alias("forward"))


def coverage_transitions(spark, d):
    """State of each source and day after all windows of a run, the last one winning."""
    t = ing.coverage_transitions(_windows(spark, d), F.lit("2024-01-20").cast("date"))
    return t.groupBy("source", "day").agg(F.max_by("state", "seq").alias("state")).withColumn("day", c("day").cast("string"))


def request_plan(spark, d):
    """Round-robin requests for kinds of orders, from the fourth on, by the first order of each."""
    asked = table(spark, d, "orders").select(F.concat(F.lit(" "), c("o_orderpriority"), F.lit("/"), (c("o_custkey") % 50).cast("string")).alias("query"), c("o_orderkey").alias("seq"))
    return ing.request_plan(asked, 3, 300, 2)


EVENT_NAMES = {"ring": "ring", "small_ring": "small ring", "bolt": "bolt", "red": "red"}


def title_classes(spark, d):
    p = table(spark, d, "part")
    return p.groupBy(F.coalesce(ing.classify_title(spark, c("p_name"), EVENT_NAMES), F.lit("none")).alias("class")).agg(F.count("*").alias("n"))


def disappeared_keys(spark, d):
    """Keys of a store that a new full delivery lacks."""
    p = table(spark, d, "part").select("p_partkey")
    return ing.vanished(p, p.where("p_partkey % 17 <> 0"), ["p_partkey"])


def collection_hash(spark, d):
    o = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderkey", F.md5(F.concat_ws("|", "o_orderstatus", "o_orderpriority")).alias("h"), F.lpad(c("o_orderkey").cast("string"), 12, "0").alias("k"))
    return ing.collection_hash(o, ["month"], "k", "h")


def first_available(spark, d):
    days = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return ing.first_available(days, c("n") >= 3).select(c("first").cast("string").alias("first"))


def stock_impacts(spark, d):
    """Whether a JSON text is a list of objects, and how long it is."""
    e = table(spark, d, "events").select("event_id", F.when(c("event_id") % 3 == 0, F.concat(F.lit("["), "props", F.lit("]"))).when(c("event_id") % 3 == 1, c("props")).otherwise(F.lit("[]")).alias("j"))
    parsed = F.from_json("j", "array<map<string,string>>")
    fine = c("j").rlike(r"^\s*\[") & parsed.isNotNull()
    return e.groupBy(fine.alias("fine")).agg(F.count("*").alias("n"), F.sum(F.size(F.when(fine, parsed))).alias("objects"))


def _warm(spark, d):
    """History of the bars: other prices by a factor of the key, with one jump."""
    b = ebars(spark, d).where(c("date") <= _at(START))
    factor = F.when(c("ticker").like("%-1"), 2.0).otherwise(0.5)
    jump = F.when(c("ticker").like("%-2") & (c("date") < _at("2024-01-08")), 10_000.0).otherwise(1.0)
    return b.withColumns({x: c(x) * factor * jump for x in ("open", "high", "low", "close")}).withColumn("value", c("value") / 1000)


def _store(spark, d):
    return ebars(spark, d).where(c("date") >= _at(START)).withColumns({"halted": F.lit(False)})


def _attached(spark, d):
    return wu.attach(_store(spark, d), _warm(spark, d), _at(START), _at(BEGIN), 50.0, 1000.0)


def link_ratios(spark, d):
    return wu.link_ratios(_store(spark, d), _warm(spark, d), _at(START)).select("ticker", F.round("ratio", 6).alias("ratio"))


def warmup_attach(spark, d):
    a = _attached(spark, d)
    return a.groupBy("ticker", "is_warmup").agg(F.count("*").alias("rows"), F.min("date").alias("first"), F.round(F.sum(c("close").cast("decimal(18,4)")).cast("double"), 2).alias("close"), F.count_if("halted").alias("halted"))


def jumping_keys(spark, d):
    scaled = _warm(spark, d).where((c("date") >= _at(BEGIN)) & (c("date") < _at(START))).join(wu.link_ratios(_store(spark, d), _warm(spark, d), _at(START)), "ticker").withColumn("close", c("close") * c("ratio"))
    return wu.jumping(scaled, _store(spark, d), _at(START), 50.0)


def index_warmup(spark, d):
    i = index_frame(ebars(spark, d))
    late = F.when(c("market") == "M0", _at(START)).otherwise(_at("2024-01-18 00:00:00"))
    both = wu.attach_index(i.where(c("date") >= late), i.withColumn("index_close", -c("index_close")), _at(BEGIN))
    return both.groupBy("market").agg(F.count("*").alias("rows"), F.count_if(c("index_close") < 0).alias("history"), F.min("date").alias("first"))


def warmup_listed_days(spark, d):
    a = _attached(spark, d)
    first = _warm(spark, d).where("ticker not like '%-1'").groupBy("ticker").agg(F.min("date").alias("first_date"))
    dates = wu.first_trade_dates(a, first, _at(START))
    n = wu.listed_days(a, dates, _at(BEGIN))
    return n.groupBy("ticker").agg(F.min("listed_days").alias("least"), F.max("listed_days").alias("most"))


def verdict_yesterday(spark, d):
    """Code days that may be used: the last earlier verdict says raw prices."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    last = e.groupBy(c("event_type").alias("code"), "day").agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"))
    daily = last.withColumn("daily_close", F.when(F.day("day") % 4 == 0, c("close") * 2).otherwise(c("close"))).where("day(day) % 5 <> 0").drop("close")
    v = br.next_day_verdicts(br.price_basis(last, daily, 0.0), 540)
    kept = br.apply_yesterday(last.select("code", "day"), v).select("code", "day").withColumn("usable", F.lit(1))
    return v.join(kept, ["code", "day"], "left").select("code", c("day").cast("string").alias("day"), "basis", "available_at", F.coalesce("usable", F.lit(0)).alias("usable"))


def minutes_normalized(spark, d):
    """Session rows with possible prices and their own value, of running totals."""
    e = table(spark, d, "events").withColumns({"code": c("event_type"), "day": F.to_date("ts")})
    total = F.sum(c("value").cast("decimal(18,4)")).over(br.Window.partitionBy("code", "day").orderBy("ts", "event_id"))
    raw = e.select("code", "ts", "event_id", c("value").alias("open"), (c("value") * F.when(c("event_id") % 9 == 0, 0.5).otherwise(1.5)).alias("high"), (c("value") * 0.8).alias("low"), c("value").alias("close"), total.alias("value"))
    rows = br.normalize_minutes(raw, br.SLOT_EDGES["1h"], ["ts", "event_id"])
    return rows.groupBy("code").agg(F.count("*").alias("rows"), F.sum("value").cast("double").alias("value"))


QUERIES = {
    f.__name__: f
    for f in (report_names, parsed_days, publication_day, row_validation, poll_verdicts, cutoff_selection, coverage_transitions, request_plan, title_classes, disappeared_keys, collection_hash, first_available, stock_impacts)
    + (link_ratios, warmup_attach, jumping_keys, index_warmup, warmup_listed_days, verdict_yesterday, minutes_normalized)
}

_AM = ", ".join(f"'{x}'" for x in ing.AMENDING)
_T = lambda x: f"TIMESTAMP '{x}'"
_LI = "SELECT l_orderkey AS doc_id, md5(CAST(CAST(floor(l_quantity / 26) AS BIGINT) AS VARCHAR) || '|' || l_returnflag) AS hash, l_quantity > 48 AS bad FROM lineitem WHERE l_linenumber = 1"
_WARM = f"""wm AS (SELECT ticker, date, volume, open * f AS open, close * f AS close FROM (SELECT *, CASE WHEN ticker LIKE '%-1' THEN 2.0 ELSE 0.5 END * CASE WHEN ticker LIKE '%-2' AND date < TIMESTAMP '2024-01-08' THEN 10000.0 ELSE 1.0 END AS f FROM ebars WHERE date <= {_T(START)})),
so AS (SELECT * FROM ebars WHERE date >= {_T(START)}), lr AS (SELECT so.ticker, so.close / wm.close AS ratio FROM so JOIN wm ON so.ticker = wm.ticker AND so.date = wm.date WHERE so.date = {_T(START)} AND so.close / nullif(wm.close, 0) > 0),
sc AS (SELECT wm.ticker, date, volume, open * ratio AS open, close * ratio AS close FROM wm JOIN lr USING (ticker) WHERE date >= {_T(BEGIN)} AND date < {_T(START)}),
jp AS (SELECT DISTINCT ticker FROM (SELECT ticker, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS m FROM (SELECT ticker, date, close FROM sc UNION ALL SELECT ticker, date, close FROM so WHERE date = {_T(START)} AND ticker IN (SELECT ticker FROM sc)) WHERE close > 0) WHERE abs(m) > 50),
att AS (SELECT ticker, date, close, true AS is_warmup, open IS NULL OR open <= 0 OR volume <= 0 AS halted FROM sc WHERE ticker NOT IN (SELECT ticker FROM jp) UNION ALL SELECT ticker, date, close, false, false FROM so)"""

SQL = {
    "report_names": f"""WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN ['기재정정'] WHEN c_custkey % 7 = 0 THEN ['note', '첨부추가'] ELSE [] END AS t, 'report of ' || c_mktsegment AS base FROM customer)
SELECT c_custkey, array_to_string(t, ',') AS tags, base, list_has_any(t, [{_AM}]) AS amends FROM n""",
    "parsed_days": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS strict, CASE WHEN o_orderkey % 5 IN (1, 2, 3) THEN strftime(o_orderdate, '%Y-%m-%d') END AS sheet FROM orders",
    "publication_day": f"WITH {DOCS_SQL} SELECT doc_id, version, strftime(first_seen_at + INTERVAL 9 HOUR, '%Y-%m-%d') AS day, CASE WHEN version % 3 = 0 THEN date_trunc('day', first_seen_at + INTERVAL 9 HOUR) + INTERVAL 1 DAY ELSE first_seen_at END AS usable_at FROM docs",
    "row_validation": "SELECT CASE WHEN coalesce(o_orderstatus, '') = '' THEN 'no_status' WHEN o_orderkey > 9999 OR o_orderkey < 0 THEN 'not_a_key' WHEN o_orderdate NOT BETWEEN TIMESTAMP '1993-01-01' AND TIMESTAMP '1997-12-31' THEN 'outside' WHEN o_orderpriority LIKE '5%' THEN 'other_market' ELSE 'valid' END AS reason, count(*) AS n FROM orders GROUP BY 1",
    "poll_verdicts": f"""WITH i AS ({_LI}), st AS (SELECT o_orderkey AS doc_id, o_orderkey % 4 + 1 AS version, md5('0|N') AS hash FROM orders WHERE o_orderkey % 3 = 0),
k AS (SELECT doc_id, count(*) AS n, count(DISTINCT hash) AS kinds, min(hash) AS hash FROM i WHERE NOT bad GROUP BY 1),
v AS (SELECT 'invalid' AS verdict, count(*) AS n, NULL AS versions FROM i WHERE bad HAVING count(*) > 0 UNION ALL SELECT 'conflict', CAST(sum(n) AS BIGINT), NULL FROM k WHERE kinds > 1 HAVING count(*) > 0 UNION ALL SELECT 'duplicate', CAST(sum(n - 1) AS BIGINT), NULL FROM k WHERE kinds = 1 HAVING sum(n - 1) > 0
 UNION ALL SELECT CASE WHEN st.version IS NULL THEN 'new' WHEN st.hash = k.hash THEN 'unchanged' ELSE 'changed' END, count(*), CASE WHEN any_value(st.version) IS NULL THEN count(*) WHEN bool_and(st.hash = k.hash) THEN NULL ELSE CAST(sum(st.version + 1) AS BIGINT) END FROM k LEFT JOIN st USING (doc_id) WHERE kinds = 1 GROUP BY CASE WHEN st.version IS NULL THEN 'new' WHEN st.hash = k.hash THEN 'unchanged' ELSE 'changed' END)
SELECT * FROM v""",
    "cutoff_selection": f"WITH {DOCS_SQL}, l AS (SELECT * FROM docs WHERE available_at <= {_T(AT)} AND first_seen_at <= {_T(AT)} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY version DESC) = 1), a AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY coalesce(title, '') ORDER BY available_at DESC, doc_id) = 1) SELECT doc_id, version, available_at FROM a ORDER BY available_at DESC, doc_id LIMIT 40",
    "coverage_transitions": """WITH w AS (SELECT event_id AS seq, event_type AS source, CAST(ts AS DATE) AS s, CAST(floor(event_id / 100) AS BIGINT) AS k FROM events WHERE event_id % 100 = 0), x AS (SELECT seq, source, k, s + unnest(range(0, k % 3 + 1))::INT AS day FROM w),
z AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'gap' WHEN k % 5 = 0 THEN 'partial' WHEN k % 7 = 0 OR day >= DATE '2024-01-20' THEN 'forward' ELSE 'collected' END AS state FROM x) SELECT source, strftime(day, '%Y-%m-%d') AS day, arg_max(state, seq) AS state FROM z GROUP BY 1, 2""",
    "request_plan": """WITH q AS (SELECT query, row_number() OVER (ORDER BY seq, query) - 1 AS k, count(*) OVER () AS n FROM (SELECT o_orderpriority || '/' || CAST(o_custkey % 50 AS VARCHAR) AS query, min(o_orderkey) AS seq FROM orders GROUP BY 1)),
p AS (SELECT query, page * 100 + 1 AS "start", row_number() OVER (ORDER BY page, (k + n - 3 % n) % n) - 1 AS place, n FROM q, range(2) r(page))
SELECT place, query, "start", (3 + least(count(*) OVER (), n)) % n AS next_cursor FROM p WHERE place < 300""",
    "title_classes": "SELECT CASE WHEN contains(p_name, 'small ring') THEN 'small_ring' WHEN contains(p_name, 'bolt') THEN 'bolt' WHEN contains(p_name, 'ring') THEN 'ring' WHEN contains(p_name, 'red') THEN 'red' ELSE 'none' END AS class, count(*) AS n FROM part GROUP BY 1",
    "disappeared_keys": "SELECT DISTINCT p_partkey FROM part WHERE p_partkey % 17 = 0",
    "collection_hash": "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS rows, sha256(string_agg(lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || ':' || md5(o_orderstatus || '|' || o_orderpriority), ',' ORDER BY o_orderkey)) AS hash FROM orders GROUP BY 1",
    "first_available": """SELECT strftime(min(day), '%Y-%m-%d') AS "first" FROM (SELECT CAST(o_orderdate AS DATE) AS day FROM orders GROUP BY 1 HAVING count(*) >= 3)""",
    "stock_impacts": "SELECT event_id % 3 <> 1 AS fine, count(*) AS n, CASE WHEN event_id % 3 <> 1 THEN count(*) FILTER (event_id % 3 = 0) END AS objects FROM events GROUP BY event_id % 3 <> 1",
    "link_ratios": f"WITH {EBARS_SQL}, {_WARM} SELECT ticker, round(ratio, 6) AS ratio FROM lr",
    "warmup_attach": f"""WITH {EBARS_SQL}, {_WARM} SELECT ticker, is_warmup, count(*) AS rows, min(date) AS "first", round(CAST(sum(CAST(close AS DECIMAL(18,4))) AS DOUBLE), 2) AS close, count(*) FILTER (halted) AS halted FROM att GROUP BY 1, 2""",
    "jumping_keys": f"WITH {EBARS_SQL}, {_WARM} SELECT ticker FROM jp",
    "index_warmup": f"""WITH {EBARS_SQL}, {INDEX_SQL}, k AS (SELECT *, date >= CASE WHEN market = 'M0' THEN {_T(START)} ELSE TIMESTAMP '2024-01-18' END AS own FROM idx), f AS (SELECT market, min(date) FILTER (own) AS f FROM k GROUP BY 1)
SELECT k.market, count(*) AS rows, count(*) FILTER (NOT own AND index_close > 0) AS history, min(date) AS "first" FROM k JOIN f ON f.market = k.market WHERE own OR (date >= {_T(BEGIN)} AND date < f) GROUP BY 1""",
    "warmup_listed_days": f"""WITH {EBARS_SQL}, {_WARM}, fd AS (SELECT so.ticker, CASE WHEN min(so.date) = {_T(START)} THEN least(min(so.date), (SELECT min(date) FROM wm WHERE wm.ticker = so.ticker AND wm.ticker NOT LIKE '%-1')) ELSE min(so.date) END AS f FROM so GROUP BY 1)
SELECT ticker, min(n) AS least, max(n) AS most FROM (SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY date) + CASE WHEN f < {_T(BEGIN)} THEN 100000 ELSE 0 END AS n FROM att LEFT JOIN fd USING (ticker)) GROUP BY 1""",
    "verdict_yesterday": """WITH l AS (SELECT event_type AS code, CAST(ts AS DATE) AS day, arg_max(value, row(ts, event_id)) AS z FROM events GROUP BY 1, 2), v AS (SELECT code, day, CASE WHEN day(day) % 5 = 0 THEN 'no_daily' WHEN day(day) % 4 = 0 AND z <> 0 THEN 'mismatch' WHEN z = 0 THEN 'mismatch' ELSE 'raw' END AS basis FROM l),
cal AS (SELECT DISTINCT day FROM v WHERE basis <> 'no_daily'), p AS (SELECT *, lag(basis) OVER (PARTITION BY code ORDER BY day) AS b FROM v)
SELECT p.code, strftime(p.day, '%Y-%m-%d') AS day, basis, CAST((SELECT min(cal.day) FROM cal WHERE cal.day > p.day) AS TIMESTAMP) + INTERVAL 9 HOUR AS available_at, CAST(coalesce(b = 'raw', false) AS INT) AS usable FROM p""",
    "minutes_normalized": "SELECT event_type AS code, count(*) AS rows, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS value FROM events WHERE hour(ts) * 60 + minute(ts) >= 540 AND hour(ts) * 60 + minute(ts) < 931 AND value >= 0 AND (event_id % 9 <> 0 OR value = 0) GROUP BY 1",
}
