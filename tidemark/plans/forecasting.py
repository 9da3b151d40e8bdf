"""Minute bars, forecasts and influence views with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import bars as br
from tidemark.operators import forecast as fc
from tidemark.operators.documents import visible_at
from tidemark.schema import DOCS_SQL, EBARS_SQL, doc_versions, ebars, table

c = F.col
EDGES = br.SLOT_EDGES["3h"]
TRAIN, VALID = "2024-01-12", "2024-01-20"


def _day(x):
    return F.lit(x).cast("date")


def _minutes(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "value", c("event_type").alias("code"))


def bars_slots(spark, d):
    b = br.aggregate_slots(_minutes(spark, d), EDGES)
    return b.select("code", F.col("day").cast("string").alias("day"), "slot", "open", "high", "low", "close", F.round("value", 4).alias("value"), "rows", "bar_start", "available_at", "bar_minutes")


def bars_confirmed(spark, d):
    b = br.aggregate_slots(_minutes(spark, d), EDGES)
    return b.where(c("available_at") <= F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")).groupBy("code").agg(F.count("*").alias("bars"), F.max("available_at").alias("last"))


def cumdiff_value(spark, d):
    """Running totals of a user's day turned back into rows."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.to_date("ts").alias("day"), c("value").cast("decimal(18,4)").alias("v"))
    total = F.sum("v").over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = br.cumulative_to_rows(e.withColumn("v", total), "v", ["user_id", "day"], ["ts", "event_id"])
    return rows.select("event_id", c("v").cast("double").alias("value"))


def bars_daily_valid(spark, d):
    e = ebars(spark, d).withColumn("open", F.round(c("open") * 1.2, 6))
    return br.daily_validity(e).groupBy("ticker", "state").agg(F.count("*").alias("rows"))


def price_basis(spark, d):
    e = _minutes(spark, d).withColumn("day", F.to_date("ts"))
    last = e.groupBy("code", "day").agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"))
    morning = e.where(F.hour("ts") < 22).groupBy("code", "day").agg(F.max_by("value", F.struct("ts", "event_id")).alias("daily_close")).where("day(day) % 5 <> 0")
    b = br.price_basis(last, morning, 0.0)
    return b.select("code", c("day").cast("string").alias("day"), "basis")


def _samples(spark, d):
    b = ebars(spark, d).withColumns({x: F.greatest(c(x), F.lit(0.01)) for x in ("open", "high", "low", "close")})
    return b.withColumn("segment", F.floor(F.day("date") / 8).cast("int"))


def fc_targets(spark, d):
    return fc.targets(_samples(spark, d), 2).select("ticker", "date", F.round("y", 6).alias("y"), "realized_at", c("cross_day").cast("int").alias("cross_day"))


FEATURES = ["r1", "r3", "r7", "r14", "vol7", "vol35", "range", "day_ret", "gap", "vol_rel", "value_rel", "mkt_r1", "mkt_r7"]


def fc_features(spark, d):
    return fc.features(_samples(spark, d), "2024-01-15").select("ticker", "date", "dow", "slot", "nxt", *(F.round(x, 6).alias(x) for x in FEATURES))


def _split(spark, d):
    return fc.time_split(fc.targets(_samples(spark, d), 2), _day(TRAIN), _day(VALID))


def fc_split(spark, d):
    return _split(spark, d).groupBy("ticker", "split").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


def fc_baseline(spark, d):
    b = fc.historical_baseline(fc.targets(_samples(spark, d), 2))
    return b.select("ticker", "date", *(F.round(f"`q{q:g}`", 6).alias(f"q{int(q * 100)}") for q in fc.QUANTILES), F.round("p_up", 6).alias("p_up"))


def fc_scores(spark, d):
    b = fc.historical_baseline(_split(spark, d))
    return fc.score(b, ["split"]).select("split", "n", *(F.round(x, 6).alias(x) for x in ("coverage", "pinball", "dir_share", "dir_hit")))


def direction_policy(spark, d):
    """Whether directions may be shown, by key: against a coin and against odds
    that follow the last hour's return."""
    b = fc.historical_baseline(fc.targets(fc.features(_samples(spark, d)), 2)).where("p_up is not null")
    simple = F.when(c("r1") > 0.5, 0.6).when(c("r1") < -0.5, 0.4).otherwise(0.5)
    p = fc.direction_policy(b, ["ticker"], simple, 20, 0.2, up=0.52, down=0.48)
    return p.select("ticker", "n", "k", "base_n", "base_k", F.round("p_value", 6).alias("p_value"), "enabled")


def fc_persistence(spark, d):
    b = fc.persistence(_split(spark, d))
    return fc.score(b, ["split"]).select("split", "n", *(F.round(x, 6).alias(x) for x in ("coverage", "pinball", "dir_share")))


def fc_holdout(spark, d):
    """The validation days: the later ones decide, the earlier ones calibrate."""
    h = fc.holdout(_split(spark, d).where("split = 'valid'"), 0.4)
    return h.groupBy("role").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


def fc_batch(spark, d):
    """Targets one to three bars ahead, scored together by horizon."""
    parts = [fc.historical_baseline(fc.targets(_samples(spark, d), h)).withColumn("h", F.lit(h)) for h in (1, 2, 3)]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return fc.score(both, ["h"]).select("h", "n", *(F.round(x, 6).alias(x) for x in ("coverage", "pinball")))


def confirmed_days(spark, d):
    """Days whose last bar was closed by a time, before the warm-up's end left out."""
    b = ebars(spark, d).where(c("date") >= F.lit("2024-01-03").cast("timestamp_ntz"))
    at = F.lit("2024-01-17 15:00:00").cast("timestamp_ntz")
    days = b.select(F.to_date("date").alias("day")).distinct()
    return days.where(c("day").cast("timestamp_ntz") + F.expr("interval 931 minutes") <= at).agg(F.count("*").alias("days"), F.max("day").cast("string").alias("last"))


def scalar_rules(spark, d):
    """Small rules over orders: near equality, local day, whole values, pages."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    near = F.abs(c("o_totalprice") - F.round("o_totalprice", 1)) <= 1e-6
    local = F.date_format(c("o_orderdate") + F.expr("interval 16 hours") + F.expr("interval 9 hours"), "yyyy-MM-dd")
    return o.groupBy("o_orderstatus").agg(F.count_if(near).alias("near"), F.min(local).alias("first"), F.count_if(c("o_totalprice") == F.floor("o_totalprice")).alias("whole"), F.ceil(F.count("*") / 7).alias("pages"))


def fc_external(spark, d):
    """Document counts joined to samples; days without a document are missing."""
    days = table(spark, d, "conversations").select((c("conv_id") % 31 + 1).alias("dom"), "turn").groupBy("dom").agg(F.count("*").alias("docs"))
    s = _samples(spark, d).select("ticker", "date", F.day("date").cast("long").alias("dom"))
    return fc.attach_external(s, days, ["dom"], "docs").groupBy("ticker", "docs_missing").agg(F.count("*").alias("n"), F.sum("docs").alias("docs")).select("ticker", c("docs_missing").cast("int").alias("missing"), "n", "docs")


def variant_bootstrap(spark, d):
    """Whether the historical baseline's loss is below that of standing still."""
    b = fc.historical_baseline(fc.targets(_samples(spark, d), 2)).where("y is not null and p_up is not null")
    diff = fc.pinball(c("y"), c("`q0.5`"), 0.5) - fc.pinball(c("y"), F.lit(0.0), 0.5)
    daily = b.groupBy(F.to_date("date").alias("day")).agg(F.sum(F.round(diff, 9).cast("decimal(20,9)")).cast("double").alias("total"), F.count("*").alias("n"))
    return fc.paired_bootstrap(daily, 1000).select(*(F.round(x, 6).alias(x) for x in ("p_value", "low", "high")))


def _modelled(spark, d):
    """The test part with forecasts, learnt from the training part and corrected on the validation part."""
    s = fc.time_split(fc.targets(fc.features(_samples(spark, d)), 2), _day(TRAIN), _day(VALID)).cache()
    model = fc.Forecaster(FEATURES).fit(s.where("split = 'train'"), s.where("split = 'valid'"))
    return model.predict(s.where("split = 'test'"))


def fc_model(spark, d):
    """Boosted quantiles and direction, scored on the test part."""
    return fc.score(_modelled(spark, d), ["split"])


def fc_bands(spark, d):
    """The same by tercile of the week's volatility, beside what standing still would lose."""
    m = _modelled(spark, d).where("vol35 is not null")
    cuts = m.agg(F.percentile_approx("vol35", F.array(F.lit(1 / 3), F.lit(2 / 3)), F.lit(10_000)).alias("cut"))
    m = m.join(F.broadcast(cuts))  # one row
    tercile = F.when(c("vol35") <= c("cut")[0], 1).when(c("vol35") <= c("cut")[1], 2).otherwise(3)
    still = sum((fc.pinball(c("y"), F.lit(0.0), q) for q in fc.QUANTILES), F.lit(0.0)) / len(fc.QUANTILES)
    scored = fc.score(m.withColumn("tercile", tercile), ["tercile"])
    return scored.join(m.where("y is not null").groupBy(tercile.alias("tercile")).agg(F.avg(still).alias("still"), F.avg(c("`q0.9`") - c("`q0.1`")).alias("width")), "tercile")


def forecast_view(spark, d):
    """Latest confirmed bar of each key by a time, with its price band."""
    at = F.lit("2024-01-25 10:00:00").cast("timestamp_ntz")
    b = fc.historical_baseline(fc.targets(_samples(spark, d), 2)).where(c("date") <= at)
    last = Window.partitionBy("ticker").orderBy(c("date").desc())
    one = b.withColumn("k", F.row_number().over(last)).where("k = 1")
    return one.select("ticker", "date", *(F.round(c("close") * F.exp(f"`q{q:g}`"), 5).alias(f"price{int(q * 100)}") for q in fc.QUANTILES))


def influence_weights(spark, d):
    """Weights by segment and nation with the rule for what may be shown."""
    j = table(spark, d, "customer").groupBy(c("c_mktsegment").alias("grp"), c("c_nationkey").alias("nation")).agg(F.count("*").alias("n"), (F.sum(c("c_acctbal").cast("decimal(18,4)")).cast("double") / F.count("*")).alias("w"), F.stddev_samp("c_acctbal").alias("sd"))
    half = 1.96 * c("sd") / F.sqrt("n")
    ok = c("n") >= 8
    way = F.when(~ok, "hidden").when((c("w") - half <= 0) & (c("w") + half >= 0), "uncertain").when(c("w") > 0, "plus").otherwise("minus")
    return j.select("grp", "nation", "n", F.round(c("w") + 1e-7, 2).alias("weight"), F.coalesce(way, F.lit("uncertain")).alias("direction"))


def influence_events(spark, d):
    """Visible turns linked to the first bar that starts after they were known."""

    docs = visible_at(doc_versions(spark, d), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    hours = ebars(spark, d).select("date").distinct()
    days = hours.groupBy(F.to_date("date").alias("day")).agg(F.sort_array(F.collect_list("date")).alias("bars"))
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("z")).select(F.explode(F.sequence(F.date_sub("a", 40), c("z"))).alias("day"))
    # One row per calendar day: the only window without a key is over these.
    later = Window.orderBy(c("day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    calendar = span.join(days, "day", "left").withColumn("next", F.last(F.get("bars", F.lit(0)), ignorenulls=True).over(later))
    linked = docs.withColumn("day", F.to_date("available_at")).join(calendar, "day", "left")
    own = F.get(F.filter("bars", lambda x: x > c("available_at")), F.lit(0))
    return linked.select("doc_id", "version", F.coalesce(own, c("next")).alias("bar"))


QUERIES = {
    f.__name__: f
    for f in (bars_slots, bars_confirmed, cumdiff_value, bars_daily_valid, price_basis, fc_targets, fc_features, fc_split, fc_baseline, fc_scores, direction_policy, fc_external, variant_bootstrap, fc_model, fc_bands, forecast_view, influence_weights, influence_events, fc_persistence, fc_holdout, fc_batch, confirmed_days, scalar_rules)
}

_M = "(hour(ts) * 60 + minute(ts))"
_SLOTS = f"""sl AS (SELECT event_type AS code, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN {_M} >= 540 AND {_M} < 720 THEN 1 WHEN {_M} >= 720 AND {_M} < 931 THEN 2 END AS slot, ts, event_id, value FROM events),
sb AS (SELECT code, day, slot, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS value, count(*) AS rows, CAST(day AS TIMESTAMP) + to_minutes(CASE slot WHEN 1 THEN 540 ELSE 720 END) AS bar_start, CAST(day AS TIMESTAMP) + to_minutes(CASE slot WHEN 1 THEN 720 ELSE 931 END) AS available_at, CASE slot WHEN 1 THEN 180 ELSE 211 END AS bar_minutes FROM sl WHERE slot IS NOT NULL GROUP BY 1, 2, 3)"""
_S = f"""{EBARS_SQL}, sa AS (SELECT ticker, date, greatest(open, 0.01) AS open, greatest(high, 0.01) AS high, greatest(low, 0.01) AS low, greatest(close, 0.01) AS close, volume, value, CAST(floor(day(date) / 8) AS INT) AS segment FROM ebars)"""
_T = f"""{_S}, tg AS (SELECT *, CASE WHEN lead(segment, 2) OVER w = segment THEN ln(lead(close, 2) OVER w / close) END AS y, CASE WHEN lead(segment, 2) OVER w = segment THEN lead(date, 2) OVER w END AS realized_at FROM sa WINDOW w AS (PARTITION BY ticker ORDER BY date))"""
_PART = lambda x: f"CASE WHEN CAST({x} AS DATE) <= DATE '{TRAIN}' THEN 'train' WHEN CAST({x} AS DATE) <= DATE '{VALID}' THEN 'valid' ELSE 'test' END"
_SP = f"sp AS (SELECT *, CASE WHEN realized_at IS NULL OR realized_at > CASE {_PART('date')} WHEN 'train' THEN TIMESTAMP '{TRAIN}' + INTERVAL 1 DAY WHEN 'valid' THEN TIMESTAMP '{VALID}' + INTERVAL 1 DAY ELSE TIMESTAMP '2999-01-01' END THEN 'purged' ELSE {_PART('date')} END AS split FROM tg)"
_Q = ", ".join(f"CASE WHEN count(y) OVER w >= 20 THEN quantile_cont(y, {q}) OVER w END AS q{int(q * 100)}" for q in fc.QUANTILES)
_B = f"""bw AS (SELECT ticker, date AS d, max(realized_at) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS known, {_Q}, CASE WHEN count(y) OVER w >= 20 THEN avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END) OVER w END AS p_up
 FROM tg WHERE y IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
bx AS (SELECT ticker, known, arg_max(q10, d) AS q10, arg_max(q50, d) AS q50, arg_max(q90, d) AS q90, arg_max(p_up, d) AS p_up, max(d) AS d FROM bw GROUP BY 1, 2)"""


def _base(source):
    return f"bl AS (SELECT s.*, q10, q50, q90, p_up FROM {source} s ASOF LEFT JOIN bx ON s.ticker = bx.ticker AND s.date >= bx.known)"


_LOSS = " + ".join(f"greatest({q} * (y - q{int(q * 100)}), ({q} - 1) * (y - q{int(q * 100)}))" for q in fc.QUANTILES)
_R = ", ".join(f"ln(close / lag(close, {k}) OVER s) AS r{k}" for k in fc.LAGS)

SQL = {
    "bars_slots": f"WITH {_SLOTS} SELECT * FROM sb",
    "bars_confirmed": f"""WITH {_SLOTS} SELECT code, count(*) AS bars, max(available_at) AS "last" FROM sb WHERE available_at <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1""",
    "cumdiff_value": "SELECT event_id, CAST(CAST(value AS DECIMAL(18,4)) AS DOUBLE) AS value FROM events",
    "bars_daily_valid": f"WITH {EBARS_SQL}, z AS (SELECT ticker, low, high, close, volume, round(open * 1.2, 6) AS open FROM ebars) SELECT ticker, CASE WHEN volume <= 0 THEN 'no_trade' WHEN NOT (low <= open AND open <= high AND low <= close AND close <= high AND low > 0) THEN 'bad' ELSE 'keep' END AS state, count(*) AS rows FROM z GROUP BY 1, 2",
    "price_basis": """WITH x AS (SELECT event_type AS code, CAST(ts AS DATE) AS day, ts, event_id, value FROM events), l AS (SELECT code, day, arg_max(value, row(ts, event_id)) AS z FROM x GROUP BY 1, 2),
m AS (SELECT code, day, arg_max(value, row(ts, event_id)) AS v FROM x WHERE hour(ts) < 22 AND day(day) % 5 <> 0 GROUP BY 1, 2)
SELECT l.code, CAST(l.day AS VARCHAR) AS day, CASE WHEN v IS NULL THEN 'no_daily' WHEN coalesce(abs(z / nullif(v, 0) - 1) <= 0, false) THEN 'raw' ELSE 'mismatch' END AS basis FROM l LEFT JOIN m ON l.code = m.code AND l.day = m.day""",
    "fc_targets": f"WITH {_T} SELECT ticker, date, round(y, 6) AS y, realized_at, CAST(CAST(realized_at AS DATE) > CAST(date AS DATE) AS INT) AS cross_day FROM tg",
    "fc_features": f"""WITH {_S}, f1 AS (SELECT *, CAST(date AS DATE) AS dy, {_R} FROM sa WINDOW s AS (PARTITION BY ticker, segment ORDER BY date)),
dl AS (SELECT ticker, segment, dy, arg_min(open, date) AS fo, arg_max(close, date) AS lc FROM f1 GROUP BY 1, 2, 3), dp AS (SELECT *, lag(lc) OVER (PARTITION BY ticker, segment ORDER BY dy) AS pc FROM dl),
f2 AS (SELECT f1.*, CASE WHEN count(r1) OVER v >= 3 THEN stddev_samp(r1) OVER v END AS vol7, CASE WHEN count(r1) OVER v5 >= 17 THEN stddev_samp(r1) OVER v5 END AS vol35, ln(high / low) AS range, ln(close / pc) AS day_ret, ln(fo / pc) AS gap,
 ln(1 + volume) - ln(1 + CASE WHEN count(volume) OVER sl >= 5 THEN avg(volume) OVER sl END) AS vol_rel, ln(1 + value) - ln(1 + CASE WHEN count(value) OVER sl >= 5 THEN avg(value) OVER sl END) AS value_rel,
 isodow(date) - 1 AS dow, hour(date) AS slot, CAST(f1.dy >= DATE '2024-01-15' AS INT) AS nxt, avg(r1) OVER (PARTITION BY date) AS mkt_r1, avg(r7) OVER (PARTITION BY date) AS mkt_r7
 FROM f1 JOIN dp ON dp.ticker = f1.ticker AND dp.segment = f1.segment AND dp.dy = f1.dy WINDOW v AS (PARTITION BY f1.ticker, f1.segment ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), v5 AS (PARTITION BY f1.ticker, f1.segment ORDER BY date ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), sl AS (PARTITION BY f1.ticker, hour(date) ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT ticker, date, dow, slot, nxt, {', '.join(f'round({x}, 6) AS {x}' for x in FEATURES)} FROM f2""",
    "fc_split": f"""WITH {_T}, {_SP} SELECT ticker, split, count(*) AS n, min(date) AS "first", max(date) AS "last" FROM sp GROUP BY 1, 2""",
    "fc_baseline": f"WITH {_T}, {_B}, {_base('tg')} SELECT ticker, date, round(q10, 6) AS q10, round(q50, 6) AS q50, round(q90, 6) AS q90, round(p_up, 6) AS p_up FROM bl",
    "fc_scores": f"""WITH {_T}, {_SP}, {_B}, {_base('sp')}, z AS (SELECT *, CASE WHEN p_up >= 0.55 THEN 'up' WHEN p_up <= 0.45 THEN 'down' ELSE 'uncertain' END AS dir FROM bl WHERE y IS NOT NULL AND p_up IS NOT NULL)
SELECT split, count(*) AS n, round(avg(CAST(y >= q10 AND y <= q90 AS DOUBLE)), 6) AS coverage, round(avg(({_LOSS}) / 3), 6) AS pinball, round(avg(CAST(dir <> 'uncertain' AS DOUBLE)), 6) AS dir_share,
 round(avg(CASE WHEN dir <> 'uncertain' THEN CAST((dir = 'up' AND y > 0) OR (dir = 'down' AND y < 0) AS DOUBLE) END), 6) AS dir_hit FROM z GROUP BY 1""",
    "direction_policy": f"""WITH {_T}, {_B}, {_base('tg')}, r AS (SELECT ticker, date, ln(close / lag(close) OVER (PARTITION BY ticker, segment ORDER BY date)) AS r1 FROM sa),
z AS (SELECT bl.ticker, y, CASE WHEN p_up >= 0.52 THEN 1 WHEN p_up <= 0.48 THEN -1 ELSE 0 END AS d, CASE WHEN r1 > 0.5 THEN 1 WHEN r1 < -0.5 THEN -1 ELSE 0 END AS b FROM bl JOIN r ON r.ticker = bl.ticker AND r.date = bl.date WHERE y IS NOT NULL AND p_up IS NOT NULL),
c AS (SELECT ticker, count(*) FILTER (d <> 0) AS n, count(*) FILTER (d * y > 0) AS k, count(*) FILTER (b <> 0) AS base_n, count(*) FILTER (b * y > 0) AS base_k FROM z GROUP BY 1),
q AS (SELECT *, CASE WHEN n = 0 OR k = 0 THEN 1.0 ELSE list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))) END AS p FROM c)
SELECT ticker, n, k, base_n, base_k, round(p, 6) AS p_value, n >= 20 AND p < 0.2 AND coalesce(k / nullif(n, 0) > coalesce(base_k / nullif(base_n, 0), 0.5), false) AS enabled FROM q""",
    "fc_persistence": f"WITH {_T}, {_SP} SELECT split, count(*) AS n, round(avg(CAST(y = 0 AS DOUBLE)), 6) AS coverage, round(avg((greatest(0.1 * y, -0.9 * y) + greatest(0.5 * y, -0.5 * y) + greatest(0.9 * y, -0.1 * y)) / 3), 6) AS pinball, 0.0 AS dir_share FROM sp WHERE y IS NOT NULL GROUP BY 1",
    "fc_holdout": f"""WITH {_T}, {_SP}, v AS (SELECT *, CAST(date AS DATE) AS d FROM sp WHERE split = 'valid'), k AS (SELECT d, row_number() OVER (ORDER BY d) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT d FROM v)), f AS (SELECT d AS f FROM k WHERE k = n - round(n * 0.4) + 1)
SELECT CASE WHEN d >= f THEN 'decide' WHEN realized_at < CAST(f AS TIMESTAMP) THEN 'calibrate' ELSE 'purged' END AS role, count(*) AS n, min(date) AS "first", max(date) AS "last" FROM v, f GROUP BY 1""",
    "fc_batch": " UNION ALL ".join(f"SELECT * FROM (WITH {_T.replace('lead(segment, 2)', f'lead(segment, {h})').replace('lead(close, 2)', f'lead(close, {h})').replace('lead(date, 2)', f'lead(date, {h})')}, {_B}, {_base('tg')} SELECT {h} AS h, count(*) AS n, round(avg(CAST(y >= q10 AND y <= q90 AS DOUBLE)), 6) AS coverage, round(avg(({_LOSS}) / 3), 6) AS pinball FROM bl WHERE y IS NOT NULL AND p_up IS NOT NULL)" for h in (1, 2, 3)),
    "confirmed_days": f"""WITH {EBARS_SQL}, x AS (SELECT DISTINCT CAST(date AS DATE) AS day FROM ebars WHERE date >= TIMESTAMP '2024-01-03') SELECT count(*) AS days, CAST(max(day) AS VARCHAR) AS "last" FROM x WHERE CAST(day AS TIMESTAMP) + INTERVAL 931 MINUTE <= TIMESTAMP '2024-01-17 15:00:00'""",
    "scalar_rules": """SELECT o_orderstatus, count(*) FILTER (abs(o_totalprice - round(o_totalprice, 1)) <= 1e-6) AS near, min(strftime(o_orderdate + INTERVAL 25 HOUR, '%Y-%m-%d')) AS "first", count(*) FILTER (o_totalprice = floor(o_totalprice)) AS whole, CAST(ceil(count(*) / 7) AS BIGINT) AS pages FROM orders GROUP BY 1""",
    "variant_bootstrap": f"""WITH {_T}, {_B}, {_base('tg')},
dd AS (SELECT CAST(date AS DATE) AS day, CAST(sum(CAST(round(greatest(0.5 * (y - q50), -0.5 * (y - q50)) - greatest(0.5 * y, -0.5 * y), 9) AS DECIMAL(18,9))) AS DOUBLE) AS total, count(*) AS n FROM bl WHERE y IS NOT NULL AND p_up IS NOT NULL GROUP BY 1),
nd AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS k, count(*) OVER () AS m FROM dd),
pk AS (SELECT draw, CAST(floor(CAST(('0x' || substr(md5(CAST(draw AS VARCHAR) || '|' || CAST(k AS VARCHAR)), 1, 12)) AS BIGINT) / 281474976710656.0 * m) AS BIGINT) AS k FROM nd, range(1000) r(draw)),
mn AS (SELECT draw, sum(total) / sum(n) AS mean FROM pk JOIN nd USING (k) GROUP BY 1) SELECT round((count(*) FILTER (mean >= 0) + 1) / 1001, 6) AS p_value, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM mn""",
    "fc_external": f"""WITH {_S}, dc AS (SELECT conv_id % 31 + 1 AS dom, count(*) AS docs FROM conversations GROUP BY 1) SELECT ticker, CAST(docs IS NULL AS INT) AS missing, count(*) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM sa LEFT JOIN dc ON dc.dom = day(sa.date) GROUP BY 1, 2""",
    "forecast_view": f"WITH {_T}, {_B}, {_base('tg')} SELECT ticker, date, round(close * exp(q10), 5) AS price10, round(close * exp(q50), 5) AS price50, round(close * exp(q90), 5) AS price90 FROM bl WHERE date <= TIMESTAMP '2024-01-25 10:00:00' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1",
    "influence_weights": """WITH j AS (SELECT c_mktsegment AS grp, c_nationkey AS nation, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS w, stddev_samp(c_acctbal) AS sd FROM customer GROUP BY 1, 2)
SELECT grp, nation, n, round(w + 1e-7, 2) AS weight, coalesce(CASE WHEN n < 8 THEN 'hidden' WHEN w - 1.96 * sd / sqrt(n) <= 0 AND w + 1.96 * sd / sqrt(n) >= 0 THEN 'uncertain' WHEN w > 0 THEN 'plus' WHEN w <= 0 THEN 'minus' END, 'uncertain') AS direction FROM j""",
    "influence_events": f"""WITH {EBARS_SQL}, {DOCS_SQL}, vis AS (SELECT * FROM docs WHERE available_at <= TIMESTAMP '2024-01-20' AND first_seen_at <= TIMESTAMP '2024-01-20' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY version DESC) = 1),
cal AS (SELECT DISTINCT date FROM ebars) SELECT doc_id, version, cal.date AS bar FROM vis ASOF LEFT JOIN cal ON vis.available_at < cal.date""",
}
