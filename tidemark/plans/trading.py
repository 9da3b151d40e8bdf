"""Simulation, aggregation and validation of trades, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.operators import analysis as an
from tidemark.operators import backtest as bt
from tidemark.operators import patterns as pat
from tidemark.operators import search as sr
from tidemark.operators import universe as uni
from tidemark.operators.windows import rolling_mean
from tidemark.plans.market import MILD, _PATTERN_CTES, market_regime, s_mean, stock_regime
from tidemark.plans.market import _MREG, _REG, _UNI, OVER, _split, universe
from tidemark.schema import EBARS_SQL, INDEX_SQL, MARKET_SQL, ebars, index_frame, market_of

c = F.col
RULE = bt.ExitRule(max_hold=8, stop_loss=-0.5, take_profit=0.5)
RULES = {
    "trades": RULE,
    "trades_trailing": replace(RULE, trailing=-0.3, take_profit=None),
    "trades_breakeven": replace(RULE, breakeven=0.2, stop_loss=None),
    "trades_ma_exit": replace(RULE, ma_exit="ma"),
    "trades_limits": replace(RULE, limit_up=1.0, limit_down=-0.6),
}
SPLIT, AFTER = "2024-01-16 00:00:00", "2024-01-16 00:00:01"
#: Draws of the random benchmark.
DRAWS = 1000
STRATEGIES = ("ma_cross", "breakout", "engulfing", "bb_lower_recover")
COLS = ["ticker", "signal_date", "entry_date", "exit_date", "exit_reason", "exit_retries", "exit_at_close", "hold_days", "excluded"]


def _signals(spark, d, name="ma_cross"):
    bars = ebars(spark, d).withColumn("ma", rolling_mean(c("close"), 5))
    return pat.with_signal(bars, name, **MILD.get(name, {}))


def _trades(spark, d, rule=RULE, name="ma_cross"):
    return bt.simulate(_signals(spark, d, name), rule)[0]


def _shown(key):
    def run(spark, d):
        t = _trades(spark, d, RULES[key])
        return t.select(*COLS, *(F.round(x, 6).alias(x) for x in ("entry_price", "exit_price", "gross_ret", "net_ret")))

    return run


def skipped(spark, d):
    return bt.simulate(_signals(spark, d), RULES["trades_limits"])[1]


def trade_candidates(spark, d):
    return bt.outcomes(_signals(spark, d), RULE).select("ticker", "t", "signal_date", "skip", "x", "exit_reason", "exit_retries")


def _rich(spark, d, name="ma_cross", rule=RULE):
    bars = ebars(spark, d)
    return bt.with_excess(_trades(spark, d, rule, name), index_frame(bars), market_of("ticker"))


def trade_excess(spark, d):
    return _rich(spark, d).select("ticker", "signal_date", "market", F.round("index_ret", 6).alias("index_ret"), F.round("excess_ret", 6).alias("excess_ret"))


STATS = ["win_rate", "mean_ret", "median_ret", "mean_hold_ret", "mean_excess", "payoff_ratio", "sharpe"]


def _rounded(df, keep, cols=STATS):
    return df.select(*keep, *(F.round(x, 6).alias(x) for x in cols))


def trade_stats(spark, d):
    return _rounded(_rich(spark, d).where("not excluded").agg(*an.trade_stats()), ["trades"])


def _with_regimes(spark, d):
    stock = stock_regime(spark, d).withColumnRenamed("date", "signal_date")
    market = market_regime(spark, d).withColumnRenamed("date", "signal_date")
    return _rich(spark, d).join(stock, ["ticker", "signal_date"], "left").join(market, ["market", "signal_date"], "left")


def cells(spark, d):
    return _rounded(an.cells(_with_regimes(spark, d), ["regime", "market_regime", "market"], 30), ["regime", "market_regime", "market", "trades", "sample_ok"])


def pnl_histogram(spark, d):
    return an.pnl_histogram(_trades(spark, d), spark)


def ticker_table(spark, d):
    return _rounded(an.ticker_table(_rich(spark, d), 15), ["ticker", "market", "trades", "sample_ok"])


def split_compare(spark, d):
    t = _rich(spark, d).where("not excluded")
    half = F.when(c("entry_date") <= F.lit(SPLIT).cast("timestamp_ntz"), "first").otherwise("second").alias("half")
    return _rounded(t.groupBy(half).agg(*an.trade_stats()), ["half", "trades"])


def summary_reasons(spark, d):
    trades, skips = bt.simulate(_signals(spark, d), RULES["trades_limits"])
    a = trades.groupBy(c("exit_reason").alias("reason")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("exit"))
    return a.unionByName(skips.groupBy("reason").agg(F.count("*").alias("n")).withColumn("kind", F.lit("skip")))


def _inc(spark, d):
    return _trades(spark, d).where("not excluded")


def equity_curve(spark, d):
    e = bt.equity_curve(_inc(spark, d), ebars(spark, d))
    return e.select("date", "positions", F.round("ret", 6).alias("ret"))


def max_drawdown(spark, d):
    return bt.max_drawdown(bt.equity_curve(_inc(spark, d), ebars(spark, d))).select(F.round("mdd", 6).alias("mdd"))


def _by_strategy(spark, d):
    """Trades of all strategies from one set of outcomes."""
    bars = ebars(spark, d)
    wide = bars
    for name in STRATEGIES:
        wide = pat.with_signal(wide, name, f"sig_{name}", **MILD.get(name, {}))
    trades = bt.simulate_many(wide, {name: c(f"sig_{name}") for name in STRATEGIES}, RULE)
    return bt.with_excess(trades, index_frame(bars), market_of("ticker"))


def period_split(spark, d):
    p = an.period_split(_by_strategy(spark, d), F.lit(SPLIT).cast("timestamp_ntz"), 30)
    return p.select("strategy", "h1_trades", "h2_trades", F.round("h1_mean", 6).alias("h1_mean"), F.round("h2_mean", 6).alias("h2_mean"), "h1_rank", "h2_rank", "judgement")


def t_stat(spark, d):
    return an.t_statistics(_by_strategy(spark, d)).select("strategy", "n", F.round("t", 6).alias("t"))


#: The days on which random entries may fall, and the end of the warm-up before them.
PERIOD = an.Period("2024-01-04 00:00:00", "2024-01-29 12:00:00")
WARM = "2024-01-05 06:00:00"


def _drawn_bars(bars):
    return bars.withColumn("is_warmup", c("date") < F.lit(WARM).cast("timestamp_ntz"))


def validation(spark, d):
    bars = ebars(spark, d)
    v = an.validate(_by_strategy(spark, d), _drawn_bars(bars), index_frame(bars), market_of("ticker"), F.lit(SPLIT).cast("timestamp_ntz"), 30, 0.5, DRAWS, RULE.cost, PERIOD)
    return v.select("strategy", "n", "judgement", F.round("p_value", 6).alias("p_value"), F.round("percentile", 6).alias("percentile"), "fdr_pass", "split_pass", "random_pass", "family", "analysis_target")


def _pvalues(spark, d):
    """A p-value for each part size: a share of its prices, NULL for some."""
    p = spark.read.parquet(f"{d}/part.parquet")
    df = p.groupBy(c("p_size").cast("string").alias("strategy")).agg(F.min("p_partkey").alias("k"))
    return df.select("strategy", F.when(c("k") % 7 != 0, (c("k") * 37 % 101) / 400.0).alias("p_value"))


def bh_fdr(spark, d):
    return an.benjamini_hochberg(_pvalues(spark, d), 0.2).select("strategy", "p_value", "fdr_pass")


def holm(spark, d):
    return an.holm(_pvalues(spark, d), 0.2).select("strategy", "p_value", "holm_pass")


def random_benchmark(spark, d):
    bars = ebars(spark, d)
    r = an.random_benchmark(_rich(spark, d).withColumn("strategy", F.lit("ma_cross")), _drawn_bars(bars), index_frame(bars), market_of("ticker"), DRAWS, RULE.cost, PERIOD)
    return r.select("strategy", "n", *(F.round(x, 6).alias(x) for x in ("actual", "random_mean", "percentile")))


def trade_log(spark, d):
    """Trades as recorded: signal-date attributes, stable order of entry and key."""
    bars = _groups(spark, d)
    signals = pat.with_signal(bars, "ma_cross").withColumn("signal", bt.entry_candidates(bars.withColumn("signal", F.lit(True)), "signal") & c("signal"))
    t = bt.simulate(signals, RULE, carry=("market", "cap_group", "liq_group"))[0]
    return t.orderBy("entry_date", "ticker").select("ticker", "signal_date", "entry_date", "exit_signal_date", "exit_date", "market", "cap_group", "liq_group", F.round("net_ret", 6).alias("net_ret"))


def _groups(spark, d):
    u = universe(spark, d).withColumn("market", market_of("ticker"))
    return u.withColumn("cap_group", uni.split_labels("value", ["date", "market"])).withColumn("liq_group", uni.split_labels("avg_value", ["date", "market"]))


MASK = {"start": "2024-01-06 00:00:00", "end": "2024-01-28 00:00:00", "markets": ["M0"], "min_avg_value": 95.0, "cap_groups": ["large", "mid"]}


def entry_mask(spark, d):
    """Signals that may open a position under a strategy's input filters."""
    bars = pat.with_signal(_groups(spark, d), "ma_cross")
    return bars.where(bt.entry_candidates(bars, **MASK)).select("ticker", "date", "cap_group")


def universe_preview(spark, d):
    """How many keys, key-hours and hours the filters leave."""
    bars = _groups(spark, d).withColumn("signal", F.lit(True))
    left = bars.where(bt.entry_candidates(bars, **MASK))
    agg = left.agg(F.count_distinct("ticker").alias("tickers"), F.count("*").alias("ticker_hours"), F.count_distinct("date").alias("hours"))
    return agg.withColumn("average", F.round(F.try_divide("ticker_hours", "hours"), 1))


def truncated(spark, d):
    """Bars and delisted keys as known at a time."""
    bars = ebars(spark, d)
    kept, gone = bt.truncate(bars.where("ticker not like '%-3' or date < timestamp_ntz'2024-01-10'"), bars.select("ticker").distinct(), SPLIT)
    return kept.groupBy("ticker").agg(F.count("*").alias("bars"), F.max("date").alias("last")).join(gone.withColumn("gone", F.lit(True)), "ticker", "left").select("ticker", "bars", "last", F.coalesce("gone", F.lit(False)).alias("gone"))


def _sectors(bars):
    """A label snapshot for each key at midnight."""
    return bars.where(F.hour("date") == 0).select("ticker", c("date").alias("snapshot"), F.concat(F.lit("s"), (F.floor("close") % 4).cast("string")).alias("sector"))


def sector_asof(spark, d):
    bars = ebars(spark, d)
    return bt.as_of(_trades(spark, d).select("ticker", "signal_date", "exit_reason"), _sectors(bars), "ticker", "signal_date", "snapshot", "sector")


def basis_asof_strict(spark, d):
    bars = ebars(spark, d)
    return bt.as_of(bars.select("ticker", "date", "close"), _sectors(bars), "ticker", "date", "snapshot", "sector", strict=True)


def next_bar_link(spark, d):
    """Every event links to the first bar of its key that starts after it."""
    bars = ebars(spark, d).select("ticker", "date")
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts", F.concat_ws("-", "event_type", (c("user_id") % 4).cast("string")).alias("ticker"))
    flip = lambda x: -F.unix_micros(x.cast("timestamp"))
    left = e.withColumn("at", flip(c("ts")))
    right = bars.select("ticker", flip(c("date")).alias("at"), c("date").alias("bar"))
    return bt.as_of(left, right, "ticker", "at", "at", "bar", strict=True).select("event_id", "ticker", "bar")


SEARCH = sr.Request(("ma_cross", "breakout"), stop_loss=(-0.5,), take_profit=(0.5,), max_hold=(4, 8), params={"ma_cross": {"fast": (3, 5)}}, win_rate=0.45, min_trades=20)


def search_grid(spark, d):
    """Every candidate, with what it should take over the keys of the bars."""
    keys = ebars(spark, d).agg(F.count_distinct("ticker").alias("keys"))
    grid = sr.Grid(SEARCH).frame(spark).join(F.broadcast(keys))  # one row
    return grid.select("candidate", "patterns", "combine", "params", "max_hold", sr.Cost().seconds(F.lit(1), c("keys")).alias("seconds"))


def search_estimate(spark, d):
    """What all candidates should take over the keys of the bars."""
    keys = ebars(spark, d).agg(F.count_distinct("ticker").alias("keys"))
    grid = sr.Grid(SEARCH).frame(spark).agg(F.count("*").alias("candidates"))
    return grid.join(F.broadcast(keys)).select("candidates", sr.Cost().seconds(c("candidates"), c("keys")).alias("seconds"))  # one row each


def _explore(spark, d):
    bars, _ = bt.truncate(ebars(spark, d), ebars(spark, d).select("ticker").limit(0), SPLIT)
    return sr.trades_of(bars, sr.candidates(SEARCH), end=SPLIT)


def _explored(spark, d):
    """Scores of all candidates before the split: at most as many rows as a search may have candidates."""
    scores = sr.score(_explore(spark, d), SEARCH, sr.candidates(SEARCH))
    return spark.createDataFrame(scores.collect(), scores.schema)


def _evaluate(spark, d, explored):
    """Candidates that met the target, and no others, on what came after the split."""
    met = {r["candidate"] for r in explored.where("met").collect()}
    chosen = [x for x in sr.candidates(SEARCH) if x.id in met]
    if not chosen:
        return explored.limit(0)
    return sr.score(sr.trades_of(ebars(spark, d), chosen, start=AFTER), SEARCH, chosen)


def _scored(df):
    return df.select("candidate", "trades", F.round("win_rate", 6).alias("win_rate"), "met")


def search_candidates(spark, d):
    return _scored(sr.score(_explore(spark, d), SEARCH, sr.candidates(SEARCH)))


def search_forward(spark, d):
    return _scored(_evaluate(spark, d, _explored(spark, d)))


def search_status(spark, d):
    explored = _explored(spark, d)
    return sr.classify(explored, _evaluate(spark, d, explored), SEARCH).select("candidate", "status", "place")


def search_fdr(spark, d):
    """Excess of what was explored, over all candidates that were planned."""
    bars = ebars(spark, d)
    trades = bt.with_excess(_explore(spark, d), index_frame(bars), market_of("ticker"))
    p = an.with_pvalues(an.t_statistics(trades, "candidate")).where("candidate <> 'c001'").select("candidate", "p_value")
    every = spark.createDataFrame([(x.id,) for x in sr.candidates(SEARCH)], "candidate string")
    return sr.fdr_family(p, every, 0.9).select("candidate", F.round("p_value", 6).alias("p_value"), "fdr_pass")


def closest_candidate(spark, d):
    hard = replace(SEARCH, win_rate=0.9, min_trades=80)
    return sr.closest(sr.score(_explore(spark, d), hard, sr.candidates(hard)), hard).select("candidate", "trades", "trades_short", F.round("win_rate_short", 6).alias("win_rate_short"))


QUERIES = {k: _shown(k) for k in RULES} | {
    f.__name__: f
    for f in (skipped, trade_candidates, trade_excess, trade_stats, cells, pnl_histogram, ticker_table, split_compare, summary_reasons, equity_curve, max_drawdown)
    + (period_split, t_stat, validation, bh_fdr, holm, random_benchmark, sector_asof, basis_asof_strict, next_bar_link, search_candidates, search_status, closest_candidate)
    + (trade_log, entry_mask, universe_preview, truncated, search_grid, search_estimate, search_forward, search_fdr)
}


def _sim(rule, source="s", tag="", bars="ebars", hold=None):
    """CTEs from signals to taken trades (tr) and skips (sk) of one strategy."""
    lim_dn = f"AND NOT coalesce(pc > 0 AND coalesce(open, 0.0) <= pc * (1 + {rule.limit_down}) + 1e-9, false)" if rule.limit_down is not None else ""
    lim_up = f"WHEN close > 0 AND eo >= close * (1 + {rule.limit_up}) - 1e-9 THEN 'limit_up'" if rule.limit_up is not None else ""
    tests = []
    if rule.stop_loss is not None:
        tests.append(f"WHEN r <= {rule.stop_loss} + 1e-9 THEN 'stop_loss'")
    if rule.take_profit is not None:
        tests.append(f"WHEN r >= {rule.take_profit} - 1e-9 THEN 'take_profit'")
    if rule.trailing is not None:
        tests.append(f"WHEN hc <= peak * (1 + {rule.trailing}) + 1e-9 * peak THEN 'trailing_stop'")
    if rule.breakeven is not None:
        tests.append(f"WHEN peak / entry - 1 >= {rule.breakeven} - 1e-9 AND r <= 1e-9 THEN 'breakeven_stop'")
    if rule.ma_exit:
        tests.append("WHEN hc < ma THEN 'ma_exit'")
    hold = hold or str(rule.max_hold)
    tests.append("WHEN rn - t >= hold THEN 'time'")
    x = tag
    return f"""nb0{x} AS (SELECT *, row_number() OVER ({OVER}) AS rn, count(*) OVER (PARTITION BY ticker) AS n, lag(close) OVER ({OVER}) AS pc, {s_mean('close', 5)} AS ma,
  lead(open) OVER ({OVER}) AS eo, lead(volume) OVER ({OVER}) AS ev, lead(date) OVER ({OVER}) AS ed FROM {bars}),
nb{x} AS (SELECT *, coalesce(volume > 0 AND open IS NOT NULL, false) {lim_dn} AS ok FROM nb0{x}),
cd{x} AS (SELECT nb{x}.*, rn AS t, CASE WHEN rn = n THEN 'no_next_day' WHEN NOT coalesce(ev > 0 AND eo IS NOT NULL, false) THEN 'halted_entry' {lim_up} END AS skip
  FROM nb{x} JOIN (SELECT ticker, date, signal FROM {source}) USING (ticker, date) WHERE signal),
pa{x} AS (SELECT cd.ticker, cd.t, h.rn, h.date AS hd, {hold} AS hold, h.close AS hc, h.ma, cd.eo AS entry, h.close / cd.eo - 1 AS r, greatest(cd.eo, max(h.close) OVER (PARTITION BY cd.ticker, cd.t ORDER BY h.rn)) AS peak
  FROM cd{x} cd JOIN nb{x} h ON h.ticker = cd.ticker AND h.rn > cd.t AND h.rn <= cd.t + {hold} WHERE cd.skip IS NULL),
de{x} AS (SELECT ticker, t, arg_min(why, rn) AS why, min(rn) AS decide, arg_min(hd, rn) AS ddate FROM (SELECT *, CASE {' '.join(tests)} END AS why FROM pa{x}) WHERE why IS NOT NULL GROUP BY 1, 2),
ex{x} AS (SELECT d.ticker, d.t, min(b.rn) AS xrn FROM de{x} d JOIN nb{x} b ON b.ticker = d.ticker AND b.rn > d.decide AND b.ok GROUP BY 1, 2),
oc{x} AS (SELECT cd.ticker, cd.t, cd.date AS signal_date, cd.skip, cd.ed AS entry_date, cd.eo AS entry_price, cd.n, de.decide, CASE WHEN skip IS NULL THEN de.ddate END AS exit_signal_date, xrn, CASE WHEN skip IS NULL THEN coalesce(xrn, cd.n) END AS x,
  CASE WHEN skip IS NULL THEN CASE WHEN xrn IS NULL THEN 'end_of_data' ELSE why END END AS exit_reason, CASE WHEN skip IS NULL THEN xrn IS NULL END AS exit_at_close,
  CASE WHEN skip IS NULL THEN (SELECT count(*) FROM nb{x} q WHERE q.ticker = cd.ticker AND q.rn > de.decide AND q.rn < coalesce(xrn, cd.n + 1) AND NOT q.ok) END AS exit_retries
  FROM cd{x} cd LEFT JOIN de{x} de ON de.ticker = cd.ticker AND de.t = cd.t LEFT JOIN ex{x} ex ON ex.ticker = cd.ticker AND ex.t = cd.t),
va{x} AS (SELECT ticker, t, x FROM oc{x} WHERE skip IS NULL),
ch{x} AS (SELECT ticker, min(t) AS t FROM va{x} GROUP BY 1 UNION ALL
  SELECT * FROM (SELECT ch.ticker, (SELECT min(v.t) FROM va{x} v WHERE v.ticker = ch.ticker AND v.t >= a.x) AS t FROM ch{x} ch JOIN va{x} a ON a.ticker = ch.ticker AND a.t = ch.t) WHERE t IS NOT NULL),
tr0{x} AS (SELECT oc.*, b.date AS exit_date, CASE WHEN exit_at_close THEN b.close ELSE b.open END AS exit_price FROM oc{x} oc JOIN ch{x} USING (ticker, t) JOIN nb{x} b ON b.ticker = oc.ticker AND b.rn = oc.x),
tr{x} AS (SELECT *, x - t - 1 + CAST(exit_at_close AS INT) AS hold_days, exit_price / entry_price - 1 AS gross_ret, exit_price / entry_price - 1 - {rule.cost} AS net_ret, exit_reason = 'end_of_data' AS excluded FROM tr0{x}),
sk{x} AS (SELECT ticker, signal_date, skip AS reason FROM oc{x} oc WHERE skip IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tr{x} q WHERE q.ticker = oc.ticker AND q.t < oc.t AND oc.t < q.x))"""


def _with(rule, select, more=""):
    return f"WITH RECURSIVE {EBARS_SQL}, {_PATTERN_CTES['ma_cross']}, {_sim(rule)}{', ' + more if more else ''} {select}"


_RICH = f"""{INDEX_SQL}, ri AS (SELECT tr.*, i.market, CASE WHEN exit_at_close THEN z.index_close ELSE z.index_open END / nullif(i.index_open, 0) - 1 AS index_ret FROM tr
  LEFT JOIN idx i ON i.date = tr.entry_date AND i.market = {MARKET_SQL} LEFT JOIN idx z ON z.date = tr.exit_date AND z.market = {MARKET_SQL}),
rich AS (SELECT *, net_ret - index_ret AS excess_ret FROM ri)"""
_STATS = """count(net_ret) AS trades, round(avg(CASE WHEN net_ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(avg(net_ret), 6) AS mean_ret, round(median(net_ret), 6) AS median_ret,
 round(avg(gross_ret), 6) AS mean_hold_ret, round(avg(excess_ret), 6) AS mean_excess, round(avg(net_ret) FILTER (net_ret > 0) / nullif(abs(avg(net_ret) FILTER (net_ret < 0)), 0), 6) AS payoff_ratio,
 round(CASE WHEN stddev_samp(net_ret) > 0 THEN avg(net_ret) / stddev_samp(net_ret) END, 6) AS sharpe"""
_SHOWN = f"SELECT {', '.join(COLS)}, round(entry_price, 6) AS entry_price, round(exit_price, 6) AS exit_price, round(gross_ret, 6) AS gross_ret, round(net_ret, 6) AS net_ret FROM tr"
_EQ = f"""inc AS (SELECT * FROM tr WHERE NOT excluded),
hd AS (SELECT b.date, CASE WHEN b.rn = i.x AND NOT i.exit_at_close THEN i.exit_price ELSE b.close END / nullif(CASE WHEN b.rn = i.t + 1 THEN i.entry_price ELSE b.pc END, 0) - 1 - CASE WHEN b.rn = i.x THEN {RULE.cost} ELSE 0 END AS r
  FROM inc i JOIN nb b ON b.ticker = i.ticker AND b.rn BETWEEN i.t + 1 AND i.x),
dl AS (SELECT date, avg(coalesce(r, 0)) AS ret, count(*) AS positions FROM hd GROUP BY 1),
cal AS (SELECT DISTINCT date FROM ebars WHERE date BETWEEN (SELECT min(entry_date) FROM inc) AND (SELECT max(exit_date) FROM inc)),
eq AS (SELECT cal.date, coalesce(ret, 0.0) AS ret, coalesce(positions, 0) AS positions FROM cal LEFT JOIN dl USING (date)),
eq2 AS (SELECT *, product(1 + ret) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM eq)"""


def _strategies(select, more=""):
    parts, unions = [], []
    for k, name in enumerate(STRATEGIES):
        x = _PATTERN_CTES[name]
        for cte in ("a", "b", "s"):
            x = x.replace(f"{cte} AS (SELECT", f"{cte}{k} AS (SELECT").replace(f"FROM {cte})", f"FROM {cte}{k})")
        parts += [x, _sim(RULE, f"s{k}", f"_{k}")]
        unions.append(f"SELECT '{name}' AS strategy, ticker, t, x, entry_date, exit_date, exit_at_close, net_ret, gross_ret, excluded FROM tr_{k}")
    return f"WITH RECURSIVE {EBARS_SQL}, {', '.join(parts)}, tr AS ({' UNION ALL '.join(unions)}), {_RICH}, incl AS (SELECT * FROM rich WHERE NOT excluded AND excess_ret IS NOT NULL){', ' + more if more else ''} {select}"


_PV = "pv AS (SELECT CAST(p_size AS VARCHAR) AS strategy, min(p_partkey) AS k FROM part GROUP BY 1), p AS (SELECT strategy, CASE WHEN k % 7 <> 0 THEN (k * 37 % 101) / 400.0 END AS p_value FROM pv)"
_SECTOR = "sec AS (SELECT ticker, date AS snapshot, 's' || CAST(CAST(floor(close) AS BIGINT) % 4 AS VARCHAR) AS sector FROM ebars WHERE hour(date) = 0)"


def _search(select, explore=True, more=""):
    """All candidates at once: bars and signals keyed by candidate and ticker."""
    bars = f"xb AS (SELECT * FROM ebars WHERE date <= TIMESTAMP '{SPLIT}')" if explore else "xb AS (SELECT * FROM ebars)"
    period = "" if explore else f" AND date >= TIMESTAMP '{AFTER}'"
    fast = lambda n: f"(lag(f{n}) OVER ({OVER}) <= lag(sl) OVER ({OVER}) AND f{n} > sl)"
    return f"""WITH RECURSIVE {EBARS_SQL}, {bars},
pf AS (SELECT *, {s_mean('close', 3)} AS f3, {s_mean('close', 5)} AS f5, {s_mean('close', 20)} AS sl, CASE WHEN count(high) OVER w = 20 THEN max(high) OVER w END AS hh FROM xb WINDOW w AS ({OVER} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
ps0 AS (SELECT *, volume > 0 AND coalesce({fast(3)}, false) AS m3, volume > 0 AND coalesce({fast(5)}, false) AS m5, volume > 0 AND coalesce(close > hh, false) AS bo FROM pf),
ca AS ({_CANDIDATES}),
cb0 AS (SELECT candidate || '#' || ticker AS ticker, date, open, high, low, close, volume, value, max_hold, CASE kind WHEN 1 THEN bo WHEN 2 THEN CASE fast WHEN 3 THEN m3 ELSE m5 END WHEN 3 THEN bo AND CASE fast WHEN 3 THEN m3 ELSE m5 END ELSE bo OR CASE fast WHEN 3 THEN m3 ELSE m5 END END{period} AS signal FROM ps0, ca), cb AS (SELECT * EXCLUDE (signal) FROM cb0),
{_sim(RULE, 'cb0', bars='cb', hold='cd.max_hold')},
se0 AS (SELECT split_part(ticker, '#', 1) AS candidate, count(*) AS trades, avg(CASE WHEN net_ret > 0 THEN 1.0 ELSE 0.0 END) AS win_rate FROM tr WHERE NOT excluded GROUP BY 1),
se AS (SELECT candidate, coalesce(trades, 0) AS trades, win_rate, coalesce(win_rate >= {SEARCH.win_rate} AND trades >= {SEARCH.min_trades}, false) AS met FROM ca LEFT JOIN se0 USING (candidate)){', ' + more if more else ''} {select}"""


_CANDIDATES = """SELECT 'c' || printf('%03d', row_number() OVER (ORDER BY kind, fast, max_hold)) AS candidate, * FROM
 (SELECT * FROM (VALUES (1, NULL, 'breakout', 'or'), (2, 3, 'ma_cross', 'or'), (2, 5, 'ma_cross', 'or'), (3, 3, 'breakout,ma_cross', 'and'), (3, 5, 'breakout,ma_cross', 'and'), (4, 3, 'breakout,ma_cross', 'or'), (4, 5, 'breakout,ma_cross', 'or')) k(kind, fast, patterns, combine), (VALUES (4), (8)) h(max_hold))"""
_MET = _search("SELECT candidate FROM se WHERE met")
_FORWARD = _search("SELECT candidate, trades, round(win_rate, 6) AS win_rate, met FROM se", explore=False)
_T_TAIL = lambda t, n: f"""CASE WHEN {t} IS NULL THEN NULL ELSE 0.5 - sign({t}) / 2 * (CASE WHEN {n} % 2 = 0 THEN sin(atan(abs({t}) / sqrt({n}))) * (1 + coalesce(list_sum(list_transform(range(1, CAST({n} / 2 AS INT)), lambda j: pow(cos(atan(abs({t}) / sqrt({n}))), 2 * j) * exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()))), 0))
 ELSE 2 / pi() * (atan(abs({t}) / sqrt({n})) + CASE WHEN {n} = 1 THEN 0 ELSE sin(atan(abs({t}) / sqrt({n}))) * (cos(atan(abs({t}) / sqrt({n}))) + coalesce(list_sum(list_transform(range(1, CAST(({n} - 1) / 2 AS INT)), lambda j: pow(cos(atan(abs({t}) / sqrt({n}))), 2 * j + 1) * sqrt(pi()) / 2 * exp(lgamma(j + 1) - lgamma(j + 1.5)))), 0)) END) END) END"""  # noqa: E731
_GROUPS = f"{_UNI}, w AS (SELECT *, {MARKET_SQL} AS market FROM u), gr AS (SELECT *, {_split('value')} AS cap_group, {_split('avg_value')} AS liq_group FROM w)"
_MASKED = f"coalesce(exclude_reason IS NULL AND market = 'M0' AND date BETWEEN TIMESTAMP '{MASK['start']}' AND TIMESTAMP '{MASK['end']}' AND avg_value >= {MASK['min_avg_value']} AND cap_group IN ('large', 'mid'), false)"
_DRAWN = f"""bn AS (SELECT b.ticker, row_number() OVER (PARTITION BY b.ticker ORDER BY b.date) AS rn, CASE WHEN open > 0 THEN open END AS o, CASE WHEN index_open > 0 THEN index_open END AS i FROM ebars b LEFT JOIN idx ON idx.date = b.date AND idx.market = {MARKET_SQL}),
mm AS (SELECT ticker, count(*) AS nn, count(*) FILTER (date < TIMESTAMP '{PERIOD.start}' OR date < TIMESTAMP '{WARM}') + 1 AS lo, count(*) FILTER (date <= TIMESTAMP '{PERIOD.end}') AS li FROM ebars GROUP BY 1),
rb AS (SELECT q.strategy, q.ticker, t, greatest(x - t - 1, 1) AS h, lo, least(nn - greatest(x - t - 1, 1), li) AS hi FROM incl q JOIN mm USING (ticker) WHERE least(nn - greatest(x - t - 1, 1), li) >= lo),
rd AS (SELECT strategy, ticker, draw, h, CAST(lo + floor(CAST(('0x' || substr(md5(ticker || '|' || CAST(t AS VARCHAR) || '|' || CAST(draw AS VARCHAR)), 1, 12)) AS BIGINT) / 281474976710656.0 * (hi - lo + 1)) AS INT) AS a FROM rb, range({DRAWS}) it(draw)),
mns AS (SELECT strategy, draw, CAST(sum(CAST(round(z.o / p.o - 1 - {RULE.cost} - (z.i / p.i - 1), 9) AS DECIMAL(18,9))) AS DOUBLE) / count(z.o / p.o - z.i / p.i) AS mean FROM rd JOIN bn p ON p.ticker = rd.ticker AND p.rn = rd.a JOIN bn z ON z.ticker = rd.ticker AND z.rn = rd.a + rd.h GROUP BY 1, 2),
act AS (SELECT strategy, CAST(sum(CAST(round(excess_ret, 9) AS DECIMAL(18,9))) AS DOUBLE) / count(*) AS actual FROM incl GROUP BY 1),
rbm AS (SELECT m.strategy, max(a.actual) AS actual, avg(m.mean) AS random_mean, avg(CASE WHEN m.mean < a.actual THEN 1.0 WHEN m.mean = a.actual THEN 0.5 ELSE 0.0 END) AS percentile FROM mns m JOIN act a USING (strategy) GROUP BY 1),
rbn AS (SELECT *, (SELECT count(*) FROM rb WHERE rb.strategy = rbm.strategy) AS n FROM rbm)"""
_SPLITS = f"""ps AS (SELECT strategy, count(excess_ret) FILTER (e) AS h1_trades, count(excess_ret) FILTER (NOT e) AS h2_trades, avg(excess_ret) FILTER (e) AS h1_mean, avg(excess_ret) FILTER (NOT e) AS h2_mean
FROM (SELECT *, entry_date <= TIMESTAMP '{SPLIT}' AS e FROM incl) GROUP BY 1),
ps2 AS (SELECT *, CASE WHEN h1_mean IS NOT NULL THEN rank() OVER (ORDER BY h1_mean DESC NULLS LAST) END AS h1_rank, CASE WHEN h2_mean IS NOT NULL THEN rank() OVER (ORDER BY h2_mean DESC NULLS LAST) END AS h2_rank FROM ps),
jd AS (SELECT *, CASE WHEN h1_trades < 30 OR h2_trades < 30 THEN 'sample_insufficient' WHEN sign(h1_mean) <> sign(h2_mean) THEN 'reversed' WHEN h1_mean <= 0 THEN 'negative_both' WHEN h2_rank <= h1_rank THEN 'maintained' ELSE 'weakened' END AS judgement FROM ps2)"""
_TS = "ts AS (SELECT {key} AS strategy, count(*) AS n, CASE WHEN stddev_samp(excess_ret) > 0 THEN avg(excess_ret) / (stddev_samp(excess_ret) / sqrt(count(*))) END AS t FROM {source} GROUP BY 1), tp AS (SELECT strategy, n, " + _T_TAIL("t", "(n - 1)") + " AS p_value FROM ts)"
_BH = lambda source, q: f"kk AS (SELECT *, row_number() OVER (ORDER BY p_value NULLS LAST, strategy) AS k, count(p_value) OVER () AS m FROM {source}), ll AS (SELECT max(k) AS last FROM kk WHERE p_value <= {q} * k / m), bh AS (SELECT *, coalesce(k <= (SELECT last FROM ll), false) AND p_value IS NOT NULL AS fdr_pass FROM kk)"


SQL = {k: _with(r, _SHOWN) for k, r in RULES.items()} | {
    "skipped": _with(RULES["trades_limits"], "SELECT * FROM sk"),
    "trade_candidates": _with(RULE, "SELECT ticker, t, signal_date, skip, x, exit_reason, exit_retries FROM oc"),
    "trade_excess": _with(RULE, "SELECT ticker, signal_date, market, round(index_ret, 6) AS index_ret, round(excess_ret, 6) AS excess_ret FROM rich", _RICH),
    "trade_stats": _with(RULE, f"SELECT {_STATS} FROM rich WHERE NOT excluded", _RICH),
    "cells": _with(
        RULE,
        f"""SELECT coalesce(g.regime, 'unavailable') AS regime, coalesce(h.market_regime, 'unavailable') AS market_regime, coalesce(rich.market, 'unavailable') AS market, {_STATS}, count(net_ret) >= 30 AS sample_ok
FROM rich LEFT JOIN g ON g.ticker = rich.ticker AND g.date = rich.signal_date LEFT JOIN h ON h.market = rich.market AND h.date = rich.signal_date WHERE NOT excluded GROUP BY 1, 2, 3""",
        _RICH + ", " + _REG + ", " + _MREG.replace(INDEX_SQL + ", ", ""),
    ),
    "pnl_histogram": _with(RULE, "SELECT CAST(bins.bin AS INT) AS bin, coalesce(n, 0) AS n FROM range(32) bins(bin) LEFT JOIN (SELECT CASE WHEN p < -30 THEN 0 WHEN p >= 30 THEN 31 ELSE floor((p + 30) / 2) + 1 END AS bin, count(*) AS n FROM (SELECT round(net_ret * 100, 9) AS p FROM tr WHERE NOT excluded) GROUP BY 1) q ON q.bin = bins.bin"),
    "ticker_table": _with(RULE, f"SELECT ticker, mode(market) AS market, {_STATS}, count(net_ret) >= 15 AS sample_ok FROM rich WHERE NOT excluded GROUP BY 1", _RICH),
    "split_compare": _with(RULE, f"SELECT CASE WHEN entry_date <= TIMESTAMP '{SPLIT}' THEN 'first' ELSE 'second' END AS half, {_STATS} FROM rich WHERE NOT excluded GROUP BY 1", _RICH),
    "summary_reasons": _with(RULES["trades_limits"], "SELECT exit_reason AS reason, count(*) AS n, 'exit' AS kind FROM tr GROUP BY 1 UNION ALL SELECT reason, count(*), 'skip' FROM sk GROUP BY 1"),
    "equity_curve": _with(RULE, "SELECT date, positions, round(ret, 6) AS ret FROM eq", _EQ),
    "max_drawdown": _with(RULE, "SELECT round(min(equity / greatest(1.0, pk) - 1), 6) AS mdd FROM (SELECT equity, max(equity) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS pk FROM eq2)", _EQ),
    "period_split": _strategies(
        """SELECT strategy, h1_trades, h2_trades, round(h1_mean, 6) AS h1_mean, round(h2_mean, 6) AS h2_mean, h1_rank, h2_rank, CASE WHEN h1_trades < 30 OR h2_trades < 30 THEN 'sample_insufficient'
WHEN sign(h1_mean) <> sign(h2_mean) THEN 'reversed' WHEN h1_mean <= 0 THEN 'negative_both' WHEN h2_rank <= h1_rank THEN 'maintained' ELSE 'weakened' END AS judgement FROM ps2""",
        f"""ps AS (SELECT strategy, count(excess_ret) FILTER (e) AS h1_trades, count(excess_ret) FILTER (NOT e) AS h2_trades, avg(excess_ret) FILTER (e) AS h1_mean, avg(excess_ret) FILTER (NOT e) AS h2_mean
FROM (SELECT *, entry_date <= TIMESTAMP '{SPLIT}' AS e FROM incl) GROUP BY 1),
ps2 AS (SELECT *, CASE WHEN h1_mean IS NOT NULL THEN rank() OVER (ORDER BY h1_mean DESC NULLS LAST) END AS h1_rank, CASE WHEN h2_mean IS NOT NULL THEN rank() OVER (ORDER BY h2_mean DESC NULLS LAST) END AS h2_rank FROM ps)""",
    ),
    "t_stat": _strategies("SELECT strategy, count(*) AS n, round(CASE WHEN stddev_samp(excess_ret) > 0 THEN avg(excess_ret) / (stddev_samp(excess_ret) / sqrt(count(*))) END, 6) AS t FROM incl GROUP BY 1"),
    "bh_fdr": f"WITH {_PV}, k AS (SELECT *, row_number() OVER (ORDER BY p_value NULLS LAST, strategy) AS k, count(p_value) OVER () AS m FROM p), l AS (SELECT max(k) AS last FROM k WHERE p_value <= 0.2 * k / m) SELECT strategy, p_value, coalesce(k <= (SELECT last FROM l), false) AND p_value IS NOT NULL AS fdr_pass FROM k",
    "holm": f"WITH {_PV}, k AS (SELECT *, coalesce(p_value <= 0.2 / (count(p_value) OVER () - row_number() OVER (ORDER BY p_value NULLS LAST, strategy) + 1), false) AS ok FROM p) SELECT strategy, p_value, bool_and(ok) OVER (ORDER BY p_value NULLS LAST, strategy ROWS UNBOUNDED PRECEDING) AS holm_pass FROM k",
    "random_benchmark": _with(RULE, "SELECT strategy, n, round(actual, 6) AS actual, round(random_mean, 6) AS random_mean, round(percentile, 6) AS percentile FROM rbn", _RICH + ", incl AS (SELECT 'ma_cross' AS strategy, * FROM rich WHERE NOT excluded AND excess_ret IS NOT NULL), " + _DRAWN),
    "validation": _strategies(
        """SELECT bh.strategy, bh.n, judgement, round(p_value, 6) AS p_value, round(percentile, 6) AS percentile, fdr_pass, judgement IN ('maintained', 'weakened') AS split_pass, coalesce(percentile >= 0.95, false) AS random_pass, count(*) OVER () AS family,
 fdr_pass AND judgement IN ('maintained', 'weakened') AND coalesce(percentile >= 0.95, false) AS analysis_target FROM bh JOIN jd USING (strategy) LEFT JOIN rbn USING (strategy)""",
        ", ".join([_SPLITS, _TS.format(key="strategy", source="incl"), _BH("tp", 0.5), _DRAWN]),
    ),
    "trade_log": f"WITH RECURSIVE {EBARS_SQL}, {_GROUPS}, {_PATTERN_CTES['ma_cross']}, sg AS (SELECT s.ticker, s.date, signal AND exclude_reason IS NULL AS signal FROM s JOIN gr USING (ticker, date)), {_sim(RULE, 'sg')} SELECT tr.ticker, signal_date, entry_date, exit_signal_date, exit_date, market, cap_group, liq_group, round(net_ret, 6) AS net_ret FROM tr JOIN gr ON gr.ticker = tr.ticker AND gr.date = tr.signal_date",
    "entry_mask": f"WITH {EBARS_SQL}, {_GROUPS}, {_PATTERN_CTES['ma_cross']} SELECT ticker, date, cap_group FROM gr JOIN (SELECT ticker, date, signal FROM s) s USING (ticker, date) WHERE signal AND {_MASKED}",
    "universe_preview": f"WITH {EBARS_SQL}, {_GROUPS} SELECT count(DISTINCT ticker) AS tickers, count(*) AS ticker_hours, count(DISTINCT date) AS hours, round(count(*) / nullif(count(DISTINCT date), 0), 1) AS average FROM gr WHERE {_MASKED}",
    "truncated": f"""WITH {EBARS_SQL}, b AS (SELECT * FROM ebars WHERE ticker NOT LIKE '%-3' OR date < TIMESTAMP '2024-01-10') SELECT ticker, count(*) FILTER (date <= TIMESTAMP '{SPLIT}') AS bars, max(date) FILTER (date <= TIMESTAMP '{SPLIT}') AS "last", max(date) <= TIMESTAMP '{SPLIT}' AS gone FROM b GROUP BY 1""",
    "search_grid": f"WITH {EBARS_SQL}, ca AS ({_CANDIDATES}) SELECT candidate, patterns, combine, coalesce('ma_cross.fast=' || fast, '') AS params, max_hold, (SELECT round(greatest(0.1, 2.5 * count(DISTINCT ticker) / 3095), 1) FROM ebars) AS seconds FROM ca",
    "search_estimate": f"WITH {EBARS_SQL}, ca AS ({_CANDIDATES}) SELECT (SELECT count(*) FROM ca) AS candidates, round((SELECT count(*) FROM ca) * greatest(0.1, 2.5 * count(DISTINCT ticker) / 3095), 1) AS seconds FROM ebars",
    "search_forward": f"SELECT * FROM ({_FORWARD}) WHERE candidate IN ({_MET})",
    "search_fdr": _search(
        "SELECT strategy AS candidate, round(p_value, 6) AS p_value, fdr_pass FROM bh",
        more=f"""{INDEX_SQL}, ri AS (SELECT split_part(tr.ticker, '#', 1) AS strategy, excluded, net_ret - (CASE WHEN exit_at_close THEN z.index_close ELSE z.index_open END / nullif(i.index_open, 0) - 1) AS excess_ret FROM tr
  LEFT JOIN idx i ON i.date = tr.entry_date AND i.market = {MARKET_SQL} LEFT JOIN idx z ON z.date = tr.exit_date AND z.market = {MARKET_SQL}),
il AS (SELECT * FROM ri WHERE NOT excluded AND excess_ret IS NOT NULL), {_TS.format(key='strategy', source='il')}, fm AS (SELECT candidate AS strategy, coalesce(CASE WHEN candidate <> 'c001' THEN p_value END, 1.0) AS p_value FROM ca LEFT JOIN tp ON tp.strategy = ca.candidate), {_BH('fm', 0.9)}""",
    ),
    "sector_asof": _with(RULE, "SELECT tr.ticker, signal_date, exit_reason, sector FROM tr ASOF LEFT JOIN sec ON tr.ticker = sec.ticker AND tr.signal_date >= sec.snapshot", _SECTOR),
    "basis_asof_strict": f"WITH {EBARS_SQL}, {_SECTOR} SELECT b.ticker, date, close, sector FROM ebars b ASOF LEFT JOIN sec ON b.ticker = sec.ticker AND b.date > sec.snapshot",
    "next_bar_link": f"WITH {EBARS_SQL}, q AS (SELECT event_id, ts, ticker FROM e) SELECT event_id, q.ticker, b.date AS bar FROM q ASOF LEFT JOIN ebars b ON q.ticker = b.ticker AND q.ts < b.date",
    "search_candidates": _search("SELECT candidate, trades, round(win_rate, 6) AS win_rate, met FROM se"),
    "search_status": f"""SELECT candidate, status, row_number() OVER (ORDER BY list_position(['both', 'explore_only', 'not_evaluated', 'not_met', 'insufficient_trades'], status), win_rate DESC NULLS LAST, candidate) AS place FROM
 (SELECT e.candidate, e.win_rate, CASE WHEN e.met AND coalesce(f.met, false) THEN 'both' WHEN e.met AND f.candidate IS NOT NULL THEN 'explore_only' WHEN e.met THEN 'not_evaluated' WHEN e.trades >= {SEARCH.min_trades} THEN 'not_met' ELSE 'insufficient_trades' END AS status
  FROM ({_search('SELECT * FROM se')}) e LEFT JOIN (SELECT * FROM ({_FORWARD}) WHERE candidate IN ({_MET})) f USING (candidate))""",
    "closest_candidate": _search("SELECT candidate, trades, greatest(80 - trades, 0) AS trades_short, round(short, 6) AS win_rate_short FROM (SELECT *, CASE WHEN win_rate IS NULL THEN 1.0 ELSE greatest(round(0.9 - win_rate, 9), 0.0) END AS short FROM se) ORDER BY trades_short, short, trades DESC, candidate LIMIT 1"),
}
