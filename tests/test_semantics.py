"""Hand-computed cases of the operators."""

import datetime as dt
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.functions import text as tx
from tidemark.operators import analysis as an
from tidemark.operators import backtest as bt
from tidemark.operators import bars as br
from tidemark.operators import documents as dc
from tidemark.operators import forecast as fc
from tidemark.operators import indicators as ind
from tidemark.operators import ingest as ing
from tidemark.operators import patterns as pat
from tidemark.operators import phrases
from tidemark.operators import retrieval as rt
from tidemark.operators import search as sr
from tidemark.operators import universe as uni
from tidemark.streaming import streams as ss

DAY0 = dt.datetime(2021, 1, 4)


def bars(spark, closes, ticker="A", **cols):
    rows = []
    for k, x in enumerate(closes):
        row = {"ticker": ticker, "date": DAY0 + dt.timedelta(days=k), "open": float(x), "high": float(x), "low": float(x), "close": float(x), "volume": 1000, "value": 1e9}
        rows.append(row | {n: v[k] for n, v in cols.items()})
    return spark.createDataFrame(rows, "ticker string, date timestamp_ntz, open double, high double, low double, close double, volume long, value double")


def column(df, x):
    return [r[0] for r in df.select("date", x.alias("x")).orderBy("date").select("x").collect()]


def test_sma_is_null_until_full(spark):
    assert column(bars(spark, range(1, 7)), ind.sma(5)) == [None] * 4 + [3.0, 4.0]


def test_windows_do_not_cross_keys(spark):
    df = bars(spark, [1, 2, 3, 4, 5]).union(bars(spark, [8, 9, 10], "B"))
    got = [r["x"] for r in df.select("ticker", "date", ind.sma(3).alias("x")).where("ticker = 'B'").orderBy("date").collect()]
    assert got == [None, None, 9.0]


def test_rsi(spark):
    closes = [100.0]
    for k in range(14):
        closes.append(closes[-1] + (1 if k % 2 == 0 else -3 / 7))
    got = column(bars(spark, closes), ind.rsi(14))
    assert got[:14] == [None] * 14
    assert got[14] == pytest.approx(70)


def test_bollinger_and_vwap(spark):
    assert column(bars(spark, [1, 2, 3, 4]), ind.bollinger(4, 2.0))[-1] == pytest.approx(2.5 - 2 * math.sqrt(1.25))
    assert column(bars(spark, [10, 20], volume=[1, 3]), ind.vwap(2))[-1] == pytest.approx(17.5)
    assert column(bars(spark, [1, 2, 3, 100]), ind.previous_max(3))[-1] == 3


def test_ema_follows_the_recursion(spark):
    df = ind.with_ema(bars(spark, [1, 2, 3, 4]), "y", "close", 0.5, 2)
    assert column(df, F.col("y")) == [None, 1.5, 2.25, 3.125]


@pytest.mark.parametrize("row,label", [((100, 90, 80), "bull"), ((90, 100, 102), "bear"), ((110, 100, 99.5), "sideways"), ((100, 100, 98), "sideways"), ((100, None, 98), None)])
def test_regime(spark, row, label):
    df = spark.createDataFrame([tuple(None if x is None else float(x) for x in row)], "c double, m double, b double")
    assert df.select(uni.classify(F.col("c"), F.col("m"), F.col("b"), 0.01)).first()[0] == label


def signal_at(df, *places):
    dates = [DAY0 + dt.timedelta(days=p) for p in places]
    return df.withColumn("signal", F.col("date").isin(dates))


def run(df, **rule):
    trades, skips = bt.simulate(df, bt.ExitRule(**({"max_hold": 20, "stop_loss": -0.08, "take_profit": 0.2} | rule)))
    t = [r.asDict() for r in trades.orderBy("t").collect()]
    return t, [r["reason"] for r in skips.collect()]


def test_time_exit(spark):
    (t,), skips = run(signal_at(bars(spark, [100] * 40), 5))
    assert (t["exit_reason"], t["entry_date"], t["exit_date"], t["hold_days"]) == ("time", DAY0 + dt.timedelta(6), DAY0 + dt.timedelta(26), 20)
    assert t["net_ret"] == pytest.approx(-0.003) and not skips


def test_stop_and_profit(spark):
    (t,), _ = run(signal_at(bars(spark, [100] * 8 + [92] + [100] * 20), 5))
    assert (t["exit_reason"], t["exit_date"]) == ("stop_loss", DAY0 + dt.timedelta(9))
    (t,), _ = run(signal_at(bars(spark, [100] * 7 + [119.9, 120] + [100] * 20), 5))
    assert (t["exit_reason"], t["exit_date"]) == ("take_profit", DAY0 + dt.timedelta(9))


def test_trailing_stop_follows_the_peak(spark):
    """Entry at 50; the peak of 80 makes the stop 64, which 63 breaks on row 9."""
    closes = [50] * 5 + [56, 80, 71, 66, 63] + [90] * 12
    (t,), _ = run(signal_at(bars(spark, closes), 3), trailing=-0.2, take_profit=None, stop_loss=None)
    assert (t["exit_reason"], t["exit_date"], t["exit_signal_date"]) == ("trailing_stop", DAY0 + dt.timedelta(10), DAY0 + dt.timedelta(9))


@pytest.mark.parametrize("trigger,reason", [(0.1, "breakeven_stop"), (0.3, "time")])
def test_breakeven_needs_its_trigger(spark, trigger, reason):
    """The close rises by a quarter, then falls to the entry price of 40."""
    closes = [40] * 4 + [44, 50, 46, 40] + [41] * 20
    (t,), _ = run(signal_at(bars(spark, closes), 2), breakeven=trigger, stop_loss=None, take_profit=None, max_hold=12)
    assert t["exit_reason"] == reason


def test_halted_entry_and_end_of_data(spark):
    volume = [1000] * 40
    volume[6] = 0
    assert run(signal_at(bars(spark, [100] * 40, volume=volume), 5)) == ([], ["halted_entry"])
    (t,), _ = run(signal_at(bars(spark, [100] * 10), 5))
    assert (t["exit_reason"], t["excluded"], t["exit_at_close"]) == ("end_of_data", True, True)
    assert run(signal_at(bars(spark, [100] * 10), 9)) == ([], ["no_next_day"])


def test_delisted_is_kept(spark):
    df = signal_at(bars(spark, [100] * 9 + [95]), 5)
    trades, _ = bt.simulate(df, bt.ExitRule(max_hold=20, stop_loss=None, take_profit=None), delisted=df.select("ticker"))
    r = trades.first()
    assert (r["exit_reason"], r["excluded"], r["exit_price"]) == ("delisted", False, 95.0)


def test_one_position_a_key(spark):
    t, skips = run(signal_at(bars(spark, [100] * 60), 5, 10, 20, 26, 30))
    assert [r["t"] for r in t] == [6, 27] and not skips


def test_retries(spark):
    volume = [1000] * 20
    volume[9] = volume[10] = 0
    (t,), _ = run(signal_at(bars(spark, [100] * 8 + [90] + [100] * 11, volume=volume), 5))
    assert (t["exit_date"], t["exit_retries"]) == (DAY0 + dt.timedelta(11), 2)


def slow_hit(rule, close, under, t, entry):
    """Row and reason by going through the rows after ``t`` one by one."""
    peak = entry
    for j in range(t + 1, min(t + rule.max_hold, len(close) - 1) + 1):
        x = close[j]
        seen = not np.isnan(x)
        peak = max(peak, x) if seen else peak
        gain = x / entry - 1
        tests = [
            ("stop_loss", rule.stop_loss is not None and seen and gain <= rule.stop_loss + bt.EPS),
            ("take_profit", rule.take_profit is not None and seen and gain >= rule.take_profit - bt.EPS),
            ("trailing_stop", rule.trailing is not None and seen and x <= peak * (1 + rule.trailing) + bt.EPS * peak),
            ("breakeven_stop", rule.breakeven is not None and seen and peak / entry - 1 >= rule.breakeven - bt.EPS and gain <= bt.EPS),
            ("ma_exit", rule.ma_exit is not None and under[j]),
            ("time", j - t >= rule.max_hold),
        ]
        for name, met in tests:
            if met:
                return j, name
    return -1, None


@pytest.mark.parametrize("seed", range(8))
def test_first_hits_against_going_row_by_row(seed):
    rng = np.random.default_rng(seed)
    reasons = set()
    for _ in range(60):
        n = int(rng.integers(1, 400))
        close = np.round(100 * np.exp(np.cumsum(rng.normal(0, 0.02, n))), int(rng.integers(0, 3)))
        close[rng.random(n) < 0.05] = np.nan
        under = rng.random(n) < 0.01
        maybe = lambda x: x if rng.random() < 0.6 else None
        rule = bt.ExitRule(int(rng.integers(1, 251)), maybe(-rng.choice([0, 0.02, 0.1])), maybe(rng.choice([0, 0.03, 0.1])), maybe(-rng.choice([0, 0.05, 0.1])), maybe(rng.choice([0, 0.02, 0.05])), maybe("ma"))
        t = np.flatnonzero(rng.random(n) < 0.3)
        entry = np.where(np.isnan(close[t]), 100.0, close[t])
        row, reason = bt.first_hits(rule, close, under, t, entry)
        got = [(int(r), str(w) if r >= 0 else None) for r, w in zip(row, reason)]
        assert got == [slow_hit(rule, close, under, k, e) for k, e in zip(t, entry)]
        reasons |= {w for _, w in got}
    assert len(reasons) == 7


def test_chunks_of_a_key_change_nothing(spark, monkeypatch):
    """Their length does not matter, from the longest holding period on."""
    rng = np.random.default_rng(5)
    df = bars(spark, list(np.round(100 * np.exp(np.cumsum(rng.normal(0, 0.03, 300))), 2))).withColumn("signal", F.dayofmonth("date") % 3 == 0)
    rule = bt.ExitRule(max_hold=25, stop_loss=-0.1, take_profit=0.1, trailing=-0.08)
    want = sorted(map(str, bt.outcomes(df, rule, carry=("volume",)).collect()))
    for size in (25, 64, 299):
        monkeypatch.setattr(bt, "CHUNK", size)
        assert sorted(map(str, bt.outcomes(df, rule, carry=("volume",)).collect())) == want


def test_time_does_not_grow_with_the_holding_period():
    """250 rows take twice the steps of 8; going row by row they would take 31 times as long."""
    close = 100 * np.exp(np.cumsum(np.random.default_rng(1).normal(0, 1e-4, bt.CHUNK)))
    t = np.arange(len(close) - 1)

    def seconds(hold):
        took = []
        for _ in range(5):
            at = time.perf_counter()
            bt.first_hits(bt.ExitRule(hold, -0.5, 0.5), close, np.zeros(len(close), bool), t, close[t])
            took.append(time.perf_counter() - at)
        return min(took)

    assert seconds(250) < 4 * seconds(8)


def test_rule_is_validated():
    with pytest.raises(ValueError):
        bt.ExitRule(max_hold=0)
    with pytest.raises(ValueError):
        bt.ExitRule(stop_loss=0.1)
    with pytest.raises(ValueError):
        pat.parameters("ma_cross", fast=20, slow=5)
    with pytest.raises(ValueError):
        pat.parameters("ma_cross", speed=1)


@pytest.mark.parametrize(
    "p,expected",
    [
        ((0.004, 0.019, 0.031, 0.6), "TTTF"),  # bounds 0.025, 0.05, 0.075, 0.1
        ((0.09, 0.0999), "TT"),  # only the second bound holds, so both go
        ((0.4, 0.11, 0.2), "FFF"),
        ((0.04, None, 0.7), "TFF"),  # two count: bounds 0.05 and 0.1
        ((), ""),
    ],
)
def test_benjamini_hochberg(spark, p, expected):
    df = spark.createDataFrame([(f"s{k}", x) for k, x in enumerate(p)], "strategy string, p_value double")
    got = an.benjamini_hochberg(df, 0.1).orderBy("strategy").collect()
    assert "".join("T" if r["fdr_pass"] else "F" for r in got) == expected


def test_distribution_tails():
    assert stats.student_t_upper(2.086, 20) == pytest.approx(0.025, abs=1e-4)
    assert stats.student_t_upper(-1.812, 10) == pytest.approx(0.95, abs=1e-3)
    assert stats.binomial_upper(8, 10) == pytest.approx(56 / 1024)
    assert stats.binomial_upper(0, 5) == 1


def test_targets_stay_in_their_segment(spark):
    df = bars(spark, [100, 110, 121, 100, 50, 55]).withColumn("segment", F.when(F.col("date") < F.lit(DAY0 + dt.timedelta(4)), 0).otherwise(1))
    got = column(fc.targets(df), F.col("y"))
    assert got[3] is None and got[5] is None
    assert got[:3] == pytest.approx([math.log(1.1), math.log(1.1), math.log(100 / 121)]) and got[4] == pytest.approx(math.log(1.1))


def test_direction(spark):
    df = spark.createDataFrame([(0.55,), (0.549,), (0.45,), (0.451,), (None,)], "p double")
    assert [r[0] for r in df.select(fc.direction(F.col("p"))).collect()] == ["up", "uncertain", "down", "uncertain", None]


def test_tokenize(spark):
    """Latin runs whole and in lower case, Hangul runs by pairs, one syllable alone."""
    df = spark.createDataFrame([("바다와 강",), ("Wind-7 시스템X",), ("!?",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.tokenize(F.col("t"))).collect()] == [["바다", "다와", "강"], ["wind", "7", "시스", "스템", "x"], [], []]


def test_folded_texts(spark):
    df = spark.createDataFrame([("ＧＯ② — Café",), ("plain Text",), (None,)], "t string")
    assert [r[0] for r in df.select(rt.folded(F.col("t"))).collect()] == ["go2 caf ", "plain text", ""]
    assert phrases.fold("ＧＯ② — Café") == "go2 caf "


@pytest.mark.parametrize(
    "query,text,found",
    [
        ("강물", "푸른강물이", True),  # the word itself may be part of another
        ("강물이", "강물은 깊다", True),  # base with another fitting particle
        ("강물이", "강물집 앞", False),  # base as part of a longer word
        ("바다는", "바다를 본다", True),
        ("바다은", "바다를 본다", False),  # the particle does not fit an open syllable
        ("wind7", "wind 7", False),  # Latin identifiers are not put together
        ("win", "wind", False),
        ("강물 wind", "wind와 강물", True),
        ("", "강물", False),
    ],
)
def test_query_conditions(spark, query, text, found):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(phrases.queries_met(spark, [F.col("t")], {7: query})).first()[0] == ([7] if found else [])


def test_conditions_are_not_put_together_from_fields(spark):
    df = spark.createDataFrame([("강", "물", "강물", None)], "a string, b string, c string, d string")
    got = df.select(phrases.queries_met(spark, [F.col("a"), F.col("b")], {1: "강물"}), phrases.queries_met(spark, [F.col("c"), F.col("d")], {1: "강물", 2: "물", 3: "불"})).first()
    assert tuple(got) == ([], [1, 2])


def test_many_names_against_each_by_itself(spark):
    """20,000 names over texts that hold some of them, with endings, gaps and longer words around."""
    rng = random.Random(8)
    syllables, letters = "가나다라마바사아자차강산물", "abcde01"
    word = lambda: "".join(rng.choice(syllables if rng.random() < 0.6 else letters) for _ in range(rng.randint(2, 4)))
    names = {f"K{k:05d}": " ".join(word() for _ in range(rng.randint(1, 2))) for k in range(20_000)}
    some = rng.sample(sorted(names), 60)
    texts = ["".join(rng.choice(["", " ", "-"]) + rng.choice([names[rng.choice(some)], word()]) + rng.choice(["", "의", "에서", "x", "이"]) for _ in range(6)) for _ in range(60)]

    def holds(text, name):
        """As a pattern over the folded text, one name at a time."""
        ws = phrases.fold(name).split()
        gap = lambda w: "".join(a + ("" if not b or (a.isascii() and b.isascii()) else r"\s*") for a, b in zip(w, [*w[1:], ""]))
        tails = "|".join(phrases.particles(ws[-1]) | set(phrases.NAME_ENDINGS))
        return re.search(rf"(?<![0-9a-z가-힣]){r'\s*'.join(map(gap, ws))}(?:{tails})?(?![0-9a-z가-힣])", phrases.fold(text)) is not None

    df = spark.createDataFrame([(k, t, []) for k, t in enumerate(texts)], "id long, title string, codes array<string>")
    found = rt.key_matches(df, names)
    got = {r["id"]: [x["code"] for x in r["mentions"]] for r in found.collect()}
    assert sum(map(len, got.values())) > 60
    for k, text in enumerate(texts):
        assert [x for x in got.get(k, []) if x in some] == sorted(x for x in some if holds(text, names[x]))
    few = rt.key_matches(df, {x: names[x] for x in some[:1]})
    plan = lambda x: len(x._jdf.queryExecution().optimizedPlan().toString())
    assert plan(found) <= plan(few) + 50


def test_titles_take_the_longest_name(spark):
    df = spark.createDataFrame([("a small ring",), ("ring",), ("bolted",), ("none",), (None,), ("",)], "t string")
    names = {"r": "ring", "s": "small ring", "b": "bolt", "also": "bolt", "empty": ""}
    assert [r[0] for r in df.select(ing.classify_title(spark, F.col("t"), names)).collect()] == ["s", "r", "also", None, None, None]


def test_request_plan_goes_round(spark):
    rows = [(" b", 2), ("a ", 1), ("", 3), ("c", 5), ("b", 9), (None, 0)]
    plan = lambda *args: [tuple(r) for r in ing.request_plan(spark.createDataFrame(rows, "query string, seq int"), *args).orderBy("place").collect()]
    assert plan(1, 4, 2) == [(0, "b", 1, 1), (1, "c", 1, 1), (2, "a", 1, 1), (3, "b", 101, 1)]
    assert plan(2, 2, 1) == [(0, "c", 1, 1), (1, "a", 1, 1)]
    assert plan(0, 9, 0) == []


def test_name_mentions(spark):
    rows = [(1, "큰나무가 자란다", []), (2, "큰나무집", []), (3, "other", ["Q"]), (4, "other", ["Z"])]
    m = rt.key_matches(spark.createDataFrame(rows, "id long, title string, codes array<string>"), {"Q": "큰나무"})
    assert {r["id"]: (r["linked"], [x["code"] for x in r["mentions"]]) for r in m.collect()} == {1: ([], ["Q"]), 3: (["Q"], [])}


def test_bm25_sees_visible_documents_only(spark):
    """Index of four; documents three and four are not visible and do not count."""
    docs = spark.createDataFrame([(1, "oak elm"), (2, "oak"), (3, "elm elm"), (4, "elm oak fir")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "elm")], "query_id long, token string")
    seen = dc.lengths(docs.where("doc_id < 3"), "doc_id", "text")
    (r,) = dc.bm25(dc.postings(docs, "doc_id", "text"), seen, q).collect()
    assert (r["doc_id"], r["matched"]) == (1, 1)
    # two documents, one with the token, lengths 2 and 1: idf = ln 2
    assert r["score"] == pytest.approx(math.log(2) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / 1.5)), abs=1e-5)


def test_changed_versions_are_not_back_dated(spark):
    day = lambda k: dt.datetime(2024, 5, k)
    rows = [(1, 1, "a", day(9), day(2)), (1, 2, "a", day(1), day(3)), (1, 3, "b", day(1), day(4)), (1, 4, "c", day(1), day(20))]
    df = spark.createDataFrame(rows, "doc_id long, version long, title string, available_at timestamp_ntz, first_seen_at timestamp_ntz")
    got = [(r["kind"], r["effective_at"].day) for r in dc.classify_versions(df).orderBy("version").collect()]
    assert got == [("new", 9), ("duplicate", 9), ("changed", 9), ("changed", 20)]


def test_pages_as_text(spark):
    df = spark.createDataFrame([("<p>x &amp; y</p> <script>no</script>caf&eacute;<br>z\n &nbsp; 1 < 2",)], "h string")
    assert df.select(tx.plain_text(F.col("h"))).first()[0] == "x & y caféz 1 < 2"


def test_urls(spark):
    rows = [("https://Müller.Example:443?q=1&UTM_medium=x#z", "https://xn--mller-kva.example/?q=1"), ("http://h.example:8080/a&amp;b?gclid=1", "http://h.example:8080/a&b"), ("mailto:x", None), ("https://u@h.example/", None), ("http://h.example/a b", None), (None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "u string, w string").select(tx.canonical_url(F.col("u"))).collect()]
    assert got == [w for _, w in rows]


def test_slot_is_usable_from_its_end(spark):
    at = dt.datetime(2024, 3, 4, 9, 5)
    df = spark.createDataFrame([("A", at, 1, 5.0), ("A", at.replace(minute=30), 2, 7.0)], "code string, ts timestamp_ntz, event_id long, value double")
    (r,) = br.aggregate_slots(df, br.SLOT_EDGES["1h"]).collect()
    assert (r["bar_start"].hour, r["available_at"].hour, r["available_at"].minute, r["value"]) == (9, 10, 0, 12.0)


def test_streamed_slots_leave_when_their_end_is_past(spark, tmp_path):
    """Three files, one a batch: the last slot is unequal and stays open, a row
    that comes after its bar has left changes nothing."""
    at = lambda h, m=0: dt.datetime(2024, 3, 4, h, m)
    files = [[(1, at(9, 5), 2.0), (2, at(11, 59), 3.0), (3, at(8, 59), 9.0)], [(4, at(12), 5.0), (5, at(15, 30), 6.0)], [(6, at(9, 6), 100.0), (7, at(13), 1.0)]]
    done = []
    for rows in files:
        frame = spark.createDataFrame([("A", *r) for r in rows], "code string, event_id long, ts timestamp_ntz, value double")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
        slots = ss.finished_slots(stream, br.SLOT_EDGES["3h"])
        run = slots.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        run.awaitTermination()
        out = spark.read.schema(slots.schema).parquet(str(tmp_path / "out")).collect()
        done.append([(r["slot"], r["open"], r["close"], r["value"], r["rows"], r["available_at"].hour, r["bar_minutes"]) for r in out])
    first = (1, 2.0, 3.0, 5.0, 2, 12, 180)
    assert done == [[], [first], [first]]


def test_boundary_midnight_belongs_to_the_earlier_part(spark):
    day = dt.datetime(2024, 3, 4)
    rows = [(day, day + dt.timedelta(1)), (day, day + dt.timedelta(1, 1)), (day + dt.timedelta(1), day + dt.timedelta(1, 5)), (day, None)]
    df = spark.createDataFrame(rows, "date timestamp_ntz, realized_at timestamp_ntz")
    end = lambda k: F.lit(day.date() + dt.timedelta(k))
    assert [r["split"] for r in fc.time_split(df, end(0), end(3)).collect()] == ["train", "purged", "valid", "purged"]


def test_pattern_limits():
    assert pat.parameters("ma_cross", limited=True, fast=3)["fast"] == 3
    for bad in ({"fast": 90}, {"fast": 2.5}):
        with pytest.raises(ValueError):
            pat.parameters("ma_cross", limited=True, **bad)


def test_search_space(spark):
    r = sr.Request(("b", "a", "c"), max_hold=(3, 5))
    grid = sr.Grid(r)
    ways = list(dict.fromkeys((x.patterns, x.combine) for x in grid))
    assert ways[:3] == [(("a",), "or"), (("b",), "or"), (("c",), "or")] and ways[3:5] == [(("a", "b"), "and"), (("a", "b"), "or")] and len(ways) == 11
    assert len(grid) == len({x.id for x in grid}) == 22 and grid[0].id == "c001" and [x.rule.max_hold for x in grid][:3] == [3, 5, 3]
    wide = sr.Request(("b", "a"), params={"b": {"k": (1, 2), "j": (7, 8)}, "a": {"z": (0.5,)}}, max_hold=(3,), stop_loss=(None, -0.1))
    assert len({(x.patterns, x.combine, x.params, x.rule) for x in sr.Grid(wide)}) == len(sr.Grid(wide)) == 1 * 2 + 4 * 2 + 2 * 4 * 2
    assert [dict(dict(x.params)["b"]) for x in sr.Grid(wide) if x.patterns == ("b",)][:3] == [{"j": 7, "k": 1}, {"j": 7, "k": 1}, {"j": 7, "k": 2}]
    costs = spark.createDataFrame([(40, 30), (2, 3095)], "n int, keys int").select(sr.Cost().seconds(F.col("n"), F.col("keys"))).collect()
    assert [x[0] for x in costs] == [4.0, 5.0]
    for bad in ({"patterns": ()}, {"combine": ("xor",)}, {"patterns": tuple("abcdefgh")}):
        with pytest.raises(ValueError):
            sr.Request(**({"patterns": ("a",)} | bad))


def test_group_similar_follows_leaders(spark):
    rows = [(1, 1, 10, ["a", "b"]), (1, 2, 11, ["a", "b", "c"]), (1, 3, 12, ["x"]), (1, 4, 13, ["x"])]
    df = spark.createDataFrame(rows, "query_id long, rank int, doc_id long, tokens array<string>")
    got = {r["doc_id"]: r["leader"] for r in dc.group_similar(df, 0.5).collect()}
    assert got == {10: 10, 11: 10, 12: 12, 13: 12}


def test_retrieval_metrics(spark):
    ranked = spark.createDataFrame([(1, d, k + 1) for k, d in enumerate("abcd")], "query_id long, doc_id string, rank int")
    gold = spark.createDataFrame([(1, "b", 1), (1, "z", 1)], "query_id long, doc_id string, grade int")
    r = dc.retrieval_metrics(ranked, gold, 2).first()
    assert (r["recall"], r["rr"]) == (0.5, 0.5)


def test_deleted_newest_version_shows_the_older(spark):
    at = dt.datetime(2024, 1, 1)
    docs = spark.createDataFrame([(1, 1, at, at), (1, 2, at + dt.timedelta(5), at + dt.timedelta(5))], "doc_id long, version long, available_at timestamp_ntz, first_seen_at timestamp_ntz")
    assert dc.visible_at(docs, F.lit(at + dt.timedelta(1))).first()["version"] == 1
    with pytest.raises(ValueError):
        dc.visible_at(docs, F.lit(at), "other")


def test_the_first_reason_of_exclusion_counts(spark):
    """Rows fail one test after the other; what is unknown counts as said."""
    day = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(k)
    good = ("common", "M0", "main", False)
    rows = [("a", day(k), 10.0, *good) for k in range(4)]
    rows += [("w", day(0), 0.0, "fund", "X", "bad", True), ("k", day(0), 0.0, "fund", "X", "bad", False), ("k", day(1), 0.0, None, "M0", None, None)]
    rows += [("m", day(0), 0.0, "common", None, "bad", None), ("l", day(0), 0.0, "common", "M0", "bad", None), ("d", day(0), 9.0, *good), ("d", day(1), 9.0, "common", "M0", "bad", False), ("d", day(2), 9.0, "common", "M0", None, False)]
    df = spark.createDataFrame(rows, "ticker string, date timestamp, value double, kind string, market string, dept string, is_warmup boolean")
    rules = uni.Rules(2, 5.0, "common", ("M0", "M1"), ("bad",), window=2)
    got = {(r["ticker"], r["date"]): r["exclude_reason"] for r in uni.with_universe(df, rules).collect()}
    assert [got["a", day(k)] for k in range(4)] == ["listed_lt_250", None, None, None]
    assert (got["w", day(0)], got["k", day(0)], got["k", day(1)], got["m", day(0)], got["l", day(0)]) == ("warmup", "not_common_stock", "not_common_stock", "market", "listed_lt_250")
    assert (got["d", day(1)], got["d", day(2)]) == ("managed_or_warning", None)
    poor = uni.with_universe(df, uni.Rules(1, 9.5, "common", ("M0",), window=2)).where("ticker in ('a', 'd')").collect()
    assert {r["exclude_reason"] for r in poor if r["ticker"] == "d"} == {"low_liquidity"} and {r["exclude_reason"] for r in poor if r["ticker"] == "a"} == {"low_liquidity", None}


def test_random_entries_keep_off_warm_up_and_beyond_the_period(spark):
    """Opens outside the allowed rows are wild: one draw of them would show."""
    day = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(k)
    bars = [("a", day(k), 100.0 if 5 <= k <= 12 else 1e9 * (k + 1), k < 3) for k in range(20)]
    b = spark.createDataFrame(bars, "ticker string, date timestamp_ntz, open double, is_warmup boolean")
    index = b.select(F.lit("M").alias("market"), "date", F.lit(1.0).alias("index_open"))
    trades = spark.createDataFrame([("s", "a", 1, 4, 0.5, False), ("s", "a", 2, 30, 0.1, False)], "strategy string, ticker string, t int, x int, excess_ret double, excluded boolean")
    run = lambda start, end: an.random_benchmark(trades, b, index, F.lit("M"), 50, 0.0, an.Period(start, end)).first()
    r = run("2024-01-06 00:00:00", "2024-01-11 00:00:00")
    assert (r["n"], r["random_mean"], r["percentile"]) == (1, 0.0, 1.0)
    assert run("2024-01-03 00:00:00", "2024-01-03 00:00:00") is None  # warm-up only
    assert abs(run(None, None)["random_mean"]) > 1


def test_entry_at_zero_is_an_endless_gain(spark):
    """As plain division has it; strategies and their statistics count such a trade."""
    close = np.array([100.0, 0.0, 100.0, np.nan, 90.0])
    t, under = np.array([0, 1]), np.zeros(5, bool)
    with np.errstate(all="ignore"):
        for rule in (bt.ExitRule(3, -0.5, 0.5), bt.ExitRule(3, -0.5, trailing=-0.1), bt.ExitRule(3, -0.5, breakeven=0.0)):
            row, reason = bt.first_hits(rule, close, under, t, np.zeros(2))
            assert [(int(a), str(b)) for a, b in zip(row, reason)] == [slow_hit(rule, close, under, k, np.float64(0)) for k in t]
    df = spark.createDataFrame([("a", 0.0, 5.0), ("b", 0.0, 0.0), ("c", 4.0, 5.0), ("d", None, 5.0)], "k string, entry double, exit double")
    got = {r["k"]: r["r"] for r in df.select("k", stats.ratio(F.col("exit"), F.col("entry")).alias("r")).collect()}
    assert got["a"] == float("inf") and np.isnan(got["b"]) and got["c"] == 1.25 and got["d"] is None
    trades = spark.createDataFrame([("s", float("inf"), False), ("s", 0.5, False)], "strategy string, excess_ret double, excluded boolean")
    (t,) = an.t_statistics(trades).collect()
    assert t["n"] == 2 and np.isnan(t["t"])
