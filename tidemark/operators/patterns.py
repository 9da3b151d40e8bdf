"""Registry of boolean signal patterns.

A pattern is a pair of column dictionaries: ``parts`` are window expressions
over the bars, ``rule`` combines them and their lags. Missing values make a
rule false, and a row without volume never signals.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import indicators as ind
from tidemark.operators.windows import full, lag, rolling_mean, truth

c = F.col


@dataclass(frozen=True)
class Pattern:
    parts: Callable[[dict], dict[str, Column]]
    rule: Callable[[dict], Column]
    params: dict = field(default_factory=dict)
    #: Parts that need the results of the first ones.
    later: Callable[[dict], dict[str, Column]] = lambda p: {}
    check: Callable[[dict], bool] = lambda p: True


def _crossed(a: str, b: str) -> Column:
    return (lag(c(a)) <= lag(c(b))) & (c(a) > c(b))


def _three_down(p: dict) -> Column:
    n = p["down"]
    falls = [lag(c("_c"), k) < lag(c("_c"), k + 1) for k in range(1, n + 1)]
    traded = [lag(c("volume"), k) > 0 for k in range(1, n + 2)]
    return reduce(lambda a, b: a & b, [c("_c") > c("_o"), c("_c") > lag(c("_c")), *falls, *traded])


def _prices(p: dict) -> dict[str, Column]:
    return {"_c": ind.positive(c("close")), "_o": ind.positive(c("open")), "_l": ind.positive(c("low"))}


PATTERNS: dict[str, Pattern] = {
    "ma_cross": Pattern(lambda p: {"_f": ind.sma(p["fast"]), "_s": ind.sma(p["slow"])}, lambda p: _crossed("_f", "_s"), {"fast": 5, "slow": 20}, check=lambda p: p["fast"] < p["slow"]),
    "breakout": Pattern(lambda p: {"_h": ind.previous_max(p["n"])}, lambda p: c("close") > c("_h"), {"n": 20}),
    "breakout_vol": Pattern(
        lambda p: {"_h": ind.previous_max(p["n"]), "_v": ind.previous_mean(p["n"])},
        lambda p: (c("close") > c("_h")) & (c("volume") >= p["mult"] * c("_v")) & (c("_v") > 0),
        {"n": 20, "mult": 2.0},
    ),
    "rsi_rebound": Pattern(lambda p: {"_r": ind.rsi(p["n"])}, lambda p: (lag(c("_r")) < p["level"]) & (c("_r") >= p["level"]), {"n": 14, "level": 30.0}),
    "bb_lower_recover": Pattern(lambda p: {"_b": ind.bollinger(p["n"], p["k"])}, lambda p: (lag(c("close")) < lag(c("_b"))) & (c("close") >= c("_b")), {"n": 20, "k": 2.0}),
    "three_down_up": Pattern(_prices, _three_down, {"down": 3}),
    "bb_squeeze_break": Pattern(
        lambda p: {"_c": ind.positive(c("close")), "_m": ind.positive(ind.sma(20)), "_b": ind.bollinger(20, p["k"])},
        lambda p: (lag(c("_w")) <= lag(full(F.min, c("_w"), p["n"]))) & (lag(c("_c")) <= lag(2 * c("_m") - c("_b"))) & (c("_c") > 2 * c("_m") - c("_b")),
        {"n": 125, "k": 2.0},
        later=lambda p: {"_w": F.round((2 * c("_m") - c("_b") - c("_b")) / c("_m"), 9)},
    ),
    "pullback_ma": Pattern(
        lambda p: _prices(p) | {"_m": ind.positive(ind.sma(20))},
        lambda p: (lag(c("_c")) > lag(c("_m"))) & (c("_m") > lag(c("_m"))) & (c("_l") >= c("_m") * (1 - p["below"])) & (c("_l") <= c("_m") * (1 + p["above"])) & (c("_c") > c("_m")) & (c("_c") > c("_o")),
        {"above": 0.01, "below": 0.02},
    ),
    "granville_buy1": Pattern(
        lambda p: {"_c": ind.positive(c("close")), "_m": ind.positive(ind.sma(p["ma"]))},
        lambda p: (lag(c("_d")) <= 0) & (c("_d") > 0) & (lag(c("_c")) <= lag(c("_m"))) & (c("_c") > c("_m")),
        {"ma": 200, "slope": 5},
        later=lambda p: {"_d": c("_m") - lag(c("_m"), p["slope"])},
    ),
    "engulfing": Pattern(
        _prices,
        lambda p: (lag(c("_o")) > lag(c("_c")))
        & (c("_c") > c("_o"))
        & (c("_o") <= lag(c("_c")))
        & (c("_c") >= lag(c("_o")))
        & ((c("_o") < lag(c("_c"))) | (c("_c") > lag(c("_o"))))
        & (c("_c") - c("_o") >= p["body"] * (lag(c("_o")) - lag(c("_c"))))
        & (lag(c("_c")) < lag(c("_c"), 1 + p["trend"])),
        {"body": 1.0, "trend": 3},
    ),
    "high_52w": Pattern(
        lambda p: {"_c": ind.positive(c("close")), "_h": ind.previous_max(p["n"])},
        lambda p: (c("_c") > c("_h")) & (lag(c("_c")) <= lag(c("_h"))),
        {"n": 250},
    ),
    "disparity_rebound": Pattern(
        lambda p: {"_d": ind.positive(c("close")) / ind.positive(ind.sma(p["n"])) * 100},
        lambda p: (lag(c("_d")) < p["level"]) & (c("_d") >= p["level"]),
        {"n": 20, "level": 90.0},
    ),
    "stochastic_rebound": Pattern(
        lambda p: {"_k": F.round(ind.stochastic(p["k"]), 6)},
        lambda p: (lag(c("_k")) <= lag(c("_d"))) & (c("_k") > c("_d")) & (lag(c("_k")) < p["oversold"]),
        {"k": 14, "d": 3, "oversold": 20.0},
        later=lambda p: {"_d": rolling_mean(c("_k"), p["d"])},
    ),
}


#: The least and the greatest value that a parameter may take.
LIMITS = {
    "ma_cross": {"fast": (2, 60), "slow": (5, 250)},
    "breakout": {"n": (5, 250)},
    "breakout_vol": {"mult": (1.0, 5.0), "n": (5, 250)},
    "rsi_rebound": {"level": (10, 50), "n": (5, 50)},
    "bb_lower_recover": {"n": (5, 60), "k": (1.0, 4.0)},
    "three_down_up": {"down": (2, 5)},
    "bb_squeeze_break": {"n": (20, 200)},
    "pullback_ma": {"above": (0, 0.05), "below": (0, 0.05)},
    "granville_buy1": {"slope": (1, 20)},
    "engulfing": {"body": (1, 3), "trend": (1, 20)},
    "high_52w": {"n": (60, 250)},
    "disparity_rebound": {"n": (5, 120), "level": (70, 98)},
    "stochastic_rebound": {"k": (5, 50), "d": (2, 10), "oversold": (5, 40)},
}


def parameters(name: str, limited: bool = False, **override) -> dict:
    """Parameters of a pattern; unknown names and impossible pairs are refused,
    with ``limited`` also values outside what a user may set."""
    pattern = PATTERNS[name]
    if unknown := set(override) - set(pattern.params):
        raise ValueError(f"{name} has no parameter {sorted(unknown)}")
    for k, v in override.items() if limited else ():
        least, most = LIMITS[name].get(k, (v, v))
        if not least <= v <= most or isinstance(pattern.params[k], int) and not isinstance(v, int):
            raise ValueError(f"{name}.{k} is not within {least} to {most}")
    merged = pattern.params | override
    if not pattern.check(merged):
        raise ValueError(f"{name}: impossible parameters {merged}")
    return merged


def with_signal(bars: DataFrame, name: str, out: str = "signal", **override) -> DataFrame:
    """The bars with one more boolean column."""
    p, pattern = parameters(name, **override), PATTERNS[name]
    df = bars.withColumns(pattern.parts(p))
    if later := pattern.later(p):
        df = df.withColumns(later)
    return df.withColumn(out, truth(pattern.rule(p)) & truth(c("volume") > 0)).select(*bars.columns, out)


def macd_signal(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, out: str = "signal") -> DataFrame:
    """MACD crosses above its own mean; its fast and slow mean in one pass."""
    if fast >= slow:
        raise ValueError("fast must be shorter than slow")
    df = bars.withColumn("_c", ind.positive(c("close")))
    df = ind.with_emas(df, {"_fast": ("_c", 2 / (fast + 1), fast), "_slow": ("_c", 2 / (slow + 1), slow)})
    df = ind.with_ema(df.withColumn("_macd", F.round(c("_fast") - c("_slow"), 8)), "_signal", "_macd", 2 / (signal + 1), signal)
    return df.withColumn(out, truth(_crossed("_macd", "_signal")) & (c("volume") > 0)).select(*bars.columns, out)


def combine(bars: DataFrame, names: list[str], how: str = "and", out: str = "signal") -> DataFrame:
    """All or any of several patterns over the same bars."""
    df = bars
    for k, name in enumerate(names):
        df = with_signal(df, name, f"_sig{k}")
    columns = [c(f"_sig{k}") for k in range(len(names))]
    merged = reduce((lambda a, b: a & b) if how == "and" else (lambda a, b: a | b), columns)
    return df.select(*bars.columns, merged.alias(out))
