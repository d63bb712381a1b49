"""Indicators over bar panels (``bar_idx`` numbers the bars of a series from 0).  Undefined values are null."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import Series, affine, number

RSI_PERIOD = 14
#: Bars of a look-back window up to which each bar carries the window as an array.
SHORT_WINDOW = 256
#: Bars of a block in longer windows, at least.
BLOCK_BARS = 8192
BULL, BEAR, UNKNOWN = "BULL", "BEAR", "UNKNOWN"


def index_bars(df: DataFrame, series: Series) -> DataFrame:
    """Add bar number, series length, previous close and next open."""
    return number(df, series, lag={"prev_close": F.col("close")}, lead={"next_open": F.col("open")})


def sma(df: DataFrame, series: Series, length: int, name: str = "ma", x: str = "close") -> DataFrame:
    """Mean of the last ``length`` bars, defined from bar ``length - 1``."""
    return series.rolling(
        df,
        length,
        "bar_idx",
        lambda w: {name: F.when(F.col("bar_idx") >= length - 1, F.avg(x).over(w.rowsBetween(-(length - 1), 0)))},
    )


def ema(
    df: DataFrame, series: Series, lengths: Sequence[int], name: str = "ema", axis: str = "ema_len", x: str = "close"
) -> tuple[DataFrame, Series]:
    """Exponential average for each length: one row per bar and length."""
    long = df.withColumn(axis, F.explode(F.array(*[F.lit(v) for v in lengths])))
    series = series.with_keys(axis)
    return affine(long, series, {name: x}, f"(2.0D / ({axis} + 1.0D))", axis, "bar_idx"), series


def true_range() -> Column:
    """Largest of high-low and the two distances to the previous close; the first bar has high-low only."""
    high, low, before = F.col("high"), F.col("low"), F.col("prev_close")
    return F.when(F.col("bar_idx") == 0, high - low).otherwise(
        F.greatest(high - low, F.abs(high - before), F.abs(low - before))
    )


def atr(df: DataFrame, series: Series, period: int, name: str = "atr") -> DataFrame:
    """Wilder average of the true range."""
    df = df.withColumn("_tr", true_range())
    return affine(df, series, {name: "_tr"}, f"(1.0D / {period})", str(period), "bar_idx").drop("_tr")


def rsi(df: DataFrame, series: Series, period: int = RSI_PERIOD, name: str = "rsi") -> DataFrame:
    """Wilder RSI, first defined at bar ``period``; undefined while the average loss is zero."""
    moves = {"_gain": "greatest(close - prev_close, 0.0D)", "_loss": "greatest(prev_close - close, 0.0D)"}
    df = affine(df, series, moves, f"(1.0D / {period})", str(period), "(bar_idx - 1)")
    value = 100.0 - 100.0 / (1.0 + F.col("_gain") / F.col("_loss"))
    return df.withColumn(name, F.when(F.col("_loss") != 0, value)).drop("_gain", "_loss")


def rising(df: DataFrame, series: Series, days: int, x: str = "ma", name: str = "slope_ok") -> DataFrame:
    """Whether the value lies above its value ``days`` bars earlier; false when either is undefined."""
    return series.rolling(
        df,
        days + 1,
        "bar_idx",
        lambda w: {name: F.coalesce(F.col(x) > F.lag(x, days).over(w), F.lit(False))},
    )


def price_ratio(x: str = "atr") -> Column:
    """Volatility proxy: average range as a share of the close."""
    return F.when(F.col("close") > 0, F.col(x) / F.col("close"))


def rank_in_window(window: Column, current: Column, at: Column, lookback: Column | int) -> Column:
    """Share of the window's last ``lookback`` defined values at or below ``current``."""
    if isinstance(lookback, int):
        lookback = F.lit(lookback)
    recent = F.filter(window, lambda e: e["i"] > at - lookback)
    below = F.size(F.filter(recent, lambda e: e["r"] <= current))
    return F.when(current.isNotNull(), below / F.size(recent))


def rolling_ranks(df: DataFrame, series: Series, names: dict[str, int], ratio: str = "ratio") -> DataFrame:
    """Percentile ranks of the ratio among the defined ratios of the last bars: ``names`` gives the lookback of each.

    One window, as long as the longest lookback, serves all of them: up to ``SHORT_WINDOW`` bars as an array on each
    bar, beyond that by counting in blocks, where the work per bar grows with the logarithm of the lookback.
    """
    longest = max(names.values())
    if longest > SHORT_WINDOW:
        return _ranks_in_blocks(df, series, names, ratio)

    def build(w):
        seen = F.collect_list(
            F.when(F.col(ratio).isNotNull(), F.struct(F.col("bar_idx").alias("i"), F.col(ratio).alias("r")))
        ).over(w.rowsBetween(-(longest - 1), 0))
        return {"_seen": seen}

    df = series.rolling(df, longest, "bar_idx", build)
    ranks = {n: rank_in_window(F.col("_seen"), F.col(ratio), F.col("bar_idx"), back) for n, back in names.items()}
    return df.withColumns(ranks).drop("_seen")


def counts_at_most(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each place ``i``, how many of ``values[start[i]:i + 1]`` are at most ``values[i]``.

    The values are replaced by their ranks and sorted bit by bit from the highest (a wavelet matrix): at each bit, the
    part of the window with a smaller prefix is counted and the window goes on to the part with the same prefix.
    """
    distinct, rank = np.unique(values, return_inverse=True)
    lo, hi = start.astype(np.int64), np.arange(1, len(values) + 1)
    count, bound = np.zeros(len(values), np.int64), rank + 1
    for bit in reversed(range(len(distinct).bit_length())):
        high = (rank >> bit) & 1 == 1
        zeros = np.concatenate([[0], np.cumsum(~high)])
        lo0, hi0, above = zeros[lo], zeros[hi], (bound >> bit) & 1 == 1
        count += np.where(above, hi0 - lo0, 0)
        lo, hi = (np.where(above, zeros[-1] + x - x0, x0) for x, x0 in ((lo, lo0), (hi, hi0)))
        rank = np.concatenate([rank[~high], rank[high]])
    return count


def _block_ranks(lookback: int) -> Callable[[Column, Column, Column], Column]:
    """Ranks of one block: from arrays of bar numbers, ratios, and whether these are defined, to an array of ranks."""

    @F.pandas_udf("array<double>")
    def ranks(at: pd.Series, ratio: pd.Series, defined: pd.Series) -> pd.Series:
        out = []
        for i, r, d in zip(at, ratio, defined, strict=True):
            known = np.flatnonzero(np.asarray(d, bool))
            i, r = np.asarray(i, np.int64)[known], np.asarray(r, np.float64)[known]
            start = np.searchsorted(i, i - lookback, side="right")
            rank = np.full(len(d), None, object)
            rank[known] = counts_at_most(r, start) / (np.arange(1, len(known) + 1) - start)
            out.append(rank)
        return pd.Series(out)

    return ranks


def _ranks_in_blocks(df: DataFrame, series: Series, names: dict[str, int], ratio: str) -> DataFrame:
    """Blocks of bars, each with the bars it looks back at (number and ratio only); the rows themselves stay in the JVM."""
    longest = max(names.values())
    size = max(BLOCK_BARS, longest)
    block, late = F.floor(F.col("bar_idx") / size), F.col("bar_idx") % size >= size - (longest - 1)
    copies = F.when(late, F.array(block, block + 1)).otherwise(F.array(block))
    spread = df.select(*series.keys, F.explode(copies).alias("_blk"), F.struct(*df.columns).alias("_row"))
    own = F.floor(F.col("_row.bar_idx") / size) == F.col("_blk")
    bar = F.struct(
        F.col("_row.bar_idx").alias("i"), F.col(f"_row.{ratio}").alias("r"), F.when(own, F.col("_row")).alias("row")
    )
    blocks = spread.groupBy(*series.keys, "_blk").agg(F.array_sort(F.collect_list(bar)).alias("_g"))
    bars = [F.transform("_g", f) for f in (lambda e: e["i"], lambda e: e["r"], lambda e: e["r"].isNotNull())]
    blocks = blocks.withColumns({f"_k{k}": _block_ranks(back)(*bars) for k, back in enumerate(names.values())})
    cell = lambda e, i: F.struct(e["row"].alias("row"), *[F.get(f"_k{k}", i).alias(n) for k, n in enumerate(names)])
    out = blocks.select(F.inline(F.transform("_g", cell))).where(F.col("row").isNotNull())
    return series.settle(out.select("row.*", *names))


def rolling_rank(
    df: DataFrame, series: Series, lookback: int, ratio: str = "ratio", name: str = "vol_rank"
) -> DataFrame:
    """Percentile rank of the ratio among the defined ratios of the last ``lookback`` bars."""
    return rolling_ranks(df, series, {name: lookback}, ratio)


def is_high(rank: Column, threshold: Column | float) -> Column:
    """High-volatility flag; false where the rank is undefined."""
    return F.coalesce(rank >= threshold, F.lit(False))


def bands(band: Column | float, anchor: str = "ema") -> dict[str, Column]:
    """Upper and lower limits around the anchor."""
    return {"upper": F.col(anchor) * (1.0 + band), "lower": F.col(anchor) * (1.0 - band)}


def regime(df: DataFrame, series: Series, band: Column | float, anchor: str = "ema") -> DataFrame:
    """Regime with hysteresis and the regime of the bar before.

    Outside the bands the bar decides; inside, the last decision holds; before any decision the side of the
    anchor counts, and a bar exactly on it stays UNKNOWN.
    """
    lim = bands(band, anchor)
    close = F.col("close")
    hard = F.when(close > lim["upper"], BULL).when(close < lim["lower"], BEAR)
    soft = F.when(close > F.col(anchor), BULL).when(close < F.col(anchor), BEAR)
    now = {"_hard": ("last", hard), "_soft": ("first", soft)}
    before = {"_hard0": now["_hard"], "_soft0": now["_soft"], "_has": ("max", F.lit(True))}
    df = series.sweep(df, running=now, before=before)
    decided = lambda h, s: F.coalesce(h, s, F.lit(UNKNOWN))
    df = df.withColumns({"regime": decided("_hard", "_soft"), "prev_regime": F.when(F.col("_has"), decided("_hard0", "_soft0"))})
    return df.drop(*now, *before)


def buy_turn() -> Column:
    """Bear to bull between the previous bar and this one."""
    return F.coalesce((F.col("prev_regime") == BEAR) & (F.col("regime") == BULL), F.lit(False))


def bear_turn() -> Column:
    """Bull to bear between the previous bar and this one."""
    return F.coalesce((F.col("prev_regime") == BULL) & (F.col("regime") == BEAR), F.lit(False))


def weekly_filter(
    bars: DataFrame, series: Series, lengths: Sequence[int], lagged: bool = False
) -> DataFrame:
    """Weekly close against its weekly average, as an array of flags (one per length) on every bar of the week.

    The flag of a week uses its last close, so earlier days of the week see it too; ``lagged`` takes the week
    before instead.
    """
    week = {"iso_year": F.extract(F.lit("YEAROFWEEK"), F.col("ts")), "iso_week": F.extract(F.lit("WEEK"), F.col("ts"))}
    keys = list(series.keys)
    days = bars.withColumns(week)
    weekly = weekly_panel(days, keys)
    ordered = Series(series.keys, ("iso_year", "iso_week"))
    weekly = number(weekly, ordered, n=None)
    long, by_len = ema(weekly, ordered, lengths, name="weekly_ema", axis="weekly_len", x="weekly_close")
    bull = F.coalesce(F.col("weekly_close") >= F.col("weekly_ema"), F.lit(False))
    long = long.withColumn("weekly_bullish", bull)
    if lagged:
        long = by_len.shift(long, weekly_bullish=F.col("weekly_bullish")).fillna(False, ["weekly_bullish"])
    order = {v: i for i, v in enumerate(lengths)}
    place = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("weekly_len")]
    flags = long.groupBy(*keys, "iso_year", "iso_week").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(place.alias("o"), "weekly_bullish", "weekly_ema"))),
            lambda e: F.struct(e["weekly_bullish"].alias("bullish"), e["weekly_ema"].alias("ema")),
        ).alias("weekly"),
        F.first("weekly_close").alias("weekly_close"),
    )
    return days.join(flags, [*keys, "iso_year", "iso_week"])


def weekly_panel(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last close of each ISO week."""
    return days.groupBy(*keys, "iso_year", "iso_week").agg(F.max_by("close", "ts").alias("weekly_close"))

