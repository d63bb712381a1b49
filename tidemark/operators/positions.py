"""Positions from signals, as running aggregates over trade episodes.

A position can start only on a bear-to-bull turn, and the next bull-to-bear turn always ends it, so no position
spans two buy turns.  An *episode* is the stretch from one buy turn to the next and is named by the bar number of
its buy turn (``entry``).  As entries only grow, the largest struct (entry, x) seen so far carries the maximum of
x inside the current episode: running maxima need no reset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.indicators import bear_turn, buy_turn
from tidemark.operators.scan import Series

TRADE_EPS = 1e-12


def episodes(df: DataFrame, series: Series, buy: Column | None = None, *tags: str) -> DataFrame:
    """Add ``entry`` (bar number of the latest buy turn) and the columns ``tags`` as they were on that bar."""
    start = buy_turn() if buy is None else buy
    mark = F.when(start, F.struct(F.col("bar_idx").alias("at"), *[F.col(t) for t in tags]))
    df = series.running(df, _mark=("last", mark))
    cols = {"entry": F.col("_mark.at")} | {f"entry_{t}": F.col(f"_mark.{t}") for t in tags}
    return df.withColumns(cols).drop("_mark")


def in_episode() -> Column:
    """After the bar of the buy turn: the position, if any, is held at this bar's open."""
    return F.coalesce(F.col("bar_idx") > F.col("entry"), F.lit(False))


def highest_close(df: DataFrame, series: Series, since: str = "entry", name: str = "highest") -> DataFrame:
    """Highest close of the episode, counted from the first bar held at open."""
    key = F.struct(F.col(since).alias("e"), F.col("close").alias("c"))
    df = series.running(df, _hi=("max", F.when(in_episode() & F.col(since).isNotNull(), key)))
    return df.withColumn(name, F.when(F.col("_hi.e") == F.col(since), F.col("_hi.c"))).drop("_hi")


def bull_stretch(df: DataFrame, series: Series) -> DataFrame:
    """Flag ``may_hold``: no bear turn between the entry and this bar, so a position could be open here."""
    ended = F.when(in_episode(), F.struct(F.col("entry").alias("e"), bear_turn().alias("x")))
    df = series.sweep(df, before={"_end": ("max", ended)})
    over = (F.col("_end.e") == F.col("entry")) & F.col("_end.x")
    return df.withColumn("may_hold", in_episode() & ~F.coalesce(over, F.lit(False))).drop("_end")


def trail_stop(highest: Column, mult: Column, atr: Column) -> Column:
    """Stop price below the highest close; none without range or with a multiplier of zero or less."""
    return F.when(mult > 0, highest - mult * atr)


def hold_until_exit(df: DataFrame, series: Series, exit_: Column, from_entry: bool = False) -> DataFrame:
    """Flag ``held``: the bar opens inside a position, that is no exit happened earlier in the episode.

    ``from_entry`` lets an exit on the bar of the buy turn itself cancel the entry.
    """
    inside = F.coalesce(F.col("bar_idx") >= F.col("entry"), F.lit(False)) if from_entry else in_episode()
    mark = F.when(inside, F.struct(F.col("entry").alias("e"), F.coalesce(exit_, F.lit(False)).alias("x")))
    df = series.sweep(df, before={"_out": ("max", mark)})
    gone = (F.col("_out.e") == F.col("entry")) & F.col("_out.x")
    return df.withColumn("held", in_episode() & ~F.coalesce(gone, F.lit(False))).drop("_out")


def turnover(df: DataFrame, series: Series, exposure: str = "pos_open") -> DataFrame:
    """Change of the exposure at open against the bar before."""
    df = series.shift(df, _before=F.col(exposure))
    return df.withColumn("trade", F.abs(F.col(exposure) - F.coalesce("_before", F.lit(0.0)))).drop("_before")


def open_return() -> Column:
    """Return from this open to the next one; 0 on the last bar."""
    return F.coalesce(F.col("next_open") / F.col("open") - 1.0, F.lit(0.0))


def target_exposure(vol: Column, target: Column, leverage: Column, floor: Column) -> Column:
    """Exposure that aims at a volatility, between floor and leverage; the floor when volatility is unknown."""
    low = F.coalesce(floor, F.lit(0.0))
    return F.when(vol > 0, F.greatest(low, F.least(leverage, target / vol))).otherwise(low)


def trade_markers(df: DataFrame, series: Series) -> DataFrame:
    """Bars whose exposure at open moved: BUY when it rose, SELL when it fell."""
    df = series.shift(df, _before=F.col("pos_open"))
    side = F.when(F.col("pos_open") > F.col("_before"), "BUY").when(F.col("pos_open") < F.col("_before"), "SELL")
    return df.withColumn("marker", side).where(F.col("marker").isNotNull()).drop("_before")
