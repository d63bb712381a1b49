"""Experiments: train/test slices, grid search, hold-out and walk-forward validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import equity as eq
from tidemark.operators.indicators import index_bars
from tidemark.operators.positions import open_return
from tidemark.operators.scan import Series, lay_out
from tidemark.plans.episodes import episode_scores
from tidemark.plans.grid import Grid
from tidemark.plans.strategies import Run, Strategy, backtest
from tidemark.session import materialize

MIN_SEGMENT = 50
MIN_TRAIN = 300
MIN_TEST = 30


def panel(candles: DataFrame, rows_per_task: int | None = None) -> tuple[DataFrame, Series]:
    """Numbered bars of all markets, stored once: the raw table is read and aggregated a single time."""
    bars, series = lay_out(materialize(candles), ["market"], ["ts"], rows_per_task)
    return index_bars(bars, series), series.with_order("bar_idx")


def split_index(n: Column, ratio: float) -> Column:
    """First test bar of a hold-out split: floor(n * ratio), at least 2 bars on both sides."""
    return F.least(n - 2, F.greatest(F.lit(2), F.floor(n * ratio)))


def _segment(name: str | Column, start: Column, end: Column) -> Column:
    label = F.lit(name) if isinstance(name, str) else name
    return F.struct(label.alias("segment"), start.cast("bigint").alias("lo"), end.cast("bigint").alias("hi"))


def holdout_segments(ratio: float = 0.7) -> Column:
    """Validation, test and full segments of a market; none below four bars."""
    n, zero = F.col("n_bars"), F.lit(0)
    cut = split_index(n, ratio)
    parts = F.array(_segment("validation", zero, cut), _segment("test", cut, n), _segment("full", zero, n))
    return F.when(n >= 4, parts).otherwise(F.slice(parts, 1, 0))


def walkforward_segments(splits: int = 3, min_train: int = MIN_TRAIN, min_test: int = MIN_TEST) -> Column:
    """Growing train segments and the test segment after each; splits that are too short are left out."""
    n = F.col("n_bars")
    size = F.greatest(F.lit(MIN_SEGMENT), F.floor(n / (splits + 1)))
    parts = []
    for i in range(1, splits + 1):
        edge, stop = size * i, F.least(n, size * (i + 1))
        fits = (edge >= min_train) & (stop - edge >= min_test)
        for name, lo, hi in (("train", F.lit(0), edge), ("test", edge, stop)):
            parts.append(F.when(fits, _segment(f"{name}_{i}", lo, hi)))
    return F.filter(F.array(*parts), lambda e: e.isNotNull())


def slice_segments(bars: DataFrame, series: Series, segments: Column) -> tuple[DataFrame, Series]:
    """Copy each bar to the segments it lies in and restart numbering, so indicators warm up anew in each."""
    at = F.col("bar_idx")
    inside = F.filter(segments, lambda e: (at >= e["lo"]) & (at < e["hi"]))
    df = bars.withColumn("_s", F.explode(inside))
    first, last = at == F.col("_s.lo"), at == F.col("_s.hi") - 1
    df = df.withColumns(
        {
            "segment": F.col("_s.segment"),
            "n_bars": F.col("_s.hi") - F.col("_s.lo"),
            "prev_close": F.when(~first, F.col("prev_close")),
            "next_open": F.when(~last, F.col("next_open")),
            "bar_idx": at - F.col("_s.lo"),
        }
    ).drop("_s")
    series = series.with_keys("segment")
    return with_returns(df, series)


def with_returns(df: DataFrame, series: Series) -> tuple[DataFrame, Series]:
    """Add the open-to-open return and the first and last time of the series."""
    df = df.withColumn("ret_oo", open_return())
    return series.whole(df, first_ts=("min", F.col("ts")), last_ts=("max", F.col("ts"))), series


SCORE = ["param_id", "final_equity", "mdd", "trades", "first_ts", "last_ts"]


def bar_scores(strategy: Strategy, run: Run) -> DataFrame:
    """Scores from the bars of each combination."""
    rows, wide = backtest(strategy, run)
    return rows.groupBy(*wide.keys).agg(
        F.max_by("equity", "bar_idx").alias("final_equity"),
        F.min("drawdown").alias("mdd"),
        eq.trade_count(strategy.rounded_trades).alias("trades"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
    )


def evaluate_grid(strategy: Strategy, bars: DataFrame, series: Series, grid: Grid) -> DataFrame:
    """One row per series and combination: final equity, drawdown, trades, growth, calmar.

    Strategies that hold all or nothing are scored from trade episodes, without sorting bars per combination.
    Combinations whose curve touches the floor are scored from bars. The method is the same at every size.
    """
    keys = list(series.keys)
    run = Run(bars, series, grid, full=False)
    if strategy.prepare is None:
        return eq.with_metrics(bar_scores(strategy, run))
    scores = materialize(episode_scores(strategy.prepare, run))
    floored = scores.where("at_floor")
    if not floored.isEmpty():
        chosen = floored.select(*keys, "param_id").join(grid.small_frame(bars.sparkSession), "param_id")
        exact = bar_scores(strategy, Run(bars, series, grid, chosen, full=False))
        cols = [*keys, *SCORE]
        scores = scores.where("NOT at_floor").select(*cols).unionByName(exact.select(*cols))
    return eq.with_metrics(scores.drop("at_floor"))


def rank_value(x: Column) -> Column:
    """Undefined and infinite values rank below all numbers."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(float("-inf"))).otherwise(x)


def top_k(scores: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Best ``k`` combinations by calmar, growth, final equity; ties keep grid order."""
    best = [rank_value(F.col(c)).desc() for c in ("calmar", "cagr", "final_equity")]
    over = Window.partitionBy(*keys).orderBy(*best, F.col("param_id").asc())
    return scores.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)


def best_rows(scores: DataFrame, keys: list[str], grid: Grid) -> DataFrame:
    """The best combination of each key with its parameter values, stored so that it is computed once."""
    best = top_k(scores, keys, 1).select(*keys, "param_id")
    return materialize(best.join(grid.small_frame(scores.sparkSession), "param_id"))


def search(strategy: Strategy, candles: DataFrame, grid: Grid, k: int = 10) -> DataFrame:
    """Grid search over the whole history of each market."""
    bars, series = panel(candles)
    bars, series = with_returns(bars, series)
    scores = top_k(evaluate_grid(strategy, bars, series, grid), list(series.keys), k)
    return scores.join(grid.small_frame(candles.sparkSession), "param_id")


def run_summary(strategy: Strategy, bars: DataFrame, series: Series, grid: Grid, chosen: DataFrame | None = None) -> DataFrame:
    """Summary row per series and combination (or chosen combination), with the buy-and-hold curve."""
    rows, wide = backtest(strategy, Run(bars, series, grid, chosen))
    return eq.summarize(rows, list(wide.keys), strategy.rounded_trades)


def holdout(
    strategy: Strategy, candles: DataFrame, grid: Grid, ratio: float = 0.7, min_bars: int = 4
) -> DataFrame:
    """Pick the best combination on the validation part; summaries on validation, test and full.

    The moving-average rule reports validation and test only.
    """
    bars, series = panel(candles)
    seg, s = slice_segments(bars.where(F.col("n_bars") >= min_bars), series, holdout_segments(ratio))
    seg = materialize(seg)
    scores = evaluate_grid(strategy, seg.where(F.col("segment") == "validation"), s, grid)
    best = best_rows(scores.drop("segment"), ["market"], grid)
    names = ["validation", "test"] if strategy.version == "v1" else ["validation", "test", "full"]
    chosen = best.withColumn("segment", F.explode(F.array(*[F.lit(x) for x in names])))
    return run_summary(strategy, seg.where(F.col("segment").isin(names)), s, grid, chosen)


def refused_markets(candles: DataFrame, min_bars: int = 4) -> DataFrame:
    """Markets that ``holdout`` leaves out, with their bars and the reason."""
    sizes = candles.groupBy("market").agg(F.count(F.lit(1)).alias("n_bars"))
    reason = F.format_string(f"needs {min_bars} bars, has %d", "n_bars")
    return sizes.where(F.col("n_bars") < min_bars).withColumn("reason", reason)


def walkforward(
    strategy: Strategy,
    candles: DataFrame,
    grid: Grid,
    splits: int = 3,
    min_train: int = MIN_TRAIN,
    min_test: int = MIN_TEST,
) -> DataFrame:
    """For each split: best combination on the train part, summary on the test part after it."""
    bars, series = panel(candles)
    seg, s = slice_segments(bars, series, walkforward_segments(splits, min_train, min_test))
    seg = materialize(seg)
    scores = evaluate_grid(strategy, seg.where(F.col("segment").startswith("train_")), s, grid)
    best = best_rows(scores, ["market", "segment"], grid)
    chosen = best.withColumn("segment", F.replace(F.col("segment"), F.lit("train_"), F.lit("test_")))
    out = run_summary(strategy, seg.where(F.col("segment").startswith("test_")), s, grid, chosen)
    split = F.substring_index("segment", "_", -1).cast("int")
    return out.withColumns({"version": F.lit(strategy.version), "split": split})
