"""Strategies whose rule is code that goes from bar to bar, beside those that are window plans.

A rule is a function from the values of one combination to a *step*: a callable that gets the next bars of one series as
an Arrow batch, keeps whatever it must remember, and returns the exposure it wants after each bar's close.  The position
at a bar's open is what the step wanted one bar earlier.  ``by_bar`` makes a rule from a function of a single bar.

Bars reach a step in order: Spark sorts each (series, lot of combinations) and hands it over batch by batch, so that a
history is never held whole.  All combinations of a lot share one pass over the bars.  A rule that looks at the last
``memory`` bars only can say so: then a series that is longer than a task's share is cut into blocks, and each block
gets the bars its first results depend on from the block before.  A rule without such a bound runs through each series
in one task, with bounded memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import Series
from tidemark.plans.grid import Axis, Grid
from tidemark.plans.strategies import Evaluator, Run, Strategy
from tidemark.session import share_package, work_partitions
from tidemark.sources.candles import latest

Step = Callable[[pa.RecordBatch], Sequence[float]]
Rule = Callable[[dict], Step]
BARS = ("ts", "open", "high", "low", "close", "volume")
#: Combinations that share one pass over a series.
LOT = 32


def by_bar(start: Callable[[dict], object], step: Callable[[object, dict, dict], tuple[object, float]]) -> Rule:
    """A rule from ``start(params)``, the state before the first bar, and ``step(state, bar, params)``, state and exposure."""

    def rule(params: dict) -> Step:
        state = start(params)

        def run(bars: pa.RecordBatch) -> list[float]:
            nonlocal state
            out = []
            for bar in bars.to_pylist():
                state, exposure = step(state, bar, params)
                out.append(exposure)
            return out

        return run

    return rule


@dataclass
class _Lane:
    """One combination on its way through a series."""

    param_id: int
    step: Step
    last: float = 0.0

    def advance(self, bars: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Exposure at the open of each bar, and wanted after its close."""
        want = np.asarray(self.step(bars), np.float64)
        if len(want) != bars.num_rows or not np.isfinite(want).all():
            raise ValueError(f"a rule returns one finite exposure for each bar (combination {self.param_id})")
        at_open = np.concatenate([[self.last], want[:-1]])
        self.last = float(want[-1])
        return at_open, want


def sequential(rule: Rule, reads: Sequence[str] = BARS, memory: int | None = None, lot: int = LOT) -> Evaluator:
    """Evaluator of a rule that reads the columns ``reads`` of the bars."""

    def evaluate(run: Run) -> tuple[DataFrame, Series]:
        spark = run.bars.sparkSession
        share_package(spark)
        keys, grid, full = list(run.series.keys), run.grid, run.full
        n, per = grid.size(), lot if run.chosen is None else 1
        if run.chosen is None:
            rows = run.bars.withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n - 1) // per).cast("long"))))
        else:
            rows = run.bars.join(run.chosen.select(*keys, F.col("param_id").alias("_lot")), keys)
        size = max(run.series.rows_per_task, (memory or 0) + 1) if run.series.chunk and memory is not None else 0
        if size:
            own = F.expr(f"bar_idx div {size}L")
            late = F.col("bar_idx") % size >= size - (memory + 1)
            rows = rows.withColumn("_own", own).withColumn("_blk", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
        else:
            rows = rows.withColumns({"_own": F.lit(0).cast("long"), "_blk": F.lit(0).cast("long")})
        wide = run.series.with_keys("param_id")
        kept = run.bars.columns if full else [*run.series.cluster, "bar_idx", "ret_oo", "first_ts", "last_ts"]
        rows = rows.select(*dict.fromkeys([*kept, "bar_idx", *reads]), "_lot", "_own", "_blk")
        cluster = [*keys, "_lot", "_blk"]
        rows = rows.repartition(work_partitions(spark), *cluster).sortWithinPartitions(*cluster, "bar_idx")

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lanes: list[_Lane] = []
            before = -1
            flat: dict[int, bool] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                if not lanes:
                    first = batch.column("_lot")[0].as_py() * per
                    lanes = [_Lane(i, rule(grid.row(i))) for i in range(first, min(n, first + per))]
                    flat = dict.fromkeys((lane.param_id for lane in lanes), True)
                at = batch.column("bar_idx").to_numpy(zero_copy_only=False)
                if at[0] <= before or (np.diff(at) <= 0).any():
                    raise ValueError("bars out of order")
                before = at[-1]
                mine = batch.column("_own").to_numpy(zero_copy_only=False) == batch.column("_blk").to_numpy(zero_copy_only=False)
                bars, out = batch.select(list(reads)), batch.select(kept)
                for lane in lanes:
                    at_open, want = lane.advance(bars)
                    keep = mine
                    if not full:  # other bars leave the curve flat; the first flat bar after a position shows its end
                        held = at_open != 0
                        keep = mine & (held | np.concatenate([[not flat[lane.param_id]], held[:-1]]) | (at == 0))
                        flat[lane.param_id] = not held[-1]
                    columns = [*out.columns, pa.array(np.full(len(at), lane.param_id, np.int64)), pa.array(at_open)]
                    names = [*kept, "param_id", "pos_open"]
                    if full:
                        columns, names = [*columns, pa.array(want)], [*names, "target_exposure"]
                    got = pa.RecordBatch.from_arrays(columns, names)
                    yield got if keep.all() else got.filter(pa.array(keep))

        walk.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
        schema = rows.select(*kept).schema.add("param_id", "long").add("pos_open", "double")
        if full:
            schema = schema.add("target_exposure", "double")
        df = rows.groupBy(*cluster).applyInArrow(walk, schema)
        if full:
            df = df.join(grid.small_frame(spark), "param_id").withColumns(
                {"buy_signal": F.col("target_exposure") > F.col("pos_open"), "sell_signal": F.col("target_exposure") < F.col("pos_open")}
            )
        return df, wide

    return evaluate


def decisions(strategy: Strategy, candles: DataFrame, positions: DataFrame, grid: Grid, candle_count: int = 400) -> DataFrame:
    """What a strategy of one combination decides on each market's last candle, against the position it really holds.

    Only the newest candles are read (``candle_count``, or warm-up + 2 if that is more).  ``positions`` has symbol and qty.
    """
    from tidemark.operators.indicators import index_bars
    from tidemark.plans.experiment import with_returns

    if grid.size() != 1:
        raise ValueError("a decision needs exactly one combination")
    series = Series(("market",), ("ts",))
    bars = index_bars(latest(candles, max(candle_count, strategy.warmup(grid.row(0)) + 2)), series)
    bars, series = with_returns(bars, series.with_order("bar_idx"))
    rows, _ = strategy.evaluate(Run(bars, series, grid))
    held = positions.groupBy(F.col("symbol").alias("market")).agg((F.sum("qty") > 0).alias("has_position"))
    last = rows.where(F.col("bar_idx") == F.col("n_bars") - 1).join(held, "market", "left")
    has = F.coalesce("has_position", F.lit(False))
    return last.select(
        "market",
        "ts",
        "close",
        "target_exposure",
        has.alias("has_position"),
        (~has & (F.col("target_exposure") > 0)).alias("buy_signal"),
        (has & (F.col("target_exposure") == 0)).alias("sell_signal"),
    )


def _parabolic_start(params: dict) -> None:
    return None


def _parabolic_step(state: tuple | None, bar: dict, params: dict) -> tuple[tuple, float]:
    step, most = params["af_step"], params["af_max"]
    high, low = bar["high"], bar["low"]
    if state is None:
        return (False, high, low, step), 0.0
    up, stop, extreme, pace = state
    stop += pace * (extreme - stop)
    if (low < stop) if up else (high > stop):
        up, stop, extreme, pace = not up, extreme, low if up else high, step
    elif (high > extreme) if up else (low < extreme):
        extreme, pace = high if up else low, min(most, pace + step)
    return (up, stop, extreme, pace), 1.0 if up else 0.0


#: Parabolic stop and reverse, long or flat: the stop moves towards the extreme price at a growing pace.
PARABOLIC = Strategy(
    "parabolic",
    (Axis("af_step", "double"), Axis("af_max", "double")),
    sequential(by_bar(_parabolic_start, _parabolic_step), ("high", "low")),
    lambda p: 2,
    checks=((lambda v: max(v["af_step"]) <= min(v["af_max"]), "af_max must be >= af_step"),),
)
