"""Grid scores of all-or-nothing strategies from trade episodes.

While a position is held its curve does not depend on the stop setting, only its end does.  So the curve from the
entry to each bar (value, peak, low, drawdown) is computed once per (average length, band), and a combination
only picks, per episode, the first bar on which it leaves.

First exits come from records, not from trying every stop on every bar.  The stops of a multiplier axis are nested: a
bar that reaches the stop of a large multiplier reaches those of all smaller ones.  So a bar is described by how many
multipliers of each axis it stops, and an episode by the first bar of each such count: at most one record for each
multiplier, whatever the number of bars.  The exit for a multiplier is the earliest record of a higher count.  With two
axes (one for calm bars, one for the others) there are two lists of records, and the exit is the earlier of the two, so
the work per bar grows with the sum of the axes, not with their product.

Drawdown joins up across episodes as x / max(a, b) = min(x / a, x / b).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.equity import MIN_EQUITY
from tidemark.operators.indicators import bear_turn
from tidemark.plans.grid import Grid
from tidemark.plans.strategies import ON_TREND, Derive, Prepare, Run
from tidemark.session import share_package, work_partitions


def held_paths(rows: DataFrame, keys: list[str], cost: float) -> DataFrame:
    """Curve since entry for every bar on which a position could be open; the first bar pays the entry cost.

    The first bar of a series stays in as episode -1 with a flat curve, so that every combination has a row.
    """
    over = Window.partitionBy(*keys, "episode").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    growth = f"CASE WHEN bar_idx = 0 THEN 1.0D ELSE 1.0D + ret_oo - if(bar_idx = entry + 1, {cost!r}D, 0.0D) END"
    rows = rows.where("may_hold OR bar_idx = 0").selectExpr(
        "*", "if(bar_idx = 0, -1L, entry) AS episode", f"{growth} AS _g"
    )
    wrong = F.expr("NOT (_g > 0 AND _g < double('Infinity'))")
    rows = rows.withColumns({"path": F.product("_g").over(over), "wrong": F.max(wrong).over(over)})
    rows = rows.withColumns({"peak": F.greatest(F.lit(1.0), F.max("path").over(over)), "low": F.min("path").over(over)})
    return rows.withColumn("fall", F.min(F.col("path") / F.col("peak") - 1.0).over(over)).drop("_g")


#: Episodes times combinations worked on at once.
CELLS = 1 << 20
#: Multiplier axes, and the bars each of them is for.
STOPS = {
    "atr_trail_multiplier": "true",
    "atr_mult_low_vol": "NOT volatility_is_high",
    "atr_mult_high_vol": "volatility_is_high",
}


def stops_of(grid: Grid) -> dict[str, list[float]]:
    """The multipliers of each axis that set a stop, rising."""
    return {n: [m for m in grid.distinct(n) if m > 0] for n in STOPS if n in grid.values}


def can_leave(run: Run) -> Column:
    """Bars on which some combination could leave: bear turn, last bar, or below the closest stop of the grid.

    The first bar passes too, see ``held_paths``.
    """
    active = [m for ms in stops_of(run.grid).values() for m in ms]
    out = bear_turn() | F.col("bar_idx").isin(0) | (F.col("bar_idx") == F.col("n_bars") - 1)
    if active:
        closest = F.array_min(F.transform("vols", lambda v: v["atr"])) * min(active)
        out = out | F.coalesce(F.col("close") <= F.col("highest") - closest, F.lit(False))
    return out


def marked_bars(paths: DataFrame, run: Run, derive: Derive) -> DataFrame:
    """Bars of each cell (values of the axes without average, band and multipliers) on which a combination could leave.

    ``every``: all leave.  ``hits_<i>``: how many multipliers of list ``i`` of ``stops_of`` stop this bar.
    """
    cells, stops = cells_of(run.grid), stops_of(run.grid)
    # A fixed partition count: the rows multiply by the cells right after, which their size does not show.
    spread = paths.repartition(work_partitions(paths.sparkSession), *run.series.keys, *ON_TREND, "bar_idx")
    rows = spread.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells.size() - 1))))
    none = {n: F.lit(None).cast("double") for n in stops}  # a cell has no multiplier yet
    rows = derive(rows.selectExpr("*", *cells.columns("cell")).withColumns(none)).where("bar_idx = 0 OR entry IS NOT NULL")
    hits = []
    for i, (name, many) in enumerate(stops.items()):
        reached = " + ".join(f"if(close <= highest - {m!r}D * atr, 1, 0)" for m in many) or "0"
        hits.append(f"CASE WHEN {STOPS[name]} THEN {reached} ELSE 0 END AS hits_{i}")
    every = F.expr("bar_idx = 0 OR bar_idx = n_bars - 1") | bear_turn()
    rows = rows.withColumn("every", F.coalesce(every, F.lit(False))).selectExpr("*", *hits)
    some = " OR ".join(["every", *(f"hits_{i} > 0" for i in range(len(stops)))])
    sold = F.expr("bar_idx > 0 AND bar_idx < n_bars - 1").alias("sold")
    names = [*run.series.keys, *ON_TREND, "cell", "bar_idx", "episode", "every", *(f"hits_{i}" for i in range(len(stops)))]
    return rows.where(some).select(*names, sold, "path", "peak", "low", "fall", "wrong", "first_ts", "last_ts")


def cells_of(grid: Grid) -> Grid:
    """The axes that a stop's distance and the bars it is for depend on."""
    return grid.part([a.name for a in grid.axes if a.name not in STOPS and a.name not in ("regime_ema_len", "regime_band")])


def combinations(grid: Grid, length: int, band_i: int, cell: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Numbers of the combinations of a cell, and the place of each one's multiplier in each list of ``stops_of``."""
    strides, cells = grid.strides(), cells_of(grid)
    inner = cells.strides()
    base = band_i * strides["regime_band"] + sum(cell // inner[n] % len(cells.values[n]) * strides[n] for n in inner)
    numbers = np.array([base + i * strides["regime_ema_len"] for i, v in enumerate(grid.values["regime_ema_len"]) if v == length])
    places: list[np.ndarray] = []
    for name, many in stops_of(grid).items():
        values = grid.values[name]
        place = np.array([many.index(v) if v > 0 else len(many) for v in values])  # the last place is never reached
        places = [np.repeat(p, len(values)) for p in places] + [np.tile(place, len(numbers))]
        numbers = (numbers[:, None] + np.arange(len(values)) * strides[name]).ravel()
    return numbers, places


class Scores:
    """Running scores of the combinations of one cell, episode by episode."""

    def __init__(self, places: list[np.ndarray], lengths: list[int], cost: float) -> None:
        self.places, self.lengths, self.cost = places, lengths, cost
        n = len(places[0])
        self.equity, self.peak = np.ones(n), np.ones(n)
        self.mdd, self.trades, self.floor = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, bool)

    def add(self, rows: dict[str, np.ndarray]) -> None:
        """Whole episodes, in order of their bars."""
        episode = rows["episode"]
        start = np.concatenate([[0], np.flatnonzero(np.diff(episode)) + 1])
        if len(start) > 1 and len(start) * len(self.equity) > CELLS:
            middle = start[len(start) // 2]
            for part in (slice(0, middle), slice(middle, None)):
                self.add({n: v[part] for n, v in rows.items()})
            return
        at = np.arange(len(episode))
        out = len(episode)
        exits = np.full((len(self.places[0]), len(start)), out)
        for i, (place, length) in enumerate(zip(self.places, self.lengths, strict=True)):
            # Row j: the first bar of each episode that stops more than j multipliers, or that all leave on.
            first = np.stack([np.minimum.reduceat(np.where(rows["every"] | (rows[f"hits_{i}"] > j), at, out), start) for j in range(length + 1)])
            exits = np.minimum(exits, first[place])
        left = exits < out
        exits = np.minimum(exits, out - 1)

        def there(name: str, idle: float) -> np.ndarray:
            return np.where(left, rows[name][exits], idle)

        path, sold = there("path", 1.0), there("sold", False)
        end = np.where(sold, path * (1.0 - self.cost), path)
        with np.errstate(all="ignore"):
            # e0, p0: equity and its peak when the episode begins.
            grown = self.equity[:, None] * np.cumprod(end, axis=1)
            e0 = np.concatenate([self.equity[:, None], grown[:, :-1]], axis=1)
            tops = np.maximum.accumulate(np.concatenate([self.peak[:, None], e0 * there("peak", 1.0)], axis=1), axis=1)
            lows = np.minimum(there("low", np.inf), np.where(left, end, np.inf))
            falls = np.minimum(there("fall", np.inf), np.where(left, end / there("peak", 1.0) - 1.0, np.inf))
            deep = np.where(left, e0 * lows / tops[:, :-1] - 1.0, np.inf)
            broken = there("wrong", False) | ~(end > 0) | (left & ~(e0 * lows > MIN_EQUITY))
        self.mdd = np.minimum(self.mdd, np.minimum(falls, deep).min(axis=1))
        self.trades += np.where(left & (episode[start] >= 0), np.where(sold, 2, 1), 0).sum(axis=1)
        self.floor |= broken.any(axis=1)
        self.equity, self.peak = grown[:, -1], tops[:, -1]


def episode_scores(prepare: Prepare, run: Run) -> DataFrame:
    """Final equity, drawdown and trades per series and combination.  ``at_floor``: the floor of 1e-12 was touched.

    The bars of a (series, average, band, cell) reach a task in order, one episode in memory at a time.
    """
    keys, grid = list(run.series.keys), run.grid
    on = [*keys, *ON_TREND]
    rows, derive = prepare(run)
    share_package(rows.sparkSession)
    marked = marked_bars(held_paths(rows, on, grid.cost).where(can_leave(run)), run, derive)
    cluster = [*on, "cell"]
    marked = marked.repartition(work_partitions(marked.sparkSession), *cluster).sortWithinPartitions(*cluster, "bar_idx")
    lengths = [len(m) for m in stops_of(grid).values()]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: pa.RecordBatch | None = None
        rest: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            if head is None:
                head = batch.slice(0, 1)
                numbers, places = combinations(grid, *(head.column(c)[0].as_py() for c in (*ON_TREND, "cell")))
                scores = Scores(places, lengths, grid.cost)
            names = [n for n in batch.schema.names if n not in cluster and not n.endswith("_ts")]
            new = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
            rest = {n: np.concatenate([rest[n], v]) for n, v in new.items()} if rest else new
            # The last episode may go on in the next batch.
            cut = int(np.searchsorted(rest["episode"], rest["episode"][-1]))
            if cut:
                scores.add({n: v[:cut] for n, v in rest.items()})
                rest = {n: v[cut:] for n, v in rest.items()}
        if head is None:
            return
        scores.add(rest)
        many = len(numbers)
        same = [head.column(c).take(pa.array(np.zeros(many, np.int64))) for c in (*keys, "first_ts", "last_ts")]
        yield pa.RecordBatch.from_arrays(
            [*same, *map(pa.array, (numbers.astype(np.int64), scores.equity, scores.mdd, scores.trades, scores.floor))],
            [*keys, "first_ts", "last_ts", "param_id", "final_equity", "mdd", "trades", "at_floor"],
        )

    score.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    schema = marked.select(*keys, "first_ts", "last_ts").schema
    for name, kind in (("param_id", "long"), ("final_equity", "double"), ("mdd", "double"), ("trades", "long"), ("at_floor", "boolean")):
        schema = schema.add(name, kind)
    return marked.groupBy(*cluster).applyInArrow(score, schema)
