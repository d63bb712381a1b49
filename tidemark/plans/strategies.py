"""The five strategy families as DataFrame functions over (bars x parameter combinations).

Every family works in two steps.  Step one runs on bars, once per *distinct* indicator setting (average length,
band, range period, lookback).  Step two joins the combinations on those settings and runs the parts that need a
whole combination.  In grid mode only bars on which a position could be open reach step two, as all other bars
leave the curve flat.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import equity as eq
from tidemark.operators import indicators as ind
from tidemark.operators import positions as pos
from tidemark.operators.scan import Series
from tidemark.plans.grid import Axis, Grid, float_axis, int_axis

Evaluator = Callable[["Run"], tuple[DataFrame, Series]]
Derive = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Run:
    """Input of an evaluator: numbered bars, their series, the grid, optional chosen rows, and the mode."""

    bars: DataFrame
    series: Series
    grid: Grid
    chosen: DataFrame | None = None
    full: bool = True
    options: dict | None = None

    def combine(
        self, df: DataFrame, on: list[str], derive: Callable[[DataFrame], DataFrame], slim: list[str]
    ) -> tuple[DataFrame, Series]:
        """Join combinations to rows of step one, derive row values, and spread the rows over (series, combination).

        In grid mode only the columns that step two reads go through the shuffle.
        """
        keys = list(self.series.keys)
        if self.chosen is None:
            joined = df.join(self.grid.small_frame(df.sparkSession), on)
        else:
            joined = df.join(self.chosen, keys + on)
        wide = self.series.with_keys("param_id")
        joined = derive(joined)
        if not self.full:
            joined = joined.select(*wide.cluster, "bar_idx", "ret_oo", "first_ts", "last_ts", *slim)
        return joined.repartition(*wide.cluster), wide


def _at(array: str, index: Column) -> Column:
    return F.element_at(F.col(array), index + 1)


def _first_bar() -> Column:
    return F.col("bar_idx") == 0


def _volatility(run: Run, periods: list[int], lookbacks: list[int]) -> DataFrame:
    """Add ``vols``: range, ratio and rank for each (period, lookback) pair, periods slowest."""
    df, cells, temp = run.bars, [], []
    for p in periods:
        df = ind.atr(df, run.series, p, f"_atr{p}").withColumn(f"_ratio{p}", ind.price_ratio(f"_atr{p}"))
        temp += [f"_atr{p}", f"_ratio{p}"]
        ranks = {f"_rank{p}_{lb}": lb for lb in lookbacks}
        if ranks:
            df = ind.rolling_ranks(df, run.series, ranks, f"_ratio{p}")
            temp += ranks
        for name in ranks or [None]:
            rank = F.col(name) if name else F.lit(None).cast("double")
            cells.append(
                F.struct(F.col(f"_atr{p}").alias("atr"), F.col(f"_ratio{p}").alias("ratio"), rank.alias("rank"))
            )
    return df.withColumn("vols", F.array(*cells)).drop(*temp)


def _trend(run: Run, df: DataFrame, tags: list[str], with_entry: bool) -> tuple[DataFrame, Series]:
    """Regimes and episodes for each (average length, band); in grid mode only bars that matter."""
    df, series = ind.ema(df, run.series, run.grid.distinct("regime_ema_len"), axis="regime_ema_len")
    band_cells = [F.struct(F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(run.grid.values["regime_band"])]
    df = df.withColumn("_b", F.explode(F.array(*band_cells)))
    df = df.withColumns({"regime_band_i": F.col("_b.i"), "band": F.col("_b.v")}).drop("_b")
    series = series.with_keys("regime_band_i")
    df = ind.regime(df, series, F.col("band"))
    df = pos.episodes(df, series, None, *tags)
    if run.full:
        return df, series
    df = pos.bull_stretch(df, series)
    df = series.shift(df, _held_before=F.col("may_hold"))
    keep = F.col("may_hold") | F.coalesce("_held_before", F.lit(False)) | _first_bar()
    if with_entry:
        keep = keep | (F.col("bar_idx") == F.col("entry"))
    return df.where(keep).drop("_held_before"), series


def _place(run: Run, name: str) -> Column:
    """Position of a combination's value among the distinct values of its axis."""
    return F.create_map(*[F.lit(x) for i, v in enumerate(run.grid.distinct(name)) for x in (v, i)])[F.col(name)]


def _pick(df: DataFrame, cell: Column) -> DataFrame:
    """Replace ``vols`` by the range, ratio and rank of the combination."""
    df = df.withColumn("_v", _at("vols", cell)).drop("vols")
    return df.withColumns({"atr": F.col("_v.atr"), "ratio": F.col("_v.ratio"), "rank": F.col("_v.rank")}).drop("_v")


ON_TREND = ["regime_ema_len", "regime_band_i"]
Prepare = Callable[["Run"], tuple[DataFrame, Derive]]


def long_flat(prepare: Prepare) -> Evaluator:
    """Evaluator of a strategy that holds all or nothing, from its rows of step one and its row values."""

    def evaluate(run: Run) -> tuple[DataFrame, Series]:
        df, derive = prepare(run)
        return _long_flat(run, *run.combine(df, ON_TREND, derive, ["entry", "_exit"]))

    return evaluate


def _stop_and_exit(df: DataFrame, mult: Column) -> DataFrame:
    """Stop price, its hit, and the exit flag of full positions; all from the row itself."""
    df = df.withColumns({"_stop": pos.trail_stop(F.col("highest"), mult, F.col("atr")), "mult": mult})
    df = df.withColumn("_hit", F.coalesce(F.col("close") <= F.col("_stop"), F.lit(False)))
    return df.withColumn("_exit", F.col("_hit") | ind.bear_turn())


def _long_flat(run: Run, df: DataFrame, series: Series) -> tuple[DataFrame, Series]:
    """Full position from a buy turn until trailing stop or bear turn."""
    df = pos.hold_until_exit(df, series, F.col("_exit"))
    held = F.col("held")
    df = df.withColumn("pos_open", F.when(held, 1.0).otherwise(0.0))
    if not run.full:
        return df.drop("held", "_exit"), series
    buy = F.coalesce(F.col("bar_idx") == F.col("entry"), F.lit(False))
    df = df.withColumns(
        {
            "setup_buy": buy,
            "setup_sell": held & ind.bear_turn(),
            "trail_stop_triggered": held & F.col("_hit"),
            "atr_trail_stop": F.when(held, F.col("_stop")),
            "buy_signal": buy & ~held,
            "sell_signal": held & F.col("_exit"),
        }
    )
    return df.drop("_stop", "_hit", "_exit", "held", "highest"), series


def moving_average_rule(run: Run) -> tuple[DataFrame, Series]:
    """v1: above a rising average with low RSI; out below the average."""
    grid, s = run.grid, run.series
    lengths, days = grid.distinct("ma_len"), grid.distinct("ma_slope_days")
    df = ind.rsi(run.bars, s)

    def averages(w):
        return {
            f"_ma{n}": F.when(F.col("bar_idx") >= n - 1, F.avg("close").over(w.rowsBetween(-(n - 1), 0)))
            for n in lengths
        }

    def slopes(w):
        return {
            f"_up{n}_{d}": F.coalesce(F.col(f"_ma{n}") > F.lag(f"_ma{n}", d).over(w), F.lit(False))
            for n in lengths
            for d in days
        }

    df = s.rolling(df, max(lengths), "bar_idx", averages)
    df = s.rolling(df, max(days) + 1, "bar_idx", slopes)
    temp = [f"_ma{n}" for n in lengths] + [f"_up{n}_{d}" for n in lengths for d in days]
    cells = [
        F.struct(
            F.lit(n).alias("ma_len"),
            F.col(f"_ma{n}").alias("ma"),
            F.array(*[F.col(f"_up{n}_{d}") for d in days]).alias("ups"),
        )
        for n in lengths
    ]
    df = df.withColumn("_m", F.explode(F.array(*cells))).drop(*temp)
    df = df.withColumns({c: F.col(f"_m.{c}") for c in ("ma_len", "ma", "ups")}).drop("_m")

    def derive(rows: DataFrame) -> DataFrame:
        up = _at("ups", _place(run, "ma_slope_days"))
        buy = (F.col("close") > F.col("ma")) & up & (F.col("rsi") < F.col("rsi_buy"))
        rows = rows.withColumns(
            {
                "buy_signal": F.coalesce(buy, F.lit(False)),
                "sell_signal": F.coalesce(F.col("close") < F.col("ma"), F.lit(False)),
            }
        ).drop("ups")
        unknown = F.col("ma").isNull() | F.col("rsi").isNull()
        step = F.when(unknown | F.col("sell_signal"), 0.0).when(F.col("buy_signal"), 1.0)
        return rows.withColumn("_step", step)

    df, wide = run.combine(df, ["ma_len"], derive, ["_step"])
    df = wide.running(df, _close=("last", F.col("_step")))
    df = wide.shift(df, _open=F.col("_close"))
    return df.withColumn("pos_open", F.coalesce("_open", F.lit(0.0))).drop("_close", "_open", "_step"), wide


def regime_trail(run: Run) -> tuple[DataFrame, Derive]:
    """v2: regime turns with one trailing-stop multiplier."""
    df = _volatility(run, run.grid.distinct("atr_period"), [])
    df, s = _trend(run, df, [], False)
    df = pos.highest_close(df, s)

    def derive(rows: DataFrame) -> DataFrame:
        return _stop_and_exit(_pick(rows, _place(run, "atr_period")), F.col("atr_trail_multiplier"))

    return df, derive


def weekly_trend(run: Run) -> tuple[DataFrame, Derive]:
    """v4: v2 with entries only in weeks whose close is not below the weekly average."""
    lagged = bool((run.options or {}).get("lagged_week"))
    bars = ind.weekly_filter(run.bars, run.series, run.grid.distinct("weekly_ema_len"), lagged)
    run = replace(run, bars=bars.drop("iso_year", "iso_week"))
    df = _volatility(run, run.grid.distinct("atr_period"), [])
    df, s = _trend(run, df, ["weekly"], False)
    df = pos.highest_close(df, s)

    def derive(rows: DataFrame) -> DataFrame:
        week = _place(run, "weekly_ema_len")
        today, at_entry = _at("weekly", week), _at("entry_weekly", week)
        rows = rows.withColumns(
            {
                "weekly_ema": today["ema"],
                "weekly_bullish": today["bullish"],
                "entry": F.when(at_entry["bullish"], F.col("entry")),
            }
        ).drop("weekly", "entry_weekly")
        return _stop_and_exit(_pick(rows, _place(run, "atr_period")), F.col("atr_trail_multiplier"))

    return df, derive


def adaptive_trail(run: Run) -> tuple[DataFrame, Derive]:
    """v5: the stop multiplier depends on the volatility rank."""
    lookbacks = run.grid.distinct("vol_regime_lookback")
    df = _volatility(run, run.grid.distinct("atr_period"), lookbacks)
    df, s = _trend(run, df, [], False)
    df = pos.highest_close(df, s)

    def derive(rows: DataFrame) -> DataFrame:
        cell = _place(run, "atr_period") * len(lookbacks) + _place(run, "vol_regime_lookback")
        rows = _pick(rows, cell).withColumnsRenamed({"ratio": "atr_price_ratio", "rank": "vol_percentile"})
        high = ind.is_high(F.col("vol_percentile"), F.col("vol_regime_threshold"))
        rows = rows.withColumn("volatility_is_high", high)
        mult = F.when(F.col("volatility_is_high"), F.col("atr_mult_high_vol")).otherwise(F.col("atr_mult_low_vol"))
        return _stop_and_exit(rows, mult)

    return df, derive


def volatility_target(run: Run) -> tuple[DataFrame, Series]:
    """v3: exposure aims at a volatility; the stop's high restarts when the exposure grows."""
    df = _volatility(run, run.grid.distinct("atr_period"), [])
    df, s = _trend(run, df, [], True)

    def derive(rows: DataFrame) -> DataFrame:
        rows = _pick(rows, _place(run, "atr_period")).withColumnRenamed("ratio", "vol_proxy")
        aim = pos.target_exposure(*(F.col(c) for c in ("vol_proxy", "vol_target", "max_leverage", "min_exposure")))
        return rows.withColumns(
            {
                "_desired": aim,
                "_gap": F.when(F.col("atr_trail_multiplier") > 0, F.col("atr_trail_multiplier") * F.col("atr")),
                "_bull": F.col("regime") == ind.BULL,
            }
        )

    df, wide = run.combine(df, ON_TREND, derive, ["close", "entry", "_desired", "_gap", "_bull"])
    df = wide.shift(df, _x=F.col("_desired"))
    df = df.withColumn("_x", F.when(pos.in_episode(), F.col("_x")).otherwise(0.0))
    df = wide.shift(df, _x0=F.col("_x"))
    grew = F.col("_x") > F.coalesce("_x0", F.lit(0.0))
    df = wide.running(df, _since=("last", F.when(grew, F.col("bar_idx"))))
    df = pos.highest_close(df, wide, since="_since").withColumn("_stop", F.col("highest") - F.col("_gap"))
    df = df.withColumn("_hit", F.coalesce(F.col("close") <= F.col("_stop"), F.lit(False)))
    after = F.col("bar_idx") > F.col("entry")
    leave = (F.col("_desired") == 0) | (after & (F.col("_hit") | ~F.col("_bull")))
    df = pos.hold_until_exit(df, wide, leave, from_entry=True)
    held = F.col("held")
    df = df.withColumn("pos_open", F.when(held, F.col("_x")).otherwise(0.0))
    helpers = ["_x", "_x0", "_since", "_stop", "_hit", "_bull", "_gap", "_desired", "held", "highest"]
    if not run.full:
        return df.drop(*helpers, "close"), wide
    buy = F.coalesce(F.col("bar_idx") == F.col("entry"), F.lit(False))
    stay = F.col("_bull") & ~(held & F.col("_hit")) & (buy | held)
    df = df.withColumn("target_exposure", F.when(stay, F.col("_desired")).otherwise(0.0))
    df = df.withColumns(
        {
            "setup_buy": buy,
            "setup_sell": held & ind.bear_turn(),
            "trail_stop_triggered": held & F.col("_hit"),
            "atr_trail_stop": F.when(held, F.col("_stop")),
            "buy_signal": F.col("target_exposure") > F.col("pos_open"),
            "sell_signal": F.col("target_exposure") < F.col("pos_open"),
        }
    )
    return df.drop(*helpers), wide


@dataclass(frozen=True)
class Strategy:
    """A registered family: axes, checks across axes, evaluator, warm-up and accounting rules."""

    version: str
    axes: tuple[Axis, ...]
    evaluate: Evaluator
    warmup: Callable[[dict], int]
    checks: tuple[tuple[Callable[[dict], bool], str], ...] = ()
    prepare: Prepare | None = None
    rounded_trades: bool = False
    floor_hold_start: bool = True

    def grid(self, fee_per_side: float = 0.0005, slippage: float = 0.0002, **values: object) -> Grid:
        """A grid from lists, single values or ``start:end:step`` specs."""
        axes = {}
        for axis in self.axes:
            v = values.pop(axis.name, [None] if axis.optional else None)
            if isinstance(v, str):
                v = int_axis(v, positive=self.version != "v1") if axis.kind == "int" else float_axis(v)
            axes[axis.name] = list(v) if isinstance(v, (list, tuple)) else [v]
        if values:
            raise ValueError(f"unknown axes for {self.version}: {sorted(values)}")
        return Grid(self.axes, axes, fee_per_side, slippage, self.checks)


_BAND = Axis("regime_band", "double", lambda v: 0 <= v < 1, "in [0, 1)")
_LEN = Axis("regime_ema_len", "int")
_PERIOD = Axis("atr_period", "int")
_TRAIL = Axis("atr_trail_multiplier", "double", lambda v: v >= 0, ">= 0")


class Registry:
    """Strategies by version key (trimmed, lower case)."""

    def __init__(self) -> None:
        self._by_version: dict[str, Strategy] = {}

    @staticmethod
    def _key(version: str | None) -> str:
        return (version or "").strip().lower()

    def register(self, strategy: Strategy) -> Strategy:
        key = self._key(strategy.version)
        if not key:
            raise ValueError("strategy version must not be blank")
        if key in self._by_version:
            raise ValueError(f"strategy {key} is registered twice")
        self._by_version[key] = strategy
        return strategy

    def versions(self) -> list[str]:
        return sorted(self._by_version)

    def get(self, version: str | None = None) -> Strategy:
        """The strategy of a version; without one, the only registered strategy."""
        key = self._key(version)
        if not key:
            if len(self._by_version) != 1:
                raise ValueError("choose a strategy version: " + ", ".join(self.versions()))
            return next(iter(self._by_version.values()))
        if key not in self._by_version:
            raise ValueError(f"unknown strategy version {key}; known: " + ", ".join(self.versions()))
        return self._by_version[key]


REGISTRY = Registry()
REGISTRY.register(
    Strategy(
        "v1",
        (
            Axis("rsi_buy", "double", lambda v: True, "any number"),
            Axis("ma_len", "int"),
            Axis("ma_slope_days", "int", lambda v: v >= 0, ">= 0"),
        ),
        moving_average_rule,
        lambda p: max(p["ma_len"] + p["ma_slope_days"], ind.RSI_PERIOD + 1),
        rounded_trades=True,
        floor_hold_start=False,
    )
)
REGISTRY.register(
    Strategy(
        "v2",
        (_LEN, _PERIOD, _TRAIL, _BAND),
        long_flat(regime_trail),
        lambda p: max(p["regime_ema_len"], p["atr_period"]),
        prepare=regime_trail,
    )
)
REGISTRY.register(
    Strategy(
        "v3",
        (
            _LEN,
            _PERIOD,
            _TRAIL,
            _BAND,
            Axis("vol_target", "double"),
            Axis("max_leverage", "double"),
            Axis("min_exposure", "double", lambda v: v >= 0, ">= 0", optional=True),
        ),
        volatility_target,
        lambda p: max(p["regime_ema_len"], p["atr_period"]),
        checks=(
            (
                lambda v: max((x or 0.0) for x in v["min_exposure"]) <= min(v["max_leverage"]),
                "min_exposure must be <= max_leverage",
            ),
        ),
    )
)
REGISTRY.register(
    Strategy(
        "v4",
        (_LEN, _PERIOD, _TRAIL, _BAND, Axis("weekly_ema_len", "int")),
        long_flat(weekly_trend),
        lambda p: max(p["regime_ema_len"], p["atr_period"], 7 * p["weekly_ema_len"]),
        prepare=weekly_trend,
    )
)
REGISTRY.register(
    Strategy(
        "v5",
        (
            _LEN,
            _PERIOD,
            Axis("atr_mult_low_vol", "double", lambda v: v >= 0, ">= 0"),
            Axis("atr_mult_high_vol", "double", lambda v: v >= 0, ">= 0"),
            Axis("vol_regime_lookback", "int"),
            Axis("vol_regime_threshold", "double", lambda v: 0 < v <= 1, "in (0, 1]"),
            _BAND,
        ),
        long_flat(adaptive_trail),
        lambda p: max(p["regime_ema_len"], p["atr_period"], p["vol_regime_lookback"]),
        prepare=adaptive_trail,
        checks=(
            (
                lambda v: max(v["atr_mult_low_vol"]) <= min(v["atr_mult_high_vol"]),
                "atr_mult_high_vol must be >= atr_mult_low_vol",
            ),
        ),
    )
)


def backtest(strategy: Strategy, run: Run) -> tuple[DataFrame, Series]:
    """Bar rows with position, turnover and curves for each (series, combination)."""
    df, series = strategy.evaluate(run)
    df = pos.turnover(series.settle(df), series)
    if not run.full:  # other bars leave the curve flat
        df = df.where((F.col("pos_open") != 0) | (F.col("trade") != 0) | _first_bar())
    df = eq.equity_curves(df, series, run.grid.cost, run.full, strategy.floor_hold_start)
    return eq.drawdown(df, series), series
