import pytest
import stepwise

from pyspark.sql import functions as F

from tidemark.plans.experiment import evaluate_grid, panel, with_returns
from tidemark.plans.strategies import REGISTRY, Run, backtest

SCHEMA = "market string, ts timestamp, open double, high double, low double, close double, volume double"
BARS = {"A-1": stepwise.walk(1, 200), "A-2": stepwise.walk(2, 251, 0.05), "A-3": stepwise.walk(3, 60)}
TREND = {"regime_ema_len": [5, 20], "atr_period": [1, 7], "regime_band": [0.0, 0.02]}
GRIDS = {
    "v1": {"rsi_buy": [55.0, 70.0], "ma_len": [5, 20], "ma_slope_days": [0, 3]},
    "v2": TREND | {"atr_trail_multiplier": [0.0, 2.0]},
    "v3": TREND | {"atr_trail_multiplier": [2.0], "vol_target": [0.02], "max_leverage": [2.0], "min_exposure": [None, 0.5]},
    "v4": TREND | {"atr_trail_multiplier": [2.0], "weekly_ema_len": [2, 5]},
    "v5": TREND
    | {
        "atr_mult_low_vol": [1.0],
        "atr_mult_high_vol": [2.0, 3.0],
        "vol_regime_lookback": [10, 20],
        "vol_regime_threshold": [0.6],
    },
}


def frame(spark, bars=BARS):
    rows = [(m, r["ts"], r["open"], r["high"], r["low"], r["close"], r["volume"]) for m, rs in bars.items() for r in rs]
    return spark.createDataFrame(rows, SCHEMA)


CASES = [(v, None) for v in GRIDS] + [("v1", 90), ("v3", 90), ("v5", 90)]


@pytest.mark.parametrize("version,rows_per_task", CASES)
def test_rows_and_grid_match_stepwise(spark, version, rows_per_task):
    strategy = REGISTRY.get(version)
    values = GRIDS[version]
    if rows_per_task:  # the chunked way runs many small jobs: a few combinations are enough
        values = {k: v[-1:] for k, v in values.items()}
    grid = strategy.grid(**values)
    bars, series = panel(frame(spark), rows_per_task)
    assert (series.chunk is not None) == bool(rows_per_task)
    bars, series = with_returns(bars, series)
    rows, wide = backtest(strategy, Run(bars, series, grid))
    names = [a.name for a in strategy.axes]
    got = {}
    for r in rows.select(*wide.keys, *names, "bar_idx", "pos_open", "equity", "equity_bh", "drawdown").collect():
        got.setdefault((r["market"], r["param_id"]), []).append(r)
    scores = {(r["market"], r["param_id"]): r for r in evaluate_grid(strategy, bars, series, grid).collect()}
    assert len(got) == len(scores) == 3 * grid.size()
    moved = 0
    for key, rs in got.items():
        rs.sort(key=lambda r: r["bar_idx"])
        want = stepwise.summary(version, BARS[key[0]], {n: rs[0][n] for n in names})
        assert [r["pos_open"] for r in rs] == pytest.approx(want["at_open"], rel=1e-9), key
        assert [r["equity"] for r in rs] == pytest.approx(want["equity"], rel=1e-9)
        assert [r["equity_bh"] for r in rs] == pytest.approx(want["bh"], rel=1e-9)
        s = scores[key]
        assert s["final_equity"] == pytest.approx(want["equity"][-1], rel=1e-9)
        assert s["mdd"] == pytest.approx(want["mdd"], abs=1e-12)
        assert s["trades"] == want["trades"]
        assert s["cagr"] == pytest.approx(want["cagr"], rel=1e-9, abs=1e-12)
        moved += want["trades"]
    assert moved > 0
    assert rows.where(F.col("drawdown") > 0).count() == 0


@pytest.mark.parametrize("version", ["v2", "v5"])
def test_grid_with_costs_that_hit_the_floor(spark, version):
    strategy = REGISTRY.get(version)
    grid = strategy.grid(fee_per_side=0.97, slippage=0.02, **{k: v[-1:] for k, v in GRIDS[version].items()})
    bars, series = with_returns(*panel(frame(spark)))
    names = [a.name for a in strategy.axes]
    for r in evaluate_grid(strategy, bars, series, grid).collect():
        want = stepwise.summary(version, BARS[r["market"]], {n: grid.values[n][0] for n in names}, grid.cost)
        assert r["final_equity"] == pytest.approx(want["equity"][-1], rel=1e-9)
        assert r["mdd"] == pytest.approx(want["mdd"], abs=1e-12)
        assert r["trades"] == want["trades"]


def test_one_market_may_hold_most_rows_in_the_live_scan(spark):
    """The newest-rows scan cuts each partition before the shuffle."""
    from tidemark.sources.candles import latest

    plan = latest(frame(spark), 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
