import pytest

from pyspark.sql import functions as F

from tidemark.plans.episodes import cells_of, combinations, stops_of
from tidemark.plans.experiment import holdout_segments, top_k, walkforward_segments
from tidemark.plans.grid import float_axis, int_axis
from tidemark.plans.strategies import REGISTRY, Registry, Strategy


def test_axes():
    assert float_axis("0.6:0.8:0.1") == [0.6, 0.7, 0.7999999999999999]
    assert int_axis("80:200:40") == [80, 120, 160, 200]
    assert int_axis("0:2:1", positive=False) == [0, 1, 2]
    for bad in ("1:2", "2:1:1", "1:2:0"):
        with pytest.raises(ValueError):
            float_axis(bad)
    with pytest.raises(ValueError):
        int_axis("0:2:1")


TREND = {"regime_ema_len": "80:200:40", "atr_period": "10:18:4", "regime_band": "0.01:0.03:0.01"}
SIZES = {
    "v1": ({"rsi_buy": "20:45:5", "ma_len": "20:120:10", "ma_slope_days": "1:9:2"}, 330),
    "v2": (TREND | {"atr_trail_multiplier": "2:4:1"}, 108),
    "v3": (TREND | {"atr_trail_multiplier": "2:4:1", "vol_target": "0.01:0.03:0.01", "max_leverage": "1.0:2.0:0.5", "min_exposure": "0:0:1"}, 972),
    "v4": (TREND | {"atr_trail_multiplier": "2:4:1", "weekly_ema_len": "10:30:10"}, 324),
    "v5": (
        TREND
        | {
            "atr_mult_low_vol": "1.5:2.5:0.5",
            "atr_mult_high_vol": "3.0:4.0:0.5",
            "vol_regime_lookback": "20:40:10",
            "vol_regime_threshold": "0.6:0.8:0.1",
        },
        2916,
    ),
}


@pytest.mark.parametrize("version", list(SIZES))
def test_published_grid_sizes_and_order(spark, version):
    axes, size = SIZES[version]
    grid = REGISTRY.get(version).grid(**axes)
    rows = grid.frame(spark).orderBy("param_id").collect()
    assert len(rows) == grid.size() == size
    names = [a.name for a in grid.axes]
    seen = [tuple(r[n] for n in names) for r in rows]
    assert seen == sorted(seen) and len(set(seen)) == size
    assert {r[names[-1]] for r in rows} == set(grid.values[names[-1]])


def test_bad_grids():
    v5 = SIZES["v5"][0]
    for change in ({"regime_band": 1.0}, {"atr_mult_low_vol": [5.0]}, {"vol_regime_threshold": [0.0]}, {"regime_ema_len": [0]}, {"atr_period": []}, {"nope": 1}):
        with pytest.raises(ValueError):
            REGISTRY.get("v5").grid(**(v5 | change))
    with pytest.raises(ValueError):
        REGISTRY.get("v3").grid(**(SIZES["v3"][0] | {"min_exposure": [3.0]}))
    with pytest.raises(ValueError):
        REGISTRY.get("v2").grid(fee_per_side=-1.0, **SIZES["v2"][0])


def test_registry():
    assert REGISTRY.get(" V5 ").version == "v5" and REGISTRY.versions() == ["v1", "v2", "v3", "v4", "v5"]
    own = Registry()
    mine = own.register(Strategy("mine", (), lambda run: (run.bars, run.series), lambda p: 0))
    assert own.get() is mine
    for bad in (lambda: own.register(mine), lambda: own.get("other"), lambda: REGISTRY.get(None), lambda: own.register(Strategy(" ", (), None, None))):
        with pytest.raises(ValueError):
            bad()


def test_rank_ties_and_undefined(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, None, 0.1, 1.1), (1, 2.0, 0.1, 1.1), (2, 2.0, 0.1, 1.1), (3, inf, 9.0, 9.0), (4, nan, 0.2, 1.0), (5, 3.0, -inf, 1.0)]
    df = spark.createDataFrame(rows, "param_id bigint, calmar double, cagr double, final_equity double").withColumn("m", F.lit("A"))
    got = [r["param_id"] for r in top_k(df, ["m"], 6).orderBy("rank").collect()]
    assert got == [5, 1, 2, 3, 4, 0]


def test_segments(spark):
    df = spark.createDataFrame([(3,), (4,), (10,), (1300,)], "n_bars bigint")
    hold = {r["n_bars"]: {s["segment"]: (s["lo"], s["hi"]) for s in r["s"]} for r in df.withColumn("s", holdout_segments(0.9)).collect()}
    assert hold[3] == {} and hold[4]["validation"] == (0, 2) and hold[10]["validation"] == (0, 8) and hold[1300]["test"] == (1170, 1300)
    walk = {r["n_bars"]: {s["segment"]: (s["lo"], s["hi"]) for s in r["s"]} for r in df.withColumn("s", walkforward_segments(3)).collect()}
    assert walk[10] == {} and walk[1300] == {
        "train_1": (0, 325), "test_1": (325, 650), "train_2": (0, 650), "test_2": (650, 975), "train_3": (0, 975), "test_3": (975, 1300),
    }


def test_combinations_of_a_cell():
    """Every combination belongs to one cell, with the places of its multipliers; repeated lengths count twice."""
    strategy = REGISTRY.get("v5")
    grid = strategy.grid(
        regime_ema_len=[9, 5, 9], atr_period=[7, 3], atr_mult_low_vol=[2.0, 0.0, 1.0], atr_mult_high_vol=[2.5, 2.0],
        vol_regime_lookback=[4], vol_regime_threshold=[0.5, 0.25, 0.75], regime_band=[0.0, 0.1],
    )
    cells, stops, seen = cells_of(grid), stops_of(grid), []
    assert stops == {"atr_mult_low_vol": [1.0, 2.0], "atr_mult_high_vol": [2.0, 2.5]}
    for length in (5, 9):
        for band_i in range(2):
            for cell in range(cells.size()):
                numbers, places = combinations(grid, length, band_i, cell)
                seen += numbers.tolist()
                for i, *place in zip(numbers.tolist(), *places, strict=True):
                    row = grid.row(i)
                    assert row["regime_ema_len"] == length and row["regime_band"] == grid.values["regime_band"][band_i]
                    assert {n: row[n] for n in cells.row(cell)} == cells.row(cell)
                    for j, (name, many) in zip(place, stops.items(), strict=True):
                        assert (many[j] if j < len(many) else 0.0) == row[name]
    assert sorted(seen) == list(range(grid.size()))
