"""Strategies that step from bar to bar, against plain loops."""

import pytest
import stepwise
from test_strategies import BARS, frame

from tidemark.plans.experiment import evaluate_grid, holdout, panel, search, walkforward, with_returns
from tidemark.plans.grid import Axis
from tidemark.plans.sequential import PARABOLIC, by_bar, sequential
from tidemark.plans.strategies import Run, Strategy, backtest


def plain_parabolic(rows, p):
    """Exposure at each bar's open."""
    out, now = [], 0.0
    up, stop, extreme, pace = False, rows[0]["high"], rows[0]["low"], p["af_step"]
    for i, b in enumerate(rows):
        out.append(now)
        if i == 0:
            continue
        stop = stop + pace * (extreme - stop)
        if up and b["low"] < stop:
            up, stop, extreme, pace = False, extreme, b["low"], p["af_step"]
        elif not up and b["high"] > stop:
            up, stop, extreme, pace = True, extreme, b["high"], p["af_step"]
        elif up and b["high"] > extreme:
            extreme, pace = b["high"], min(p["af_max"], pace + p["af_step"])
        elif not up and b["low"] < extreme:
            extreme, pace = b["low"], min(p["af_max"], pace + p["af_step"])
        now = 1.0 if up else 0.0
    return out


def measures(rows, at_open, cost=0.0007):
    eq, bh = stepwise.curve("parabolic", rows, at_open, cost)
    peak, mdd = 1.0, 0.0
    for v in eq:
        peak = max(peak, v)
        mdd = min(mdd, v / peak - 1)
    return eq, bh, mdd, sum(abs(b - a) > 1e-12 for a, b in zip(at_open, at_open[1:]))


GRID = PARABOLIC.grid(af_step=[0.01, 0.05], af_max=[0.1, 0.3])


@pytest.mark.parametrize("rows_per_task", [None, 90])
def test_rows_and_scores_equal_a_plain_loop(spark, rows_per_task):
    bars, series = with_returns(*panel(frame(spark), rows_per_task))
    rows, _ = backtest(PARABOLIC, Run(bars, series, GRID))
    got = {}
    for r in rows.select("market", "param_id", "af_step", "bar_idx", "pos_open", "equity", "equity_bh").collect():
        got.setdefault((r.market, r.param_id), []).append(r)
    scores = {(r.market, r.param_id): r for r in evaluate_grid(PARABOLIC, bars, series, GRID).collect()}
    assert len(got) == len(scores) == 3 * GRID.size()
    for (market, i), rs in got.items():
        rs.sort(key=lambda r: r.bar_idx)
        at_open = plain_parabolic(BARS[market], GRID.row(i))
        eq, bh, mdd, trades = measures(BARS[market], at_open)
        assert [r.pos_open for r in rs] == at_open and rs[0].af_step == GRID.row(i)["af_step"]
        assert [r.equity for r in rs] == pytest.approx(eq, rel=1e-9) and [r.equity_bh for r in rs] == pytest.approx(bh, rel=1e-9)
        s = scores[market, i]
        assert (s.trades, s.final_equity, s.mdd) == (trades, pytest.approx(eq[-1], rel=1e-9), pytest.approx(mdd, abs=1e-12))
        assert trades > 0


def best(rows):
    """Number of the best combination, by calmar, growth, final equity."""
    found = []
    years = max(1 / 365.25, (rows[-1]["ts"] - rows[0]["ts"]).days / 365.25)
    for i in range(GRID.size()):
        eq, _, mdd, _ = measures(rows, plain_parabolic(rows, GRID.row(i)))
        growth = eq[-1] ** (1 / years) - 1
        found.append((-(growth / abs(mdd)) if mdd else float("inf"), -growth, -eq[-1], i))
    return min(found)[-1]


def test_search_holdout_and_walkforward(spark):
    for r in search(PARABOLIC, frame(spark), GRID, 1).collect():
        assert r.param_id == best(BARS[r.market])
    for r in holdout(PARABOLIC, frame(spark), GRID).collect():
        rows = BARS[r.market]
        cut = min(len(rows) - 2, max(2, int(len(rows) * 0.7)))
        part = {"validation": rows[:cut], "test": rows[cut:], "full": rows}[r.segment]
        eq, bh, mdd, trades = measures(part, plain_parabolic(part, GRID.row(r.param_id)))
        assert r.param_id == best(rows[:cut]) and r.trades == trades
        assert r.final_equity == pytest.approx(eq[-1], rel=1e-9) and r.mdd == pytest.approx(mdd, abs=1e-12)
    out = walkforward(PARABOLIC, frame(spark), GRID, 2, min_train=60, min_test=30).collect()
    for r in out:
        rows = BARS[r.market]
        size = max(50, len(rows) // 3)
        assert r.param_id == best(rows[: size * r.split])
        test = rows[size * r.split : size * (r.split + 1)]
        assert r.final_equity == pytest.approx(measures(test, plain_parabolic(test, GRID.row(r.param_id)))[0][-1], rel=1e-9)
    assert len(out) >= 3


@pytest.mark.parametrize("memory", [None, 5])
def test_blocks_are_handed_the_bars_they_depend_on(spark, memory):
    def step_of_five(state, bar, params):
        """Exposure from the last five closes only."""
        state = (state + [bar["close"]])[-5:]
        return state, params["gain"] * (sum(c < state[-1] for c in state) / 5) ** 2

    strategy = Strategy("five", (Axis("gain", "double"),), sequential(by_bar(lambda p: [], step_of_five), ("close",), memory), lambda p: 5)
    grid = strategy.grid(gain=[0.5, 1.0])
    want = {}
    for market, rows in BARS.items():
        for i, gain in enumerate((0.5, 1.0)):
            state, now = [], 0.0
            for k, b in enumerate(rows):
                want[market, i, k] = now
                state, now = step_of_five(state, b, {"gain": gain})
    bars, series = with_returns(*panel(frame(spark), 40))
    rows, _ = strategy.evaluate(Run(bars, series, grid))
    assert {(r.market, r.param_id, r.bar_idx): r.pos_open for r in rows.collect()} == want


def test_many_batches_and_wrong_answers(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        bars, series = with_returns(*panel(frame(spark)))
        for market, rows in BARS.items():
            got, _ = backtest(PARABOLIC, Run(bars.where(bars.market == market), series, PARABOLIC.grid(af_step=0.02, af_max=0.2)))
            at_open = [r.pos_open for r in got.orderBy("bar_idx").collect()]
            assert at_open == plain_parabolic(rows, {"af_step": 0.02, "af_max": 0.2})
        for bad in (lambda p: lambda b: [0.0], lambda p: lambda b: [float("nan")] * b.num_rows):
            with pytest.raises(Exception, match="one finite exposure"):
                sequential(bad)(Run(bars, series, PARABOLIC.grid(af_step=0.02, af_max=0.2)))[0].collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
