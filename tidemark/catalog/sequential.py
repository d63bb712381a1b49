"""Queries over a strategy whose rule is code that goes from bar to bar; the SQL steps bar by bar as well."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from tidemark.catalog.base import CANDLES, candles, day, query, r, table
from tidemark.catalog.experiments import COST, FORWARD, HOLDOUT, SCORE_SQL, SLICED, WHOLE, ranked_cte, score_cols, scores_cte
from tidemark.plans.experiment import holdout, panel, search, walkforward, with_returns
from tidemark.plans.sequential import PARABOLIC, decisions
from tidemark.plans.strategies import Run, backtest

VALUES: dict[str, list] = {"af_step": [0.01, 0.02, 0.03], "af_max": [0.1, 0.2]}
ONE = {"af_step": [0.02], "af_max": [0.2]}
NEWEST = 400


def simulation(values: dict[str, list]) -> str:
    """CTEs up to ``sim``: one row per (market, seg, param_id, bar) with stop, position and curves."""
    rows = ", ".join(f"({i}::BIGINT, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(itertools.product(*values.values())))
    cross = "CASE WHEN up THEN low < sar ELSE high > sar END"
    return f"""p(param_id, af_step, af_max) AS (VALUES {rows}),
ind AS (SELECT p.*, b.*, coalesce(nopen / open - 1, 0) AS ret FROM bars b CROSS JOIN p),
sim AS (
  SELECT market, seg, param_id, idx, ts, false AS up, high AS sar, low AS ep, af_step AS af, 0.0::DOUBLE AS pos, 0.0::DOUBLE AS target,
    0.0::DOUBLE AS trade, 1.0::DOUBLE AS equity, greatest(1e-12::DOUBLE, 1.0 - {COST}) AS bh FROM ind WHERE idx = 0
  UNION ALL
  SELECT market, seg, param_id, idx, ts, turn <> up, CASE WHEN turn THEN ep ELSE sar END,
    CASE WHEN turn THEN CASE WHEN up THEN low ELSE high END WHEN up THEN greatest(ep, high) ELSE least(ep, low) END,
    CASE WHEN turn THEN af_step WHEN CASE WHEN up THEN high > ep ELSE low < ep END THEN least(af_max, af + af_step) ELSE af END,
    pos, CASE WHEN turn <> up THEN 1.0 ELSE 0.0 END::DOUBLE, trade,
    CASE WHEN g > 0 THEN greatest(1e-12::DOUBLE, eq * g) ELSE 1e-12::DOUBLE END,
    CASE WHEN 1 + ret > 0 THEN greatest(1e-12::DOUBLE, hold * (1 + ret)) ELSE 1e-12::DOUBLE END
  FROM (
    SELECT *, {cross} AS turn, 1 + pos * ret - trade * {COST} AS g FROM (
      SELECT d.*, s.up, s.sar + s.af * (s.ep - s.sar) AS sar, s.ep, s.af, s.target AS pos, abs(s.target - s.pos) AS trade,
        s.equity AS eq, s.bh AS hold
      FROM sim s JOIN ind d ON d.market = s.market AND d.seg = s.seg AND d.param_id = s.param_id AND d.idx = s.idx + 1)))"""


@query(
    "backtest_parabolic",
    f"""WITH RECURSIVE {WHOLE}, {simulation(ONE)}, {scores_cte('parabolic')} SELECT market, idx AS bar_idx, pos AS pos_open, target AS target_exposure,
    round(equity, 6) + 0.0 AS equity, round(bh, 6) + 0.0 AS equity_bh, round(drawdown, 6) + 0.0 AS drawdown FROM dd""",
)
def backtest_parabolic(spark, sf):
    bars, s = with_returns(*panel(candles(spark, sf)))
    rows, _ = backtest(PARABOLIC, Run(bars, s, PARABOLIC.grid(**ONE)))
    return rows.select("market", "bar_idx", "pos_open", "target_exposure", *[r(c).alias(c) for c in ("equity", "equity_bh", "drawdown")])


@query(
    "grid_search_parabolic",
    f"""WITH RECURSIVE {WHOLE}, {simulation(VALUES)}, {scores_cte('parabolic')}, {ranked_cte('market', 'true')}
    SELECT market, rank, s.param_id, af_step, af_max, {SCORE_SQL} FROM ranked_scores s JOIN p USING (param_id) WHERE rank <= 3""",
)
def grid_search_parabolic(spark, sf):
    top = search(PARABOLIC, candles(spark, sf), PARABOLIC.grid(**VALUES), 3)
    return top.select("market", F.col("rank").cast("bigint").alias("rank"), "param_id", "af_step", "af_max", *score_cols())


@query(
    "holdout_parabolic",
    f"""WITH RECURSIVE {HOLDOUT}, {SLICED}, {simulation(VALUES)}, {scores_cte('parabolic')}, {ranked_cte('market', "seg = 'validation'")}
    SELECT s.market, s.seg AS segment, s.param_id, round(s.final_equity, 6) + 0.0 AS final_equity, round(s.mdd, 6) + 0.0 AS mdd, s.trades,
    round(s.cagr, 6) + 0.0 AS cagr, round(s.calmar, 5) + 0.0 AS calmar, round(s.final_equity_bh, 6) + 0.0 AS final_equity_bh
    FROM scores s JOIN ranked_scores b ON b.market = s.market AND b.param_id = s.param_id AND b.rank = 1""",
)
def holdout_parabolic(spark, sf):
    out = holdout(PARABOLIC, candles(spark, sf), PARABOLIC.grid(**VALUES))
    return out.select("market", "segment", "param_id", *score_cols(), r("final_equity_bh").alias("final_equity_bh"))


@query(
    "walkforward_parabolic",
    f"""WITH RECURSIVE {FORWARD}, {SLICED}, {simulation(VALUES)}, {scores_cte('parabolic')}, {ranked_cte('market, seg', "seg LIKE 'train%'")}
    SELECT s.market, CAST(replace(s.seg, 'test_', '') AS INTEGER) AS split, s.param_id, round(s.final_equity, 6) + 0.0 AS final_equity,
    round(s.mdd, 6) + 0.0 AS mdd, s.trades, round(s.cagr, 6) + 0.0 AS cagr, round(s.calmar, 5) + 0.0 AS calmar
    FROM scores s JOIN ranked_scores b ON b.market = s.market AND b.seg = replace(s.seg, 'test', 'train') AND b.param_id = s.param_id AND b.rank = 1
    WHERE s.seg LIKE 'test%'""",
)
def walkforward_parabolic(spark, sf):
    out = walkforward(PARABOLIC, candles(spark, sf), PARABOLIC.grid(**VALUES))
    return out.select("market", "split", "param_id", *score_cols())


@query(
    "decisions_parabolic",
    f"""WITH RECURSIVE {CANDLES.replace('bars AS', 'numbered AS')},
    bars AS (SELECT market, 'all' AS seg, idx - greatest(0, n - {NEWEST}) AS idx, least(n, {NEWEST}) AS n, ts, open, high, low, close, pc, nopen
      FROM numbered WHERE idx >= n - {NEWEST}), {simulation(ONE)},
    held AS (SELECT o_orderpriority AS market, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE -1 END) > 0 AS has FROM orders GROUP BY 1),
    last AS (SELECT market, max(idx) AS idx FROM sim GROUP BY 1)
    SELECT market, strftime(s.ts, '%Y-%m-%d') AS day, round(b.close, 6) AS close, s.target AS target_exposure, h.has AS has_position,
      NOT h.has AND s.target > 0 AS buy_signal, h.has AND s.target = 0 AS sell_signal
    FROM sim s JOIN last USING (market, idx) JOIN bars b USING (market, idx) JOIN held h USING (market)""",
)
def decisions_parabolic(spark, sf):
    step = F.when(F.col("o_orderstatus") == "O", 1).otherwise(-1)
    positions = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("symbol")).agg(F.sum(step).alias("qty"))
    out = decisions(PARABOLIC, candles(spark, sf), positions, PARABOLIC.grid(**ONE), NEWEST)
    return out.select("market", day().alias("day"), r("close").alias("close"), "target_exposure", "has_position", "buy_signal", "sell_signal")
