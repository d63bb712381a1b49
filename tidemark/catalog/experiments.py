"""Queries over strategy runs: bar rows, summaries, grids, hold-out and walk-forward runs.

The SQL evaluates each combination bar by bar in a recursive query and shares nothing with the window forms.
"""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from tidemark.catalog.base import CANDLES, candles, day, query, r
from tidemark.operators.positions import trade_markers
from tidemark.plans import reports
from tidemark.plans.experiment import evaluate_grid, holdout, panel, refused_markets, run_summary, search, top_k, walkforward, with_returns
from tidemark.plans.strategies import REGISTRY, Run, backtest

COST = 0.0005 + 0.0002
_TREND = {"regime_ema_len": [10, 20], "atr_period": [14], "regime_band": [0.005, 0.01]}
GRIDS: dict[str, dict[str, list]] = {
    "v1": {"rsi_buy": [55.0, 65.0], "ma_len": [10, 20], "ma_slope_days": [1, 3]},
    "v2": _TREND | {"atr_trail_multiplier": [2.0, 3.0]},
    "v3": _TREND | {"atr_trail_multiplier": [2.0], "vol_target": [0.01, 0.03], "max_leverage": [1.5], "min_exposure": [0.0]},
    "v4": _TREND | {"atr_trail_multiplier": [2.0, 3.0], "weekly_ema_len": [5, 10]},
    "v5": _TREND
    | {
        "atr_mult_low_vol": [2.0],
        "atr_mult_high_vol": [3.0],
        "vol_regime_lookback": [20],
        "vol_regime_threshold": [0.6, 0.8],
    },
}
ONE = {v: {k: x[-1:] for k, x in g.items()} for v, g in GRIDS.items()}
WHOLE = f"""{CANDLES.replace('bars AS', 'numbered AS')},
bars AS (SELECT market, 'all' AS seg, idx, n, ts, open, high, low, close, pc, nopen FROM numbered)"""
HOLDOUT = f"""{CANDLES.replace('bars AS', 'numbered AS')},
cut AS (SELECT market, n, least(n - 2, greatest(2, CAST(floor(n * 0.7) AS BIGINT))) AS edge FROM numbered WHERE n >= 4 GROUP BY ALL),
spans AS (SELECT market, unnest(['validation', 'test', 'full']) AS seg, unnest([0, edge, 0]) AS lo, unnest([edge, n, n]) AS hi FROM cut)"""
FORWARD = f"""{CANDLES.replace('bars AS', 'numbered AS')},
cut AS (SELECT market, n, greatest(50, n // 4) AS size, i FROM numbered, range(1, 4) t(i) GROUP BY ALL),
fit AS (SELECT *, size * i AS edge, least(n, size * (i + 1)) AS stop FROM cut WHERE size * i >= 300 AND least(n, size * (i + 1)) - size * i >= 30),
spans AS (SELECT market, unnest(['train_' || i, 'test_' || i]) AS seg, unnest([0, edge]) AS lo, unnest([edge, stop]) AS hi FROM fit)"""
SLICED = """
bars AS (
  SELECT b.market, s.seg, b.idx - s.lo AS idx, s.hi - s.lo AS n, b.ts, open, high, low, close,
    CASE WHEN b.idx > s.lo THEN pc END AS pc, CASE WHEN b.idx < s.hi - 1 THEN nopen END AS nopen
  FROM numbered b JOIN spans s ON s.market = b.market AND b.idx >= s.lo AND b.idx < s.hi)"""


def _axis_rows(version: str, values: dict[str, list]) -> tuple[list[str], str]:
    names = [a.name for a in REGISTRY.get(version).axes]
    combos = itertools.product(*[values[n] for n in names])
    rows = ", ".join(
        f"({i}::BIGINT, " + ", ".join(f"{v}::DOUBLE" if isinstance(v, float) else str(v) for v in c) + ")" for i, c in enumerate(combos)
    )
    return names, f"p(param_id, {', '.join(names)}) AS (VALUES {rows})"


def _average(name: str, source: str, x: str, lens: list[int], alpha: str) -> str:
    """Recursive seeded average for several lengths."""
    values = ", ".join(f"({n})" for n in lens)
    return f"""
{name} AS (
  SELECT s.market, s.seg, t.len, CAST(t.len - 1 AS BIGINT) AS idx, avg(s.{x}) AS v
  FROM {source} s, (VALUES {values}) t(len) WHERE s.idx < t.len AND s.n >= t.len GROUP BY s.market, s.seg, t.len
  UNION ALL
  SELECT s.market, s.seg, e.len, s.idx, {alpha} * s.{x} + (1 - {alpha}) * e.v
  FROM {name} e JOIN {source} s ON s.market = e.market AND s.seg = e.seg AND s.idx = e.idx + 1)"""


def simulation(version: str, values: dict[str, list]) -> str:
    """CTEs up to ``sim``: one row per (market, seg, param_id, bar) with position and curves."""
    names, params = _axis_rows(version, values)
    if version == "v1":
        lens = sorted(set(values["ma_len"]))
        mas = " UNION ALL ".join(
            f"SELECT market, seg, idx, {n} AS len, CASE WHEN idx >= {n - 1} THEN avg(close) OVER (PARTITION BY market, seg "
            f"ORDER BY idx ROWS {n - 1} PRECEDING) END AS ma FROM bars"
            for n in lens
        )
        return f"""{params},
moves AS (SELECT market, seg, idx - 1 AS idx, n - 1 AS n, greatest(close - pc, 0) AS gain, greatest(pc - close, 0) AS loss FROM bars WHERE idx > 0),
{_average('ag', 'moves', 'gain', [14], '(1.0 / 14)')}, {_average('al', 'moves', 'loss', [14], '(1.0 / 14)')},
ma AS ({mas}),
ind AS (
  SELECT p.param_id, b.*, coalesce(nopen / open - 1, 0) AS ret, ma.ma,
    CASE WHEN al.v <> 0 THEN 100 - 100 / (1 + ag.v / al.v) END AS rsi, coalesce(ma.ma > m2.ma, false) AS up, p.rsi_buy
  FROM bars b CROSS JOIN p
  JOIN ma ON ma.market = b.market AND ma.seg = b.seg AND ma.idx = b.idx AND ma.len = p.ma_len
  LEFT JOIN ma m2 ON m2.market = b.market AND m2.seg = b.seg AND m2.idx = b.idx - p.ma_slope_days AND m2.len = p.ma_len
  LEFT JOIN ag ON ag.market = b.market AND ag.seg = b.seg AND ag.idx = b.idx - 1
  LEFT JOIN al ON al.market = b.market AND al.seg = b.seg AND al.idx = b.idx - 1),
sim AS (
  SELECT market, seg, param_id, idx, ts, 0.0::DOUBLE AS pos, CASE WHEN ma IS NULL OR rsi IS NULL OR close < ma THEN 0.0
      WHEN close > ma AND up AND rsi < rsi_buy THEN 1.0 ELSE 0.0 END::DOUBLE AS target,
    0.0::DOUBLE AS trade, 1.0::DOUBLE AS equity, 1.0::DOUBLE - {COST} AS bh FROM ind WHERE idx = 0
  UNION ALL
  SELECT d.market, d.seg, d.param_id, d.idx, d.ts, s.target, CASE WHEN d.ma IS NULL OR d.rsi IS NULL OR d.close < d.ma THEN 0.0
      WHEN d.close > d.ma AND d.up AND d.rsi < d.rsi_buy THEN 1.0 ELSE s.target END::DOUBLE,
    abs(s.target - s.pos), greatest(1e-12::DOUBLE, s.equity * (1 + s.target * d.ret - abs(s.target - s.pos) * {COST})),
    greatest(1e-12::DOUBLE, s.bh * (1 + d.ret))
  FROM sim s JOIN ind d ON d.market = s.market AND d.seg = s.seg AND d.param_id = s.param_id AND d.idx = s.idx + 1)"""
    extra, join, mult, allowed = "", "", "p.atr_trail_multiplier", "true"
    if version == "v5":
        looks = ", ".join(f"({n})" for n in sorted(set(values["vol_regime_lookback"])))
        extra = f""",
ratio AS (SELECT b.market, b.seg, b.idx, a.len, a.v / b.close AS x FROM bars b JOIN atr a USING (market, seg, idx)),
ranked AS (SELECT a.market, a.seg, a.idx, a.len, t.lb, count(*) FILTER (c.x <= a.x) * 1.0 / count(*) AS rank
  FROM ratio a CROSS JOIN (VALUES {looks}) t(lb) JOIN ratio c ON c.market = a.market AND c.seg = a.seg AND c.len = a.len
    AND c.idx > a.idx - t.lb AND c.idx <= a.idx GROUP BY ALL)"""
        join = """LEFT JOIN ranked k ON k.market = b.market AND k.seg = b.seg AND k.idx = b.idx AND k.len = p.atr_period
    AND k.lb = p.vol_regime_lookback"""
        mult = "CASE WHEN coalesce(k.rank >= p.vol_regime_threshold, false) THEN p.atr_mult_high_vol ELSE p.atr_mult_low_vol END"
    if version == "v4":
        lens = sorted(set(values["weekly_ema_len"]))
        extra = f""",
days AS (SELECT market, seg, idx, ts, close, isoyear(ts) AS y, week(ts) AS w FROM bars),
weeks AS (SELECT market, seg, y, w, arg_max(close, ts) AS wc, row_number() OVER (PARTITION BY market, seg ORDER BY y, w) - 1 AS idx,
  count(*) OVER (PARTITION BY market, seg) AS n FROM days GROUP BY market, seg, y, w),
{_average('wema', 'weeks', 'wc', lens, '(2.0 / (e.len + 1))')},
good AS (SELECT d.market, d.seg, d.idx, e.len, w.wc >= e.v AS ok FROM days d JOIN weeks w USING (market, seg, y, w)
  JOIN wema e ON e.market = w.market AND e.seg = w.seg AND e.idx = w.idx)"""
        join = "LEFT JOIN good g ON g.market = b.market AND g.seg = b.seg AND g.idx = b.idx AND g.len = p.weekly_ema_len"
        allowed = "coalesce(g.ok, false)"
    if version == "v3":
        want = """CASE WHEN a.v / b.close > 0 THEN greatest(coalesce(p.min_exposure, 0), least(p.max_leverage, p.vol_target / (a.v / b.close)))
      ELSE coalesce(p.min_exposure, 0) END"""
        nxt = "CASE WHEN reg = 'BULL' AND NOT hit AND (buy OR pos > 0) THEN want ELSE 0.0 END"
    else:
        want = "1.0"
        nxt = "CASE WHEN hit OR (pos > 0 AND preg = 'BULL' AND reg = 'BEAR') THEN 0.0 WHEN buy THEN 1.0 ELSE pos END"
    lens, pers = sorted(set(values["regime_ema_len"])), sorted(set(values["atr_period"]))
    return f"""{params},
tr AS (SELECT market, seg, idx, n, CASE WHEN idx = 0 THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM bars),
{_average('ema', 'bars', 'close', lens, '(2.0 / (e.len + 1))')}, {_average('atr', 'tr', 'tr', pers, '(1.0 / e.len)')}{extra},
ind AS (
  SELECT p.param_id, b.market, b.seg, b.idx, b.ts, b.close, coalesce(nopen / open - 1, 0) AS ret, e.v AS anchor, a.v AS atr,
    e.v * (1.0 + p.regime_band) AS upper, e.v * (1.0 - p.regime_band) AS lower, ({mult})::DOUBLE AS mult, {allowed} AS allowed,
    ({want})::DOUBLE AS want
  FROM bars b CROSS JOIN p
  LEFT JOIN ema e ON e.market = b.market AND e.seg = b.seg AND e.idx = b.idx AND e.len = p.regime_ema_len
  LEFT JOIN atr a ON a.market = b.market AND a.seg = b.seg AND a.idx = b.idx AND a.len = p.atr_period
  {join}),
sim AS (
  SELECT market, seg, param_id, idx, ts, CAST('UNKNOWN' AS VARCHAR) AS reg, 0.0::DOUBLE AS pos, 0.0::DOUBLE AS target,
    NULL::DOUBLE AS high, NULL::DOUBLE AS stop, false AS hit, 0.0::DOUBLE AS trade, 1.0::DOUBLE AS equity,
    greatest(1e-12::DOUBLE, 1.0 - {COST}) AS bh FROM ind WHERE idx = 0
  UNION ALL
  SELECT market, seg, param_id, idx, ts, reg, pos, ({nxt})::DOUBLE, high, stop, hit, trade,
    CASE WHEN g > 0 THEN greatest(1e-12::DOUBLE, eq * g) ELSE 1e-12::DOUBLE END,
    CASE WHEN 1 + ret > 0 THEN greatest(1e-12::DOUBLE, hold * (1 + ret)) ELSE 1e-12::DOUBLE END
  FROM (
    SELECT *, coalesce(close <= stop, false) AS hit, preg = 'BEAR' AND reg = 'BULL' AND allowed AS buy, 1 + pos * ret - trade * {COST} AS g
    FROM (
      SELECT *, CASE WHEN mult > 0 AND pos > 0 THEN high - mult * atr END AS stop FROM (
        SELECT d.*, s.target AS pos, s.reg AS preg, abs(s.target - s.pos) AS trade, s.equity AS eq, s.bh AS hold,
          CASE WHEN s.target > s.pos THEN d.close WHEN s.target > 0 THEN greatest(s.high, d.close) END AS high,
          CASE WHEN d.anchor IS NULL THEN 'UNKNOWN' WHEN d.close > d.upper THEN 'BULL' WHEN d.close < d.lower THEN 'BEAR'
            WHEN s.reg <> 'UNKNOWN' THEN s.reg WHEN d.close > d.anchor THEN 'BULL' WHEN d.close < d.anchor THEN 'BEAR'
            ELSE 'UNKNOWN' END AS reg
        FROM sim s JOIN ind d ON d.market = s.market AND d.seg = s.seg AND d.param_id = s.param_id AND d.idx = s.idx + 1))))"""


def scores_cte(version: str, where: str = "true") -> str:
    """CTEs after ``sim``: drawdown and one score row per (market, seg, param_id)."""
    trades = "CAST(round(sum(trade)) AS BIGINT)" if version == "v1" else "count(*) FILTER (trade > 1e-12)"
    return f"""
dd AS (SELECT *, equity / max(equity) OVER (PARTITION BY market, seg, param_id ORDER BY idx) - 1 AS drawdown FROM sim WHERE {where}),
sums AS (SELECT market, seg, param_id, arg_max(equity, idx) AS final_equity, arg_max(bh, idx) AS final_equity_bh, min(drawdown) AS mdd,
  {trades} AS trades, min(ts) AS a, max(ts) AS z FROM dd GROUP BY ALL),
rated AS (SELECT *, pow(final_equity, 1 / greatest(1 / 365.25, (epoch(z) - epoch(a)) // 86400 / 365.25)) - 1 AS cagr FROM sums),
scores AS (SELECT *, CASE WHEN mdd <> 0 THEN cagr / abs(mdd) END AS calmar FROM rated)"""


def ranked_cte(keys: str, where: str) -> str:
    return f"""
ranked_scores AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY coalesce(calmar, '-inf'::DOUBLE) DESC, cagr DESC,
  final_equity DESC, param_id) AS rank FROM scores WHERE {where})"""


SCORE_SQL = """round(final_equity, 6) + 0.0 AS final_equity, round(mdd, 6) + 0.0 AS mdd, trades, round(cagr, 6) + 0.0 AS cagr,
    round(calmar, 5) + 0.0 AS calmar"""


def score_cols():
    return [r("final_equity").alias("final_equity"), r("mdd").alias("mdd"), "trades", r("cagr").alias("cagr"), r("calmar", 5).alias("calmar")]


def _rows(version, spark, sf):
    bars, s = panel(candles(spark, sf))
    bars, s = with_returns(bars, s)
    return backtest(REGISTRY.get(version), Run(bars, s, REGISTRY.get(version).grid(**ONE[version])))


def _register(version: str) -> None:
    strategy = REGISTRY.get(version)
    names = [a.name for a in strategy.axes]
    run_sql = f"WITH RECURSIVE {WHOLE}, {simulation(version, ONE[version])}, {scores_cte(version)}"

    @query(
        f"backtest_{version}",
        f"""{run_sql} SELECT market, idx AS bar_idx, round(pos, 6) + 0.0 AS pos_open, round(trade, 6) + 0.0 AS trade,
        round(equity, 6) + 0.0 AS equity, round(bh, 6) + 0.0 AS equity_bh, round(drawdown, 6) + 0.0 AS drawdown FROM dd""",
    )
    def backtest_rows(spark, sf):
        rows, _ = _rows(version, spark, sf)
        cols = [r(c).alias(c) for c in ("pos_open", "trade", "equity", "equity_bh", "drawdown")]
        return rows.select("market", "bar_idx", *cols)

    @query(
        f"run_summary_{version}",
        f"""{run_sql} SELECT market, {SCORE_SQL}, round(final_equity_bh, 6) + 0.0 AS final_equity_bh,
        strftime(a, '%Y-%m-%d %H:%M:%S') || ' -> ' || strftime(z, '%Y-%m-%d %H:%M:%S') AS "range" FROM scores""",
    )
    def summary(spark, sf):
        bars, s = panel(candles(spark, sf))
        bars, s = with_returns(bars, s)
        out = run_summary(strategy, bars, s, strategy.grid(**ONE[version]))
        return out.select("market", *score_cols(), r("final_equity_bh").alias("final_equity_bh"), "range")

    @query(
        f"grid_search_{version}",
        f"""WITH RECURSIVE {WHOLE}, {simulation(version, GRIDS[version])}, {scores_cte(version)}, {ranked_cte('market', 'true')}
        SELECT market, rank, s.param_id, {', '.join(f'CAST({n} AS DOUBLE) AS {n}' for n in names)}, {SCORE_SQL}
        FROM ranked_scores s JOIN p USING (param_id) WHERE rank <= 5""",
    )
    def grid_search(spark, sf):
        top = search(strategy, candles(spark, sf), strategy.grid(**GRIDS[version]), 5)
        cols = [F.col(n).cast("double").alias(n) for n in names]
        return top.select("market", F.col("rank").cast("bigint").alias("rank"), "param_id", *cols, *score_cols())

    segments = "('validation', 'test')" if version == "v1" else "('validation', 'test', 'full')"

    @query(
        f"holdout_{version}",
        f"""WITH RECURSIVE {HOLDOUT}, {SLICED}, {simulation(version, GRIDS[version])}, {scores_cte(version)},
        {ranked_cte('market', "seg = 'validation'")}
        SELECT s.market, s.seg AS segment, s.param_id, round(s.final_equity, 6) + 0.0 AS final_equity, round(s.mdd, 6) + 0.0 AS mdd, s.trades,
        round(s.cagr, 6) + 0.0 AS cagr, round(s.calmar, 5) + 0.0 AS calmar, round(s.final_equity_bh, 6) + 0.0 AS final_equity_bh
        FROM scores s JOIN ranked_scores b ON b.market = s.market AND b.param_id = s.param_id AND b.rank = 1 WHERE s.seg IN {segments}""",
    )
    def holdout_query(spark, sf):
        out = holdout(strategy, candles(spark, sf), strategy.grid(**GRIDS[version]))
        return out.select("market", "segment", "param_id", *score_cols(), r("final_equity_bh").alias("final_equity_bh"))


for _version in REGISTRY.versions():
    _register(_version)


# Names of the SQL tables per version are made unique, as one query holds two versions.
WF_VERSIONS = ["v2", "v5"]


def _forward_sql(version: str) -> str:
    return f"""WITH RECURSIVE {FORWARD}, {SLICED}, {simulation(version, GRIDS[version])}, {scores_cte(version)},
    {ranked_cte('market, seg', "seg LIKE 'train%'")}
    SELECT '{version}' AS version, s.market, CAST(replace(s.seg, 'test_', '') AS INTEGER) AS split, s.param_id, s.final_equity, s.final_equity_bh,
      s.mdd, s.trades, s.cagr, s.calmar
    FROM scores s JOIN ranked_scores b ON b.market = s.market AND b.seg = replace(s.seg, 'test', 'train') AND b.param_id = s.param_id AND b.rank = 1
    WHERE s.seg LIKE 'test%'"""


WF_SQL = " UNION ALL ".join(f"SELECT * FROM ({_forward_sql(v)})" for v in WF_VERSIONS)


def _forward(spark, sf):
    runs = [walkforward(REGISTRY.get(v), candles(spark, sf), REGISTRY.get(v).grid(**GRIDS[v])) for v in WF_VERSIONS]
    return reports.concat_versions(*runs)


@query(
    "walkforward_runs",
    f"""SELECT version, market, split, param_id, {SCORE_SQL}, round(final_equity_bh, 6) + 0.0 AS final_equity_bh FROM ({WF_SQL})""",
)
def walkforward_runs(spark, sf):
    return _forward(spark, sf).select(
        "version", "market", "split", "param_id", *score_cols(), r("final_equity_bh").alias("final_equity_bh")
    )


@query(
    "walkforward_means",
    f"""SELECT version, round(avg(cagr), 6) AS mean_cagr, round(avg(mdd), 6) AS mean_mdd, round(avg(calmar), 5) AS mean_calmar,
    round(avg(final_equity), 6) AS mean_final_equity, round(avg(trades), 6) AS mean_trades, count(*) AS runs FROM ({WF_SQL}) GROUP BY 1""",
)
def walkforward_means(spark, sf):
    out = reports.walkforward_means(_forward(spark, sf))
    cols = [r(f"mean_{c}", 5 if c == "calmar" else 6).alias(f"mean_{c}") for c in ("cagr", "mdd", "calmar", "final_equity", "trades")]
    return out.select("version", *cols, "runs")


@query(
    "walkforward_stability",
    f"""SELECT version, market, round(avg(final_equity / final_equity_bh), 6) AS mean_vs_hold, round(stddev_samp(cagr), 6) AS sd_cagr,
    round(stddev_samp(final_equity), 6) AS sd_equity, round(min(mdd), 6) AS worst_mdd FROM ({WF_SQL}) GROUP BY 1, 2""",
)
def walkforward_stability(spark, sf):
    out = reports.stability(_forward(spark, sf))
    return out.select("version", "market", *[r(c).alias(c) for c in ("mean_vs_hold", "sd_cagr", "sd_equity", "worst_mdd")])


HOLDOUT_SQL = f"""WITH RECURSIVE {HOLDOUT}, {SLICED}, {simulation('v2', GRIDS['v2'])}, {scores_cte('v2')},
{ranked_cte('market', "seg = 'validation'")},
best AS (SELECT s.* FROM scores s JOIN ranked_scores b ON b.market = s.market AND b.param_id = s.param_id AND b.rank = 1)"""


def _v2_holdout(spark, sf):
    return holdout(REGISTRY.get("v2"), candles(spark, sf), REGISTRY.get("v2").grid(**GRIDS["v2"]))


@query(
    "validation_gap",
    f"""{HOLDOUT_SQL} SELECT market, round(t.cagr - v.cagr, 6) + 0.0 AS cagr_gap, round(t.mdd - v.mdd, 6) + 0.0 AS mdd_gap,
    round(t.final_equity / t.final_equity_bh, 6) AS test_vs_hold FROM best t JOIN best v USING (market)
    WHERE t.seg = 'test' AND v.seg = 'validation'""",
)
def validation_gap(spark, sf):
    out = reports.validation_gap(_v2_holdout(spark, sf))
    return out.select("market", *[r(c).alias(c) for c in ("cagr_gap", "mdd_gap", "test_vs_hold")])


@query(
    "summary_table",
    f"""{HOLDOUT_SQL} SELECT market || '_' || seg AS run, printf('%.4f', final_equity) AS final_equity, printf('%.4f', final_equity_bh) AS final_equity_bh,
    printf('%.2f%%', cagr * 100) AS cagr, printf('%.2f%%', mdd * 100) AS mdd, trades,
    strftime(a, '%Y-%m-%d %H:%M:%S') || ' -> ' || strftime(z, '%Y-%m-%d %H:%M:%S') AS "range" FROM best""",
)
def summary_table(spark, sf):
    return reports.summary_table(_v2_holdout(spark, sf), F.concat_ws("_", "market", "segment"))


@query(
    "refused_markets",
    f"""WITH {CANDLES} SELECT market, count(*) AS n_bars, 'needs 1727 bars, has ' || count(*) AS reason FROM bars GROUP BY 1 HAVING count(*) < 1727""",
)
def refused_markets_query(spark, sf):
    """Markets too short for a hold-out that asks for 1,727 bars."""
    return refused_markets(candles(spark, sf), 1727)


@query(
    "trade_markers",
    f"""WITH RECURSIVE {WHOLE}, {simulation('v5', ONE['v5'])}, m AS (SELECT market, idx, ts, pos, lag(pos) OVER (PARTITION BY market ORDER BY idx) AS before FROM sim)
    SELECT market, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN pos > before THEN 'BUY' ELSE 'SELL' END AS marker FROM m WHERE pos <> before""",
)
def trade_markers_query(spark, sf):
    rows, s = _rows("v5", spark, sf)
    return trade_markers(rows, s).select("market", day().alias("day"), "marker")


@query(
    "trail_stops_v5",
    f"""WITH RECURSIVE {WHOLE}, {simulation('v5', ONE['v5'])} SELECT market, idx AS bar_idx, round(stop, 6) + 0.0 AS atr_trail_stop, hit AS trail_stop_triggered
    FROM sim WHERE pos > 0""",
)
def trail_stops_v5(spark, sf):
    rows, _ = _rows("v5", spark, sf)
    held = rows.where(F.col("pos_open") > 0)
    return held.select("market", "bar_idx", r("atr_trail_stop").alias("atr_trail_stop"), "trail_stop_triggered")


@query(
    "target_exposure_v3",
    f"""WITH RECURSIVE {WHOLE}, {simulation('v3', ONE['v3'])} SELECT market, idx AS bar_idx, round(pos, 6) + 0.0 AS pos_open,
    round(target, 6) + 0.0 AS target_exposure FROM sim WHERE pos > 0 OR target > 0""",
)
def target_exposure_v3(spark, sf):
    rows, _ = _rows("v3", spark, sf)
    live = rows.where((F.col("pos_open") > 0) | (F.col("target_exposure") > 0))
    return live.select("market", "bar_idx", r("pos_open").alias("pos_open"), r("target_exposure").alias("target_exposure"))


@query(
    "best_combination",
    f"""WITH RECURSIVE {WHOLE}, {simulation('v5', GRIDS['v5'])}, {scores_cte('v5')}, {ranked_cte('market', 'true')}
    SELECT market, param_id, round(calmar, 5) + 0.0 AS calmar FROM ranked_scores WHERE rank = 1""",
)
def best_combination(spark, sf):
    strategy = REGISTRY.get("v5")
    bars, s = with_returns(*panel(candles(spark, sf)))
    scores = evaluate_grid(strategy, bars, s, strategy.grid(**GRIDS["v5"]))
    return top_k(scores, ["market"], 1).select("market", "param_id", r("calmar", 5).alias("calmar"))
