"""Equity curves, drawdown and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.positions import TRADE_EPS
from tidemark.operators.scan import Series

MIN_EQUITY = 1e-12


def compound(
    df: DataFrame, series: Series, growth: Column, start: Column | float, name: str, idx: str = "bar_idx"
) -> DataFrame:
    """Compound ``growth`` from ``start`` with a floor of 1e-12 into the column ``name``."""
    return compound_all(df, series, {name: (growth, start)}, idx)


def compound_all(
    df: DataFrame, series: Series, curves: dict[str, tuple[Column, Column | float]], idx: str = "bar_idx"
) -> DataFrame:
    """Compound several growths (``name=(growth, start)``) side by side, with a floor of 1e-12 each.

    The first bar takes no growth.  A growth that is not finite or not above zero puts the curve on the floor,
    from where it compounds on.  With P the running product since the last such bar, the floored curve is
    P * max(start, floor * running max of 1/P).  Logarithms of P take over where P leaves the range of a double.
    """
    names = list(enumerate(curves))
    df = df.withColumns({f"_x{i}": curves[n][0] for i, n in names})
    df = df.withColumns({f"_start{i}": (F.lit(s) if isinstance(s := curves[n][1], float) else s).cast("double") for i, n in names})
    fine = "_x{0} > 0 AND _x{0} < double('Infinity')"  # false for NaN, which sorts above infinity
    flags = [f"{idx} > 0 AND NOT coalesce({fine}, false) AS _bad{{0}}", f"CASE WHEN {idx} > 0 AND {fine} THEN _x{{0}} ELSE 1.0D END AS _g{{0}}"]
    df = df.selectExpr("*", *[f.format(i) for i, _ in names for f in flags])
    products = {f"_p{i}": ("product", F.col(f"_g{i}")) for i, _ in names}
    df = series.sweep(df, running=products | {f"_l{i}": ("sum", F.expr(f"ln(_g{i})")) for i, _ in names})
    reset = f"CASE WHEN _bad{{0}} THEN named_struct('at', {idx}, 'p', _p{{0}}, 'l', _l{{0}}) END"
    df = series.sweep(df, running={f"_r{i}": ("last", F.expr(reset.format(i))) for i, _ in names})
    best = "named_struct('s', coalesce(_r{0}.at, -1L), 'l', -_l{0}, 'v', try_divide(1.0D, _p{0}))"
    df = series.sweep(df, running={f"_lo{i}": ("max", F.expr(best.format(i))) for i, _ in names})
    floor = f"{MIN_EQUITY!r}D"
    p0, l0, base = "coalesce(_r{0}.p, 1.0D)", "coalesce(_r{0}.l, 0.0D)", f"if(_r{{0}} IS NULL, _start{{0}}, {floor})"
    plain = f"try_divide(_p{{0}}, {p0}) * greatest({base}, {floor} * {p0} * _lo{{0}}.v)"
    logs = f"exp(_l{{0}} - {l0} + greatest(ln(greatest({base}, {floor})), ln({floor}) + {l0} + _lo{{0}}.l))"
    in_range = f"_p{{0}} BETWEEN 1e-200D AND 1e200D AND {p0} BETWEEN 1e-200D AND 1e200D AND _lo{{0}}.v < 1e200D"
    floored = f"greatest({floor}, CASE WHEN {in_range} THEN {plain} ELSE {logs} END)"
    value = f"CASE WHEN {idx} = 0 THEN _start{{0}} ELSE {floored} END"
    helpers = [f"_{h}{i}" for h in ("x", "start", "g", "bad", "p", "l", "r", "lo") for i, _ in names]
    return df.withColumns({n: F.expr(value.format(i)) for i, n in names}).drop(*helpers)


def growth_of(exposure: Column, ret: Column, trade: Column, cost: Column | float) -> Column:
    """One bar's growth after the cost of changing the exposure."""
    return 1.0 + exposure * ret - trade * cost


def equity_curves(df: DataFrame, series: Series, cost: Column | float, hold: bool = True, floor_start: bool = True) -> DataFrame:
    """Strategy curve from 1.0 and, if wanted, the buy-and-hold curve; needs ``pos_open``, ``ret_oo`` and ``trade``.

    Buy-and-hold starts from ``1 - cost``; its start is floored except for the moving-average rule.
    """
    curves = {"equity": (growth_of(F.col("pos_open"), F.col("ret_oo"), F.col("trade"), cost), 1.0)}
    if hold:
        first = 1.0 - (F.lit(cost) if isinstance(cost, float) else cost)
        curves["equity_bh"] = (1.0 + F.col("ret_oo"), F.greatest(F.lit(MIN_EQUITY), first) if floor_start else first)
    return compound_all(df, series, curves)


def drawdown(df: DataFrame, series: Series, value: str = "equity") -> DataFrame:
    """Distance of the curve from its running peak, as a number of zero or less."""
    df = series.running(df, _peak=("max", F.col(value)))
    return df.withColumn("drawdown", F.col(value) / F.col("_peak") - 1.0).drop("_peak")


def years_between(first: Column, last: Column) -> Column:
    """Whole elapsed days over 365.25, at least one day."""
    days = F.floor((F.unix_micros(last) - F.unix_micros(first)) / 86_400_000_000)
    return F.greatest(F.lit(1.0 / 365.25), days / 365.25)


def cagr(final: Column, first: Column, last: Column) -> Column:
    """Yearly growth rate."""
    return F.pow(final, 1.0 / years_between(first, last)) - 1.0


def calmar(cagr_: Column, mdd: Column) -> Column:
    """Yearly growth over drawdown; undefined without drawdown."""
    return F.when(mdd != 0, cagr_ / F.abs(mdd))


def trade_count(rounded_sum: bool = False) -> Column:
    """Executions: bars with turnover, or the rounded turnover for the moving-average rule."""
    if rounded_sum:
        return F.coalesce(F.rint(F.sum("trade")).cast("bigint"), F.lit(0))
    return F.count_if(F.col("trade") > TRADE_EPS)


def with_metrics(df: DataFrame) -> DataFrame:
    """Add yearly growth and the growth/drawdown ratio to rows with final equity, drawdown and range."""
    df = df.withColumn("cagr", cagr(F.col("final_equity"), F.col("first_ts"), F.col("last_ts")))
    return df.withColumn("calmar", calmar(F.col("cagr"), F.col("mdd")))


def summarize(df: DataFrame, keys: list[str], rounded_sum: bool = False) -> DataFrame:
    """One row per run: final values, growth, drawdown, trades, range.  Needs drawdown, equity and equity_bh."""
    out = df.groupBy(*keys).agg(
        F.max_by("equity", "bar_idx").alias("final_equity"),
        F.max_by("equity_bh", "bar_idx").alias("final_equity_bh"),
        F.min("drawdown").alias("mdd"),
        trade_count(rounded_sum).alias("trades"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    text = F.concat_ws(" -> ", F.col("first_ts").cast("string"), F.col("last_ts").cast("string"))
    return with_metrics(out).withColumn("range", text)
