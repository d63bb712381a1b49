"""One live signal cycle over many markets: history, guard, signal, metrics, event rows, order requests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import escape_label, finite_or_zero
from tidemark.operators import indicators as ind
from tidemark.operators.orders import live_price, unrealized_return_pct
from tidemark.operators.scan import Series
from tidemark.sources.candles import history_size, latest, warmup_rows

# Diagnostics of the adaptive-trail strategy (key, label).
DIAGNOSTICS = [
    ("regime.anchor", "Regime Anchor"),
    ("regime.upper", "Regime Upper Band"),
    ("regime.lower", "Regime Lower Band"),
    ("atr.trail_stop", "ATR Trail Stop"),
]


@dataclass(frozen=True)
class LiveParams:
    """Checked parameters of the live adaptive-trail strategy."""

    regime_ema_len: int = 120
    atr_period: int = 18
    atr_mult_low_vol: float = 2.0
    atr_mult_high_vol: float = 3.0
    vol_regime_lookback: int = 40
    vol_regime_threshold: float = 0.6
    regime_band: float = 0.01

    def __post_init__(self) -> None:
        if min(self.regime_ema_len, self.atr_period, self.vol_regime_lookback) < 1:
            raise ValueError("lengths must be at least 1")
        if min(self.atr_mult_low_vol, self.atr_mult_high_vol) < 0 or self.regime_band < 0:
            raise ValueError("multipliers and band must be >= 0")
        if not 0 < self.vol_regime_threshold <= 1:
            raise ValueError("threshold must be in (0, 1]")

    @property
    def warmup(self) -> int:
        return warmup_rows(self.regime_ema_len, self.atr_period, self.vol_regime_lookback)


def signal_reason(buy: Column, sell: Column, base_buy: Column, base_sell: Column, stopped: Column) -> Column:
    """First reason that applies to a signal bar."""
    return (
        F.when(buy, "BUY_REGIME_TRANSITION")
        .when(sell & base_sell & stopped, "SELL_REGIME_AND_TRAIL_STOP")
        .when(sell & stopped, "SELL_TRAIL_STOP")
        .when(sell, "SELL_REGIME_TRANSITION")
        .when(base_buy, "SETUP_BUY")
        .when(base_sell, "SETUP_SELL")
        .otherwise("NONE")
    )


def live_signals(
    candles: DataFrame,
    positions: DataFrame,
    params: LiveParams,
    candle_count: int = 400,
    closed_only: bool = True,
    allowed: DataFrame | None = None,
) -> DataFrame:
    """Signal of each market on its last (closed) candle, against the position it really holds.

    Only the newest candles of a market are read (400, or warm-up + 2), so windows per market are short.
    ``positions`` has symbol, qty, avg_price, updated_at.  ``allowed`` limits markets to those not blocked.
    """
    rows = latest(candles, history_size(candle_count, params.warmup))
    if allowed is not None:
        rows = rows.join(allowed.select("market"), "market", "left_semi")
    series = Series(("market",), ("ts",))
    rows = ind.index_bars(rows, series)
    rows, long = ind.ema(rows, series, [params.regime_ema_len])
    rows = ind.atr(rows, long, params.atr_period).withColumn("ratio", ind.price_ratio())
    rows = ind.rolling_rank(rows, long, params.vol_regime_lookback)
    rows = ind.regime(rows, long, params.regime_band)
    at = F.col("n_bars") - (2 if closed_only else 1)
    held = positions.select(
        F.col("symbol").alias("market"),
        F.col("qty").cast("double").alias("position_qty"),
        F.col("avg_price").cast("double").alias("position_avg_price"),
        F.to_date("updated_at").alias("_since"),
    )
    rows = rows.where((F.col("bar_idx") <= at) & (at >= 1)).join(held, "market", "left")
    day = F.to_date("ts")
    counted = F.col("_since").isNull() | (day >= F.col("_since"))
    keep = ["ts", "close", "ema", "atr", "vol_rank", "regime", "prev_regime"]
    one = rows.groupBy("market").agg(
        F.max_by(F.struct(*keep), "bar_idx").alias("s"),
        F.max(F.when(counted, F.col("close"))).alias("_high"),
        F.first("position_qty").alias("position_qty"),
        F.first("position_avg_price").alias("position_avg_price"),
    )
    one = one.select("market", *[F.col(f"s.{c}").alias(c) for c in keep], "_high", "position_qty", "position_avg_price")
    has = F.coalesce(F.col("position_qty") > 0, F.lit(False))
    high_vol = ind.is_high(F.col("vol_rank"), params.vol_regime_threshold)
    mult = F.when(high_vol, params.atr_mult_high_vol).otherwise(params.atr_mult_low_vol)
    stop = F.when(has & (mult > 0), F.coalesce("_high", "close") - mult * F.col("atr"))
    one = one.withColumns({"has_position": has, "trail_stop": stop})
    one = one.withColumns(
        {
            "base_buy": ind.buy_turn(),
            "base_sell": F.col("has_position") & ind.bear_turn(),
            "stopped": F.coalesce(F.col("close") <= F.col("trail_stop"), F.lit(False)),
        }
    )
    one = one.withColumns(
        {
            "buy_signal": ~F.col("has_position") & F.col("base_buy"),
            "sell_signal": F.col("has_position") & (F.col("base_sell") | F.col("stopped")),
            **{n: c for n, c in ind.bands(params.regime_band).items()},
        }
    )
    reason = signal_reason(*(F.col(c) for c in ("buy_signal", "sell_signal", "base_buy", "base_sell", "stopped")))
    return one.withColumn("signal_reason", reason).drop("_high").withColumnRenamed("ts", "signal_ts")


def diagnostics(digits: int | None = None) -> Column:
    """Key, label and value (rounded to ``digits`` places if given) of each diagnostic, as an array sorted by key."""
    shown = lambda v: finite_or_zero(F.col(v) if digits is None else F.round(v, digits))
    values = ["ema", "upper", "lower", "trail_stop"]
    cells = [
        F.struct(F.lit(k).alias("key"), F.lit(label).alias("label"), shown(v).alias("value"))
        for (k, label), v in zip(DIAGNOSTICS, values)
    ]
    return F.array_sort(F.array(*cells))


def diagnostic_text(cells: Column) -> Column:
    """``{key=value, …}``."""
    items = F.transform(cells, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return F.concat(F.lit("{"), F.concat_ws(", ", items), F.lit("}"))


def diagnostic_schema(cells: Column) -> Column:
    """``{key:{label="…"}, …}`` with escaped labels."""
    items = F.transform(
        cells, lambda e: F.concat(e["key"], F.lit(':{label="'), escape_label(e["label"]), F.lit('"}'))
    )
    return F.concat(F.lit("{"), F.concat_ws(", ", items), F.lit("}"))


def diagnostic_rows(signals: DataFrame, version: str = "v5") -> DataFrame:
    """One row per market and diagnostic."""
    rows = signals.withColumn("_d", F.explode(diagnostics()))
    return rows.select(
        "market",
        F.lit(version).alias("strategy_version"),
        F.col("signal_ts").alias("ts"),
        "_d.key",
        escape_label(F.col("_d.label")).alias("label"),
        "_d.value",
        "buy_signal",
        "sell_signal",
        "signal_reason",
    )


def candle_signal_rows(signals: DataFrame, metrics: DataFrame, tickers: DataFrame, version: str = "v5", digits: int | None = None) -> DataFrame:
    """Signals with live price, open profit and execution metrics, as the fields of the signal event."""
    rows = signals.join(metrics.withColumnRenamed("symbol", "market"), "market", "left")
    rows = rows.join(tickers, "market", "left").withColumn("live_price", live_price(F.col("trade_price"), F.col("close")))
    cells = diagnostics(digits)
    return rows.select(
        "market",
        F.lit(version).alias("strategy_version"),
        F.col("signal_ts").alias("ts"),
        "close",
        "live_price",
        "has_position",
        F.coalesce("position_qty", F.lit(0.0)).alias("position_qty"),
        F.coalesce("position_avg_price", F.lit(0.0)).alias("position_avg_price"),
        F.coalesce("position_qty", F.lit(0.0)).alias("total_qty"),
        unrealized_return_pct(F.col("has_position"), F.col("live_price"), F.col("position_avg_price")).alias(
            "unrealized_return_pct"
        ),
        F.col("realized_pnl").alias("realized_pnl_krw"),
        "realized_return_pct",
        "max_drawdown_pct",
        F.coalesce("trade_count", F.lit(0)).alias("trade_count"),
        F.col("win_rate_pct").alias("trade_win_rate_pct"),
        F.col("avg_win_pct").alias("trade_avg_win_pct"),
        F.col("avg_loss_pct").alias("trade_avg_loss_pct"),
        F.col("rr_ratio").alias("trade_rr_ratio"),
        F.col("expectancy_pct").alias("trade_expectancy_pct"),
        "buy_signal",
        "sell_signal",
        "signal_reason",
        diagnostic_text(cells).alias("diagnostics"),
        diagnostic_schema(cells).alias("diagnostics_schema"),
    )

