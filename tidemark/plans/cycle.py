"""One live cycle: guard, signals of the markets let through, events, orders and their fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.account import guard_facts
from tidemark.operators.orders import build_orders, paper_fill, signal_requests, slippage_pct, split_requests
from tidemark.plans.live import LiveParams, candle_signal_rows, live_signals
from tidemark.session import materialize

# How the guard event words its reasons.
GUARD_WORDS = {"EXTERNAL_OPEN_ORDER": "open_order_detected", "GUARD_QUERY_FAILED": "guard_query_failed"}


def guard_rows(verdicts: DataFrame) -> DataFrame:
    """Verdicts that the exchange's side caused, as the fields of the guard event; a failed query has no count."""
    words = F.when(F.col("reason") == "EXTERNAL_OPEN_ORDER", GUARD_WORDS["EXTERNAL_OPEN_ORDER"]).otherwise(GUARD_WORDS["GUARD_QUERY_FAILED"])
    seen = F.when(F.col("has_external_open_order"), F.col("external_open_order_count"))
    return verdicts.where(F.col("reason").isin(*GUARD_WORDS)).select("market", "blocked", words.alias("reason"), seen.alias("open_order_count"))


def without_repeats(requests: DataFrame, sent: DataFrame) -> DataFrame:
    """Requests whose (market, side, signal time) is none of those in ``sent``, which may hold any number of them."""
    return requests.join(sent, ["market", "side", "signal_ts"], "left_anti")


def execute_signals(signals: DataFrame, sent: DataFrame, mode: str, notional: float | str, fee_rate: float | str, key: Column) -> tuple[DataFrame, DataFrame]:
    """Orders of the signals' requests, filled at once in PAPER mode, and the requests that a rule refuses.

    ``signals`` has market, signal_ts, close, buy_signal, sell_signal and position_qty; ``key`` names an order out of
    market, side and signal_ts. The orders carry the signal's time and close and the slippage of their price.
    """
    wanted = without_repeats(signal_requests(signals, mode, notional), sent)
    good, refused = split_requests(wanted)
    close = signals.select("market", "signal_ts", F.col("close").alias("signal_close"))
    named = good.withColumn("_key", key).join(close, ["market", "signal_ts"])
    orders = build_orders(named, F.col("_key")).join(
        named.select(F.col("_key").alias("client_order_id"), "signal_ts", "signal_close"), "client_order_id"
    )
    if mode == "PAPER":
        orders = paper_fill(orders, fee_rate)
    else:
        empty = F.lit(None).cast("decimal(38,12)")
        orders = orders.withColumns({c: empty for c in ("avg_executed_price", "executed_volume", "fee_amount")})
    pct = slippage_pct(F.col("signal_close").cast("double"), F.col("avg_executed_price").cast("double"))
    return orders.withColumns({"slippage_pct": pct, "slippage_bps": pct * 100}), refused


def execution_rows(orders: DataFrame) -> DataFrame:
    """Orders of signals as the fields of the execution event."""
    return orders.select(
        F.col("symbol").alias("market"),
        "side",
        "signal_ts",
        F.col("signal_close").cast("double").alias("signal_close"),
        "client_order_id",
        F.col("status").alias("order_status"),
        "mode",
        F.col("avg_executed_price").alias("executed_price"),
        "executed_volume",
        "fee_amount",
        "slippage_pct",
        "slippage_bps",
    )


def live_cycle(
    candles: DataFrame,
    positions: DataFrame,
    facts: DataFrame,
    open_orders: DataFrame,
    sent: DataFrame,
    params: LiveParams,
    mode: str,
    notional: float | str,
    fee_rate: float | str,
    key: Column,
    metrics: DataFrame | None = None,
    tickers: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The tables one cycle writes: verdicts, signals and orders. Blocked markets are not evaluated.

    ``facts`` has (market, own, feed_ok), see ``market_facts``.  The few rows of verdicts and of signals are stored, so
    that each is worked out once.  With ``metrics`` and ``tickers`` the signals are the fields of the signal event.
    """
    verdicts = materialize(guard_facts(facts, "LIVE", open_orders))
    allowed = verdicts.where(~F.col("blocked")).select("market")
    signals = materialize(live_signals(candles, positions, params, allowed=allowed))
    done, refused = execute_signals(signals, sent, mode, notional, fee_rate, key)
    told = signals if metrics is None else candle_signal_rows(signals, metrics, tickers)
    return {"verdicts": verdicts, "signals": told, "orders": done, "refused": refused}
