"""Sinks: candle files, append tables, positions, event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import finite_or_zero, safe_name
from tidemark.sources.candles import CSV_COLUMNS


def write_candles_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Candles of one market with the six-column header; times are ISO text with offset."""
    stamp = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ssXXX").alias(CSV_COLUMNS[0])
    df.select(stamp, *CSV_COLUMNS[1:]).write.mode(mode).option("header", True).csv(path)


def write_candle_files(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Candles of all markets as CSV, one folder per market with files as ``write_candles_csv`` writes them."""
    stamp = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ssXXX").alias(CSV_COLUMNS[0])
    df.select("market", stamp, *CSV_COLUMNS[1:]).write.mode(mode).partitionBy("market").option("header", True).csv(path)


def write_candles(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Candles as Parquet, one folder per market and year so that time ranges prune."""
    rows = df.withColumns({"market_dir": safe_name(F.col("market")), "year": F.year("ts")})
    rows.write.mode(mode).partitionBy("market_dir", "year").parquet(path)


def append_batch(df: DataFrame, path: str, batch: int | str) -> None:
    """Append one batch (fills, drift snapshots, audit events); writing the same batch again replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def upsert_positions(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Positions after a set of changes: changed symbols take the new row, others stay."""
    keep = current.join(changes.select("symbol"), "symbol", "left_anti")
    return keep.unionByName(changes, allowMissingColumns=True)


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """Latest row of each symbol in a position table written with ``append_batch``."""
    log = spark.read.parquet(path)
    rest = [c for c in log.columns if c not in ("symbol", "batch")]
    latest = F.max_by(F.struct(*rest), F.col("batch").cast("bigint")).alias("p")
    return log.groupBy("symbol").agg(latest).select("symbol", *[F.col(f"p.{c}").alias(c) for c in rest])


# Event names and their fields, in log order.
EVENTS = {
    "candle_signal": [
        "market", "strategy_version", "ts", "close", "live_price", "has_position", "position_qty",
        "position_avg_price", "total_qty", "unrealized_return_pct", "realized_pnl_krw", "realized_return_pct",
        "max_drawdown_pct", "trade_count", "trade_win_rate_pct", "trade_avg_win_pct", "trade_avg_loss_pct",
        "trade_rr_ratio", "trade_expectancy_pct", "buy_signal", "sell_signal", "signal_reason", "diagnostics",
        "diagnostics_schema",
    ],
    "strategy_diagnostic": [
        "market", "strategy_version", "ts", "key", "label", "value", "buy_signal", "sell_signal", "signal_reason",
    ],
    "trade_execution": [
        "market", "side", "signal_ts", "signal_close", "client_order_id", "order_status", "mode", "executed_price",
        "executed_volume", "fee_amount", "slippage_pct", "slippage_bps",
    ],
    "position_sync": ["market", "asset", "qty", "managed_qty", "avg_price", "state"],
    "position_snapshot": [
        "market", "total_qty", "managed_qty", "external_qty", "sellable_qty", "drift_qty", "drift_detected",
    ],
    "external_position_drift": ["market", "total_qty", "managed_qty", "external_qty", "drift_qty"],
    "external_order_guard": ["market", "blocked", "reason", "open_order_count"],
}
METRIC_FIELDS = {
    "live_price", "unrealized_return_pct", "realized_pnl_krw", "realized_return_pct", "max_drawdown_pct",
    "trade_win_rate_pct", "trade_avg_win_pct", "trade_avg_loss_pct", "trade_rr_ratio", "trade_expectancy_pct", "value",
}


def event_rows(df: DataFrame, event: str) -> DataFrame:
    """Typed event table: the event name and its fields; metrics that are not finite become 0.0."""
    cols: list[Column] = [F.lit(event).alias("event")]
    for name in EVENTS[event]:
        cols.append((finite_or_zero(F.col(name)) if name in METRIC_FIELDS else F.col(name)).alias(name))
    return df.select(*cols)


def event_text(df: DataFrame, event: str) -> DataFrame:
    """Event table as ``event=… key=value`` lines; labels are quoted."""
    parts = [F.lit(f"event={event}")]
    for name in EVENTS[event]:
        text = F.coalesce(F.col(name).cast("string"), F.lit("null"))
        if name == "label":
            text = F.concat(F.lit('"'), text, F.lit('"'))
        parts.append(F.concat(F.lit(f"{name}="), text))
    return df.select(F.concat_ws(" ", *parts).alias("value"))
