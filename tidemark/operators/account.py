"""Account sync, drift and order guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import AMOUNT, WIDE, asset_of, dec, normalize_market
from tidemark.operators.orders import ACTIVE_STATUSES
from tidemark.operators.scan import lay_out

REASONS = ["NONE", "LOCAL_ACTIVE_ORDER", "EXTERNAL_OPEN_ORDER", "GUARD_QUERY_FAILED"]


def market_list(df: DataFrame, column: str = "market") -> DataFrame:
    """Distinct normalised markets without blanks."""
    return df.select(normalize_market(F.col(column)).alias("market")).where(F.col("market") != "").distinct()


def account_by_currency(accounts: DataFrame, seq: str = "seq") -> DataFrame:
    """One account per upper-cased currency; blanks go, the first duplicate wins."""
    rest = [c for c in accounts.columns if c not in ("currency", seq)]
    rows = accounts.where(F.length(F.trim("currency")) > 0).withColumn("currency", F.upper("currency"))
    first = F.min_by(F.struct(*rest), F.col(seq)).alias("a")
    return rows.groupBy("currency").agg(first).select("currency", *[F.col(f"a.{c}").alias(c) for c in rest])


def sync_positions(markets: DataFrame, accounts: DataFrame, mode: str = "LIVE") -> DataFrame:
    """Positions the account table shows: total = balance + locked, average price of the account.

    Only in LIVE mode; markets without an asset part are left out; a missing account is flat.
    """
    rows = markets.withColumn("asset", asset_of(F.col("market"))).where((F.col("asset") != "") & F.lit(mode == "LIVE"))
    joined = rows.join(account_by_currency(accounts).withColumnRenamed("currency", "asset"), "asset", "left")
    total = (dec(F.col("balance")) + dec(F.col("locked"))).cast(WIDE)
    long = total > 0
    return joined.select(
        F.col("market").alias("symbol"),
        total.alias("qty"),
        F.when(long, dec(F.col("avg_buy_price"))).otherwise(F.lit(0)).cast(WIDE).alias("avg_price"),
        F.when(long, "LONG").otherwise("FLAT").alias("state"),
    )


def drift_columns(total: Column, managed: Column) -> dict[str, Column]:
    """External, sellable and drifting quantity of a position."""
    zero = F.lit(0).cast(AMOUNT)
    total, managed = (F.coalesce(x.cast(AMOUNT), zero) for x in (total, managed))
    drift = F.abs(total - managed)
    return {
        "external_qty": F.greatest(total - managed, zero).cast(WIDE),
        "sellable_qty": F.greatest(total, zero).cast(WIDE),
        "drift_qty": drift.cast(WIDE),
        "drift_detected": drift > 0,
    }


def drift_snapshots(positions: DataFrame, managed: DataFrame) -> DataFrame:
    """Drift of each position against the managed quantity of its symbol (none = 0)."""
    rows = positions.join(managed, "symbol", "left").select(
        "symbol",
        F.col("qty").cast(WIDE).alias("total_qty"),
        F.coalesce(F.col("managed_qty"), F.lit(0)).cast(WIDE).alias("managed_qty"),
    )
    return rows.withColumns(drift_columns(F.col("total_qty"), F.col("managed_qty")))


def drift_alerts(snapshots: DataFrame, order: list[str], rows_per_task: int | None = None) -> DataFrame:
    """Drifting snapshots that differ from the one before: no drift then, or another total, managed or drift."""
    rows, series = lay_out(snapshots, ["symbol"], order, rows_per_task)
    seen = F.struct("drift_detected", "drift_qty", "total_qty", "managed_qty")
    rows = series.shift(rows, _p=seen)
    same = F.col("_p.drift_detected")
    for c in ("drift_qty", "total_qty", "managed_qty"):
        same = same & (F.col(f"_p.{c}") == F.col(c))
    return rows.where(F.col("drift_detected") & ~F.coalesce(same, F.lit(False))).drop("_p")


def latest_snapshot(snapshots: DataFrame, at: Column) -> DataFrame:
    """Newest snapshot of each symbol."""
    rest = [c for c in snapshots.columns if c != "symbol"]
    return snapshots.groupBy("symbol").agg(F.max_by(F.struct(*rest), at).alias("s")).select(
        "symbol", *[F.col(f"s.{c}").alias(c) for c in rest]
    )


def active_markets(orders: DataFrame, mode: str) -> DataFrame:
    """Symbols with an order of this mode still under way."""
    return orders.where((F.col("mode") == mode) & F.col("status").isin(ACTIVE_STATUSES)).select("symbol").distinct()


def open_order_counts(open_orders: DataFrame) -> DataFrame:
    """Waiting exchange orders per market."""
    return open_orders.groupBy("market").agg(F.count(F.lit(1)).alias("external_open_order_count"))


def guard(
    markets: DataFrame, orders: DataFrame, mode: str, open_orders: DataFrame | None = None, feed: DataFrame | None = None
) -> DataFrame:
    """Verdict per market: own active order, then (LIVE) open exchange orders, then none.

    ``feed`` has a row (market, feed_ok) per queried market; a market whose feed failed or is missing is
    blocked, since no open order cannot be told from no answer.
    """
    own = active_markets(orders, mode).select(F.col("symbol").alias("market"), F.lit(True).alias("own"))
    rows = markets.join(own, "market", "left")
    if mode == "LIVE":
        rows = rows.join(feed, "market", "left")
    return guard_facts(rows, mode, open_orders)


def market_facts(orders: DataFrame, mode: str, **more: Column) -> DataFrame:
    """One row per market with an order, in one pass: ``own``, whether one of this mode is under way, and other aggregates."""
    active = (F.col("mode") == mode) & F.col("status").isin(ACTIVE_STATUSES)
    return orders.groupBy(F.col("symbol").alias("market")).agg(
        F.max(F.coalesce(active, F.lit(False))).alias("own"), *[c.alias(n) for n, c in more.items()]
    )


def guard_facts(facts: DataFrame, mode: str, open_orders: DataFrame | None = None, *keep: str) -> DataFrame:
    """Verdicts of markets whose own orders (``own``) and feeds (``feed_ok``, LIVE only) are known, with the columns ``keep``."""
    own, none = F.coalesce("own", F.lit(False)), F.lit(0).cast("bigint")
    rows, count, ok = facts, none, F.lit(True)
    if mode == "LIVE":
        rows = facts.join(open_order_counts(open_orders), "market", "left")
        count, ok = F.coalesce("external_open_order_count", none), F.coalesce("feed_ok", F.lit(False))
    reason = F.when(own, REASONS[1]).when(~ok, REASONS[3]).when(count > 0, REASONS[2]).otherwise(REASONS[0])
    external = ~own & ok & (count > 0)
    return rows.select(
        "market",
        (reason != "NONE").alias("blocked"),
        reason.alias("reason"),
        external.alias("has_external_open_order"),
        F.when(external, count).otherwise(none).alias("external_open_order_count"),
        *keep,
    )


def coexistence(markets: DataFrame, positions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Position and guard verdict of each market; the reason shows only when blocked."""
    held = positions.select(F.col("symbol").alias("market"), F.col("qty"))
    return coexistence_columns(markets.join(held, "market", "left").join(verdicts, "market", "left"))


def coexistence_columns(rows: DataFrame) -> DataFrame:
    """Status of markets with their verdict and held ``qty``."""
    return rows.select(
        "market",
        F.coalesce(F.col("qty"), F.lit(0)).cast(WIDE).alias("total_qty"),
        "has_external_open_order",
        "blocked",
        F.when(F.col("blocked"), F.col("reason")).alias("blocked_reason"),
        "external_open_order_count",
    )


def position_lookup(markets: DataFrame, positions: DataFrame) -> DataFrame:
    """Position of each market; flat when there is none."""
    held = positions.select(F.col("symbol").alias("market"), "qty", "avg_price", "updated_at")
    zero = F.lit(0).cast(AMOUNT)
    return markets.join(held, "market", "left").select(
        "market",
        F.coalesce(F.col("qty").cast(AMOUNT), zero).cast(WIDE).alias("total_qty"),
        F.greatest(F.coalesce(F.col("qty").cast(AMOUNT), zero), zero).cast(WIDE).alias("position_qty"),
        F.coalesce(F.col("avg_price").cast(AMOUNT), zero).cast(WIDE).alias("position_avg_price"),
        "updated_at",
    )
