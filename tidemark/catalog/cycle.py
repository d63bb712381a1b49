"""Queries of the live cycle: event producers, executions of signals, file sinks read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.catalog.base import CANDLES, LEDGER, candles, day, half_up, ledger, query, r, table, text12, units_text, user_orders
from tidemark.catalog.ledger import ALERTS, DRIFT, GUARD, _verdicts, drift_series, synced
from tidemark.catalog.market import LIVE, LIVE_SQL, WEEK, bars_of, live_positions, rd
from tidemark.operators import account as acc
from tidemark.operators import indicators as ind
from tidemark.operators.ledger import managed_quantity
from tidemark.plans import cycle
from tidemark.session import ensure_checkpoint_dir, materialize
from tidemark.sources.candles import read_candle_files, refused_candles
from tidemark.sources.sinks import append_batch, event_rows, write_candle_files


@query(
    "guard_events",
    f"""WITH {GUARD} SELECT 'external_order_guard' AS event, market, blocked,
    CASE reason WHEN 'EXTERNAL_OPEN_ORDER' THEN 'open_order_detected' ELSE 'guard_query_failed' END AS reason,
    CAST(CASE WHEN reason = 'EXTERNAL_OPEN_ORDER' THEN external_open_order_count END AS VARCHAR) AS open_order_count
    FROM verdicts WHERE reason IN ('EXTERNAL_OPEN_ORDER', 'GUARD_QUERY_FAILED')""",
)
def guard_events(spark, sf):
    rows = event_rows(cycle.guard_rows(_verdicts(spark, sf)), "external_order_guard")
    return rows.withColumn("open_order_count", F.col("open_order_count").cast("string"))


@query(
    "position_snapshot_events",
    f"""WITH {DRIFT} SELECT 'position_snapshot' AS event, symbol AS market, total_qty, managed_qty, round(greatest(total_qty - managed_qty, 0), 6) AS external_qty,
    round(greatest(total_qty, 0), 6) AS sellable_qty, round(abs(total_qty - managed_qty), 6) AS drift_qty, round(abs(total_qty - managed_qty), 6) > 0 AS drift_detected FROM drift""",
)
def position_snapshot_events(spark, sf):
    managed = managed_quantity(user_orders(spark, sf), ["symbol"], ["created_at", "event_id"])
    rows = event_rows(acc.drift_snapshots(synced(spark, sf), managed).withColumnRenamed("symbol", "market"), "position_snapshot")
    return rows.withColumns({c: r(c) for c in ("total_qty", "managed_qty", "external_qty", "sellable_qty", "drift_qty")})


@query(
    "drift_events",
    f"""WITH {ALERTS} SELECT 'external_position_drift' AS event, symbol AS market, CAST(total AS DOUBLE) AS total_qty, CAST(managed AS DOUBLE) AS managed_qty,
    CAST(greatest(total - managed, 0) AS DOUBLE) AS external_qty, CAST(drift AS DOUBLE) AS drift_qty FROM alerts""",
)
def drift_events(spark, sf):
    alerts = acc.drift_alerts(drift_series(spark, sf), ["ts", "event_id"]).withColumnRenamed("symbol", "market")
    rows = event_rows(alerts, "external_position_drift")
    return rows.withColumns({c: F.col(c).cast("double") for c in ("total_qty", "managed_qty", "external_qty", "drift_qty")})


#: Each candle is a signal: a buy, a sale of 1.5, a sale of nothing, or none; every fifth was submitted before.
SIGNALS = f"""{CANDLES},
sg AS (SELECT market, ts, idx, CAST(round(close * 10000000) AS HUGEINT) AS c, CASE idx % 4 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' END AS side FROM bars),
due AS (SELECT * FROM sg WHERE side IS NOT NULL AND idx % 5 <> 0),
q AS (SELECT *, CASE side WHEN 'BUY' THEN 100000 * CAST(10000000000000000000 AS HUGEINT) // c ELSE CAST(1500000000000 AS HUGEINT) END AS q FROM due),
p AS (SELECT *, CASE side WHEN 'BUY' THEN {half_up("100000 * CAST(1000000000000000000000000 AS HUGEINT)", "q")} ELSE c * 100000 END AS px FROM q)"""
EXECUTED = f"""SELECT 'trade_execution' AS event, market, side, strftime(ts, '%Y-%m-%d') AS signal_ts, round(CAST(c AS DOUBLE) / 1e7, 6) + 0.0 AS signal_close,
    market || '/' || side || '/' || strftime(ts, '%Y-%m-%d') AS client_order_id"""


def _signals(spark, sf):
    bars, _ = bars_of(spark, sf)
    i = F.col("bar_idx") % 4
    return bars.select(
        "market",
        F.col("ts").alias("signal_ts"),
        F.round("close", 7).cast("decimal(37,12)").alias("close"),
        (i == 0).alias("buy_signal"),
        i.isin(1, 2).alias("sell_signal"),
        F.when(i == 1, 1.5).otherwise(0).cast("decimal(37,12)").alias("position_qty"),
        (F.col("bar_idx") % 5 == 0).alias("before"),
    )


def _key():
    return F.concat_ws("/", "market", "side", day("signal_ts"))


@query(
    "trade_execution_events",
    f"""WITH {SIGNALS} {EXECUTED}, 'FILLED' AS order_status, 'PAPER' AS mode, {units_text("px")} AS executed_price, {units_text("q")} AS executed_volume,
    {units_text(half_up(half_up("px * q", "1000000000000") + " * 5", "10000"))} AS fee_amount,
    round((CAST(px AS DOUBLE) / 1e12 / (CAST(c AS DOUBLE) / 1e7) - 1) * 100, 6) + 0.0 AS slippage_pct,
    round((CAST(px AS DOUBLE) / 1e12 / (CAST(c AS DOUBLE) / 1e7) - 1) * 10000, 4) + 0.0 AS slippage_bps FROM p
    UNION ALL {EXECUTED}, 'CREATED', 'LIVE', NULL, NULL, NULL, NULL, NULL FROM p""",
)
def trade_execution_events(spark, sf):
    """Both modes: paper orders are filled at once, live ones are created and have no execution yet."""
    signals = _signals(spark, sf)
    side = F.when(F.col("buy_signal"), "BUY").otherwise("SELL")
    sent = signals.where("before").select("market", side.alias("side"), "signal_ts")
    out = []
    for mode in ("PAPER", "LIVE"):
        orders, _ = cycle.execute_signals(signals.drop("before"), sent, mode, "100000", "0.0005", _key())
        out.append(event_rows(cycle.execution_rows(orders), "trade_execution"))
    rows = out[0].unionByName(out[1])
    return rows.withColumns(
        {"signal_ts": day("signal_ts"), "signal_close": r("signal_close"), "slippage_pct": r("slippage_pct"), "slippage_bps": r("slippage_bps", 4)}
        | {c: text12(c) for c in ("executed_price", "executed_volume", "fee_amount")}
    )


CYCLE = f"""{LIVE_SQL},
own AS (SELECT DISTINCT o_orderpriority AS market FROM orders WHERE o_orderkey % 1000 = 7 AND o_orderpriority LIKE '5%'),
open_ AS (SELECT o_orderpriority AS market, count(*) AS n FROM orders WHERE o_orderpriority LIKE '4%' GROUP BY 1),
cycle AS (SELECT s.* FROM signals s WHERE market NOT IN (SELECT market FROM own) AND market NOT IN (SELECT market FROM open_))"""


SENT = "(buy_signal OR (sell_signal AND qty > 0)) AND NOT market LIKE '1%'"


@query(
    "live_cycle",
    " UNION ALL ".join(
        f"""({CYCLE} SELECT '{mode}' AS mode, market, strftime(ts, '%Y-%m-%d') AS day, {rd('close', 'close')}, has AS has_position, signal_reason,
    CASE WHEN {SENT} THEN CASE WHEN buy_signal THEN 'BUY' ELSE 'SELL' END END AS side, CASE WHEN {SENT} THEN '{status}' END AS order_status,
    {f"CASE WHEN {SENT} THEN round(close, 6) + 0.0 END" if mode == "PAPER" else "CAST(NULL AS DOUBLE)"} AS executed_price FROM cycle)"""
        for mode, status in (("PAPER", "FILLED"), ("LIVE", "CREATED"))
    ),
)
def live_cycle(spark, sf):
    """One cycle over the candles in either mode: a market with an own order and one with open orders elsewhere are left alone.

    The signal of the first market's last closed candle has been sent before, so it is not sent again.
    """
    o = table(spark, sf, "orders").withColumn("market", F.col("o_orderpriority"))
    # Orders of the ledger: filled but for one in a thousand of the last market; one market has open orders elsewhere.
    active = (F.col("o_orderkey") % 1000 == 7) & F.col("market").startswith("5")
    own = o.select(F.col("market").alias("symbol"), F.lit("LIVE").alias("mode"), F.when(active, "SUBMITTED").otherwise("FILLED").alias("status"))
    facts = materialize(acc.market_facts(own, "LIVE").withColumn("feed_ok", F.lit(True)))
    elsewhere = facts.where(F.col("market").startswith("4")).select("market")
    c = materialize(candles(spark, sf))  # read and aggregated once
    before = F.lag("ts").over(Window.partitionBy("market").orderBy("ts"))
    last = c.where(F.col("market").startswith("1")).withColumn("before", before).groupBy("market").agg(F.max_by("before", "ts").alias("signal_ts"))
    sent = last.withColumn("side", F.explode(F.array(F.lit("BUY"), F.lit("SELL"))))
    held = materialize(live_positions(spark, sf))
    out = []
    for mode in ("PAPER", "LIVE"):
        got = cycle.live_cycle(c, held, facts, elsewhere, sent, LIVE, mode, "100000", "0.0005", _key())
        done = got["orders"].select(F.col("symbol").alias("market"), "side", F.col("status").alias("order_status"), r("avg_executed_price").alias("executed_price"))
        out.append(got["signals"].join(done, "market", "left").withColumn("mode", F.lit(mode)))
    rows = out[0].unionByName(out[1])
    return rows.select("mode", "market", day("signal_ts").alias("day"), r("close").alias("close"), "has_position", "signal_reason", "side", "order_status", "executed_price")


# --- files written and read back ------------------------------------------------------------------------------


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("candle_files", f"WITH {CANDLES} SELECT market, strftime(ts, '%Y-%m-%d') AS day, {rd('open', 'open')}, {rd('close', 'close')}, volume FROM candles")
def candle_files(spark, sf):
    """Candles of all markets written as CSV, a folder each, and read again; the market is the folder's."""
    path = _folder(spark, "candles")
    write_candle_files(candles(spark, sf), path)
    rows = read_candle_files(spark, path)
    return rows.select("market", day().alias("day"), r("open").alias("open"), r("close").alias("close"), "volume")


@query(
    "appended_batches",
    f"WITH {LEDGER} SELECT symbol, mode, status, count(*) AS orders FROM ledger GROUP BY ALL",
)
def appended_batches(spark, sf):
    """Ledger rows appended in three batches, one of them twice, and read back."""
    path = _folder(spark, "ledger")
    rows = ledger(spark, sf)
    for batch in (0, 1, 2, 1):
        append_batch(rows.where(F.col("l_orderkey") % 3 == batch), path, batch)
    return spark.read.parquet(path).groupBy("symbol", "mode", "status").agg(F.count("*").alias("orders"))


@query(
    "weekly_trend_lagged",
    f"""WITH RECURSIVE {CANDLES}, {WEEK}, f AS (SELECT w.market, w.iso_year, w.iso_week,
      coalesce(lag(coalesce(w.wc >= we.v, false)) OVER (PARTITION BY w.market ORDER BY w.idx), false) AS bullish
      FROM weeks w LEFT JOIN we ON we.market = w.market AND we.idx = w.idx)
    SELECT d.market, strftime(d.ts, '%Y-%m-%d') AS day, bullish FROM days d JOIN f USING (market, iso_year, iso_week)""",
)
def weekly_trend_lagged(spark, sf):
    bars, s = bars_of(spark, sf)
    rows = ind.weekly_filter(bars, s, [5], lagged=True)
    return rows.select("market", day().alias("day"), F.col("weekly")[0]["bullish"].alias("bullish"))


@query(
    "refused_candles",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'no time' WHEN o_orderkey % 11 = 0 THEN 'no price' ELSE 'open not above zero' END AS why
    FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0""",
)
def refused(spark, sf):
    """Candles that the readers refuse, kept in an output of their own."""
    k = F.col("o_orderkey")
    price = F.col("o_totalprice")
    raw = table(spark, sf, "orders").select(
        k.alias("id"),
        F.when(k % 7 != 0, F.col("o_orderdate").cast("timestamp")).alias("ts"),
        F.when(k % 13 == 0, 0).otherwise(price).alias("open"),
        price.alias("high"),
        price.alias("low"),
        F.when(k % 11 != 0, price).alias("close"),
        F.lit("1").alias("volume"),
    )
    rows = refused_candles(raw)
    why = F.when(F.col("ts").isNull(), "no time").when(F.col("close").isNull(), "no price").otherwise("open not above zero")
    return rows.select("id", why.alias("why"))
