"""Queries over orders, fills, positions and accounts."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from tidemark.catalog.base import (
    ACCOUNTS,
    CANDLES,
    FILLED,
    LEDGER,
    LEDGER_KEY,
    LEDGER_ORDER,
    SNAPSHOTS,
    USER_MANAGED,
    accounts,
    candles,
    day,
    filled_orders,
    half_up,
    ledger,
    order_snapshots,
    query,
    r,
    stamp,
    table,
    text12,
    units_text,
    user_markets,
    user_orders,
)
from tidemark.catalog.market import DIAGNOSTIC_SQL, LIVE_SQL, SCHEMA_SQL, live
from tidemark.functions.scalar import asset_of
from tidemark.operators import account as acc
from tidemark.operators import orders as od
from tidemark.operators import reconcile as rec
from tidemark.operators.ledger import METRICS, execution_metrics, managed_quantity, round_trips, weighted_positions
from tidemark.sources.sinks import event_rows, upsert_positions
from tidemark.session import materialize

KEY = ", ".join(LEDGER_KEY)


@query(
    "orders_by_symbol_mode_status",
    f"""WITH {LEDGER} SELECT symbol, mode, status, count(*) AS orders, round(sum(price), 2) + 0.0 AS total FROM ledger
    WHERE mode = 'LIVE' AND status = 'FILLED' AND symbol IN ('KRW-S1', 'KRW-S2', 'KRW-S3') GROUP BY ALL""",
)
def orders_by_symbol_mode_status(spark, sf):
    rows = ledger(spark, sf).where(
        (F.col("mode") == "LIVE") & (F.col("status") == "FILLED") & F.col("symbol").isin("KRW-S1", "KRW-S2", "KRW-S3")
    )
    out = rows.groupBy("symbol", "mode", "status").agg(F.count(F.lit(1)).alias("orders"), F.sum("price").alias("t"))
    return out.select("symbol", "mode", "status", "orders", r("t", 2).alias("total"))


@query("order_lookup", f"WITH {LEDGER} SELECT symbol, side, order_type, mode, status, {KEY} FROM ledger WHERE l_orderkey = 77")
def order_lookup(spark, sf):
    rows = ledger(spark, sf).where(F.col("l_orderkey") == 77)
    return rows.select("symbol", "side", "order_type", "mode", "status", *LEDGER_KEY)


@query("market_list", "SELECT DISTINCT 'KRW-U' || user_id AS market FROM events")
def market_list(spark, sf):
    return acc.market_list(user_markets(spark, sf))


@query(
    "market_assets",
    """SELECT DISTINCT CASE WHEN event_id % 5 = 0 THEN 'krw-' WHEN event_id % 5 = 1 THEN 'krw' || user_id ELSE 'krw-u-' || user_id END AS market,
    CASE WHEN event_id % 5 IN (0, 1) THEN '' ELSE 'U-' || user_id END AS asset FROM events""",
)
def market_assets(spark, sf):
    e = table(spark, sf, "events")
    user = F.col("user_id").cast("string")
    code = F.when(F.col("event_id") % 5 == 0, "krw-").when(F.col("event_id") % 5 == 1, F.concat(F.lit("krw"), user))
    rows = e.select(code.otherwise(F.concat(F.lit("krw-u-"), user)).alias("market")).distinct()
    return rows.select("market", asset_of(F.col("market")).alias("asset"))


BALANCE_SQL = """coalesce(TRY_CAST(balance AS DOUBLE), 0) AS balance, CAST(locked AS DOUBLE) AS locked"""


@query(
    "balances_of_currency",
    f"WITH {ACCOUNTS} SELECT currency, {BALANCE_SQL}, CAST(avg_buy_price AS DOUBLE) AS avg_buy_price, unit_currency FROM accounts WHERE lower(currency) = 'u7'",
)
def balances_of_currency(spark, sf):
    rows = od.balances(accounts(spark, sf), " U7 ")
    num = [F.col(c).cast("double").alias(c) for c in ("balance", "locked", "avg_buy_price")]
    return rows.select("currency", *num, "unit_currency")


@query(
    "accounts_by_currency",
    f"WITH {ACCOUNTS} SELECT currency, balance, locked, avg_buy_price FROM acct",
)
def accounts_by_currency(spark, sf):
    return acc.account_by_currency(accounts(spark, sf)).select("currency", "balance", "locked", "avg_buy_price")


SYNC = f"""{ACCOUNTS},
markets AS (SELECT DISTINCT 'KRW-U' || user_id AS symbol, 'U' || user_id AS asset FROM events
  UNION ALL SELECT 'KRW-' || upper(trim(n_name)), upper(trim(n_name)) FROM nation),
synced AS (
  SELECT m.symbol, coalesce(TRY_CAST(a.balance AS DOUBLE), 0) + coalesce(CAST(a.locked AS DOUBLE), 0) AS qty, CAST(a.avg_buy_price AS DOUBLE) AS avg
  FROM markets m LEFT JOIN acct a ON a.currency = m.asset),
positions AS (SELECT symbol, round(qty, 6) AS qty, CASE WHEN qty > 0 THEN avg ELSE 0 END AS avg_price, CASE WHEN qty > 0 THEN 'LONG' ELSE 'FLAT' END AS state FROM synced)"""


def synced(spark, sf):
    # Nations are markets without an account.
    extra = table(spark, sf, "nation").select(F.concat(F.lit("krw-"), F.trim("n_name")).alias("market"))
    return acc.sync_positions(acc.market_list(user_markets(spark, sf).unionByName(extra)), accounts(spark, sf))


@query("position_sync", f"WITH {SYNC} SELECT symbol, qty, avg_price, state FROM positions")
def position_sync(spark, sf):
    return synced(spark, sf).select("symbol", r("qty").alias("qty"), r("avg_price").alias("avg_price"), "state")


@query(
    "position_sync_events",
    f"""WITH {SYNC}, {USER_MANAGED} SELECT 'position_sync' AS event, p.symbol AS market, upper(split_part(p.symbol, '-', 2)) AS asset, p.qty,
    coalesce(m.managed_qty, 0) AS managed_qty, p.avg_price, p.state FROM positions p LEFT JOIN managed m USING (symbol)""",
)
def position_sync_events(spark, sf):
    managed = managed_quantity(user_orders(spark, sf), ["symbol"], ["created_at", "event_id"])
    rows = synced(spark, sf).join(managed, "symbol", "left").withColumnRenamed("symbol", "market")
    rows = rows.withColumns({"asset": asset_of(F.col("market")), "managed_qty": F.coalesce("managed_qty", F.lit(0))})
    rows = event_rows(rows, "position_sync")
    return rows.withColumns({c: r(c) for c in ("qty", "managed_qty", "avg_price")})


DRIFT = f"""{SYNC}, {USER_MANAGED},
drift AS (
  SELECT p.symbol, p.qty AS total_qty, coalesce(m.managed_qty, 0) AS managed_qty FROM positions p LEFT JOIN managed m USING (symbol))"""


@query(
    "drift_snapshots",
    f"""WITH {DRIFT} SELECT symbol, total_qty, managed_qty, round(greatest(total_qty - managed_qty, 0), 6) AS external_qty,
    round(greatest(total_qty, 0), 6) AS sellable_qty, round(abs(total_qty - managed_qty), 6) AS drift_qty,
    round(abs(total_qty - managed_qty), 6) > 0 AS drift_detected FROM drift""",
)
def drift_snapshots(spark, sf):
    managed = managed_quantity(user_orders(spark, sf), ["symbol"], ["created_at", "event_id"])
    rows = acc.drift_snapshots(synced(spark, sf), managed)
    return rows.withColumns({c: r(c) for c in ("total_qty", "managed_qty", "external_qty", "sellable_qty", "drift_qty")})


ALERTS = """
snaps AS (SELECT event_type AS symbol, ts, event_id, floor(value / 50) AS total, event_id % 2 AS managed FROM events),
flagged AS (SELECT *, abs(total - managed) AS drift, abs(total - managed) > 0 AS on_ FROM snaps),
prev AS (SELECT *, lag(on_) OVER w AS pon, lag(drift) OVER w AS pd, lag(total) OVER w AS pt, lag(managed) OVER w AS pm FROM flagged
  WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id)),
alerts AS (SELECT symbol, event_id, total, managed, drift FROM prev WHERE on_ AND (pon IS NULL OR NOT pon OR pd <> drift OR pt <> total OR pm <> managed))"""


def drift_series(spark, sf):
    """Drift snapshots over time out of events."""
    e = table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"),
        "ts",
        "event_id",
        F.floor(F.col("value") / 50).cast("decimal(38,12)").alias("total_qty"),
        (F.col("event_id") % 2).cast("decimal(38,12)").alias("managed_qty"),
    )
    return e.withColumns(acc.drift_columns(F.col("total_qty"), F.col("managed_qty")))


ALERT_SQL = """symbol, event_id, CAST(total AS DOUBLE) AS total_qty, CAST(managed AS DOUBLE) AS managed_qty, CAST(drift AS DOUBLE) AS drift_qty"""


@query("drift_alerts", f"WITH {ALERTS} SELECT {ALERT_SQL} FROM alerts")
def drift_alerts(spark, sf):
    rows = acc.drift_alerts(drift_series(spark, sf), ["ts", "event_id"])
    num = [F.col(c).cast("double").alias(c) for c in ("total_qty", "managed_qty", "drift_qty")]
    return rows.select("symbol", "event_id", *num)


@query(
    "latest_drift",
    f"WITH {ALERTS} SELECT symbol, max(event_id) AS event_id, CAST(arg_max(drift, (ts, event_id)) AS DOUBLE) AS drift_qty FROM flagged GROUP BY symbol",
)
def latest_drift(spark, sf):
    rows = acc.latest_snapshot(drift_series(spark, sf), F.struct("ts", "event_id"))
    return rows.select("symbol", "event_id", F.col("drift_qty").cast("double").alias("drift_qty"))


GUARD = f"""{LEDGER},
mk AS (SELECT DISTINCT symbol AS market FROM ledger),
own AS (SELECT DISTINCT symbol AS market FROM ledger WHERE mode = 'LIVE' AND status IN ('CREATED', 'SUBMITTED', 'PARTIALLY_FILLED') AND l_partkey % 40 = 0),
ext AS (SELECT 'KRW-S' || (user_id * 13 % 331) AS market, count(*) AS c FROM events GROUP BY 1),
feed AS (SELECT market, CASE WHEN CAST(substr(market, 6) AS BIGINT) % 11 <> 0 THEN CAST(substr(market, 6) AS BIGINT) % 7 <> 0 END AS ok FROM mk),
verdict AS (
  SELECT mk.market, CASE WHEN own.market IS NOT NULL THEN 'LOCAL_ACTIVE_ORDER' WHEN NOT coalesce(feed.ok, false) THEN 'GUARD_QUERY_FAILED'
    WHEN coalesce(ext.c, 0) > 0 THEN 'EXTERNAL_OPEN_ORDER' ELSE 'NONE' END AS reason, coalesce(ext.c, 0) AS c
  FROM mk LEFT JOIN own USING (market) LEFT JOIN ext USING (market) LEFT JOIN feed USING (market)),
verdicts AS (SELECT market, reason <> 'NONE' AS blocked, reason, reason = 'EXTERNAL_OPEN_ORDER' AS has_external_open_order,
  CASE WHEN reason = 'EXTERNAL_OPEN_ORDER' THEN c ELSE 0 END AS external_open_order_count FROM verdict)"""


def _open_orders(spark, sf):
    number = (F.col("user_id") * 13 % 331).cast("string")
    return table(spark, sf, "events").select(F.concat(F.lit("KRW-S"), number).alias("market"))


def _open_as_stated(rows):
    """One order in forty is still open as its status says; the others have been filled since."""
    return rows.withColumn("status", F.when(F.col("l_partkey") % 40 == 0, F.col("status")).otherwise("FILLED"))


def _feed_ok():
    number = F.substring("market", 6, 10).cast("bigint")
    return F.when(number % 11 != 0, number % 7 != 0)


def _verdicts(spark, sf):
    facts = acc.market_facts(_open_as_stated(ledger(spark, sf)), "LIVE").withColumn("feed_ok", _feed_ok())
    return acc.guard_facts(facts, "LIVE", _open_orders(spark, sf))


@query(
    "active_order_markets",
    f"WITH {LEDGER} SELECT DISTINCT symbol FROM ledger WHERE mode = 'LIVE' AND status IN ('CREATED', 'SUBMITTED', 'PARTIALLY_FILLED')",
)
def active_order_markets(spark, sf):
    return acc.active_markets(ledger(spark, sf), "LIVE")


@query("open_order_counts", f"WITH {GUARD} SELECT market, c AS external_open_order_count FROM ext")
def open_order_counts(spark, sf):
    return acc.open_order_counts(_open_orders(spark, sf))


@query("order_guard", f"WITH {GUARD} SELECT * FROM verdicts")
def order_guard(spark, sf):
    return _verdicts(spark, sf)


HELD = """
held AS (
  SELECT 'KRW-S' || l_suppkey AS market, CAST(sum(CASE WHEN l_suppkey % 4 <> 0 THEN l_quantity END) AS DOUBLE) AS qty FROM lineitem GROUP BY 1)"""


def _held(spark, sf):
    """Held quantities of all symbols; one in four is unknown."""
    known = F.col("l_suppkey") % 4 != 0
    return table(spark, sf, "lineitem").groupBy(F.concat(F.lit("KRW-S"), F.col("l_suppkey").cast("string")).alias("symbol")).agg(
        F.sum(F.when(known, F.col("l_quantity"))).cast("decimal(38,12)").alias("qty"),
        F.max(F.when(known, 10)).cast("decimal(38,12)").alias("avg_price"),
        F.max("l_shipdate").alias("updated_at"),
    )


@query(
    "coexistence_status",
    f"""WITH {GUARD}, {HELD} SELECT v.market, coalesce(h.qty, 0) AS total_qty, has_external_open_order, blocked,
    CASE WHEN blocked THEN reason END AS blocked_reason, external_open_order_count FROM verdicts v LEFT JOIN held h USING (market)""",
)
def coexistence_status(spark, sf):
    """Orders, feeds and holdings come from one pass over the line items."""
    orders = _open_as_stated(ledger(spark, sf, "l_suppkey", "l_quantity"))
    held = F.sum(F.when(F.col("l_suppkey") % 4 != 0, F.col("l_quantity"))).cast("decimal(38,12)")
    facts = acc.market_facts(orders, "LIVE", qty=held).withColumn("feed_ok", _feed_ok())
    rows = acc.coexistence_columns(acc.guard_facts(facts, "LIVE", _open_orders(spark, sf), "qty"))
    return rows.withColumn("total_qty", r("total_qty"))


@query(
    "position_lookup",
    f"""WITH {LEDGER}, {HELD} SELECT m.market, coalesce(h.qty, 0) AS total_qty, coalesce(h.qty, 0) AS position_qty,
    CASE WHEN h.qty IS NULL THEN 0.0::DOUBLE ELSE 10.0::DOUBLE END AS position_avg_price
    FROM (SELECT DISTINCT symbol AS market FROM ledger) m LEFT JOIN held h USING (market)""",
)
def position_lookup(spark, sf):
    markets = ledger(spark, sf).select(F.col("symbol").alias("market")).distinct()
    rows = acc.position_lookup(markets, _held(spark, sf))
    return rows.select("market", *[r(c).alias(c) for c in ("total_qty", "position_qty", "position_avg_price")])


@query(
    "position_upsert",
    f"""WITH {HELD}, ch AS (SELECT 'KRW-S' || (o_custkey % 150) AS market, CAST(count(*) AS DOUBLE) AS qty FROM orders GROUP BY 1)
    SELECT market AS symbol, qty FROM ch UNION ALL SELECT market, qty FROM held WHERE market NOT IN (SELECT market FROM ch)""",
)
def position_upsert(spark, sf):
    number = (F.col("o_custkey") % 150).cast("string")
    changes = table(spark, sf, "orders").groupBy(F.concat(F.lit("KRW-S"), number).alias("symbol")).agg(
        F.count("*").cast("decimal(38,12)").alias("qty")
    )
    rows = upsert_positions(_held(spark, sf), changes)
    return rows.select("symbol", F.col("qty").cast("double").alias("qty"))


# --- order requests -------------------------------------------------------------------------------------------

REQUEST_ERROR_SQL = """CASE WHEN side IS NULL THEN 'side_missing' WHEN quantity <= 0 THEN 'quantity_not_positive'
    WHEN price <= 0 THEN 'price_not_positive'
    WHEN side = 'BUY' AND order_type = 'MARKET_SELL' THEN 'buy_with_market_sell'
    WHEN side = 'SELL' AND order_type = 'MARKET_BUY' THEN 'sell_with_market_buy'
    WHEN order_type = 'LIMIT' AND (quantity IS NULL OR price IS NULL) THEN 'limit_needs_quantity_and_price'
    WHEN order_type = 'MARKET_BUY' AND mode = 'PAPER' AND quantity IS NULL THEN 'paper_buy_needs_quantity'
    WHEN order_type = 'MARKET_BUY' AND mode = 'PAPER' AND price IS NULL THEN 'paper_buy_needs_notional'
    WHEN order_type = 'MARKET_SELL' AND quantity IS NULL THEN 'sell_needs_quantity'
    WHEN order_type = 'MARKET_SELL' AND mode = 'PAPER' AND price IS NULL THEN 'paper_sell_needs_price' END"""
VALID = f"{LEDGER}, valid AS (SELECT * FROM ledger WHERE {REQUEST_ERROR_SQL} IS NULL)"


def requests(spark, sf):
    return ledger(spark, sf).withColumnRenamed("symbol", "market")


@query("request_errors", f"WITH {LEDGER} SELECT {KEY}, {REQUEST_ERROR_SQL} AS error FROM ledger")
def request_errors(spark, sf):
    return requests(spark, sf).select(*LEDGER_KEY, od.request_error().alias("error"))


def _orders(spark, sf):
    good, _ = od.split_requests(requests(spark, sf))
    return good.withColumn("requested_notional", od.requested_notional())


NOTIONAL = "CASE WHEN order_type = 'MARKET_BUY' THEN price ELSE coalesce(quantity, 0) * coalesce(price, 0) END"


#: The notional as text: quantities are whole numbers, prices have two places.
NOTIONAL_TEXT = """CAST(CAST(CASE WHEN order_type = 'MARKET_BUY' THEN CAST(price AS DECIMAL(18,2))
    ELSE CAST(coalesce(quantity, 0) AS DECIMAL(12,0)) * CAST(coalesce(price, 0) AS DECIMAL(18,2)) END AS DECIMAL(38,12)) AS VARCHAR)"""


@query("requested_notional", f"WITH {VALID} SELECT {KEY}, {NOTIONAL_TEXT} AS notional FROM valid")
def requested_notional(spark, sf):
    return _orders(spark, sf).select(*LEDGER_KEY, text12("requested_notional").alias("notional"))


@query(
    "created_orders",
    f"WITH {VALID} SELECT 'c' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS client_order_id, symbol, 'CREATED' AS status, {NOTIONAL_TEXT} AS notional FROM valid",
)
def created_orders(spark, sf):
    good, _ = od.split_requests(requests(spark, sf))
    key = F.concat(F.lit("c"), F.concat_ws("-", *[F.col(c).cast("string") for c in LEDGER_KEY]))
    rows = od.build_orders(good, key)
    return rows.select("client_order_id", "symbol", "status", text12("requested_notional").alias("notional"))


PAPER = f"""{VALID},
exact AS (SELECT *, CAST(round(price * 100) AS HUGEINT) * 10000000000 AS p, CAST(quantity AS HUGEINT) AS q FROM valid WHERE mode = 'PAPER'),
pr AS (SELECT *, CASE WHEN order_type = 'MARKET_BUY' THEN {half_up("p", "q")} ELSE p END AS px FROM exact)"""


@query("paper_unit_price", f"WITH {PAPER} SELECT {KEY}, {units_text('px')} AS unit_price FROM pr")
def paper_unit_price(spark, sf):
    rows = _orders(spark, sf).where(F.col("mode") == "PAPER")
    return rows.select(*LEDGER_KEY, text12(od.paper_price()).alias("unit_price"))


@query(
    "paper_fills",
    f"""WITH {PAPER} SELECT {KEY}, {units_text("q * 1000000000000")} AS executed_volume, {units_text("px")} AS avg_executed_price,
    {units_text(half_up("px * q * 5", "10000"))} AS fee_amount, 'FILLED' AS status, CAST(NULL AS VARCHAR) AS amount_error FROM pr""",
)
def paper_fills(spark, sf):
    rows = od.paper_fill(_orders(spark, sf).where(F.col("mode") == "PAPER"), "0.0005")
    amounts = [text12(c).alias(c) for c in ("executed_volume", "avg_executed_price", "fee_amount")]
    return rows.select(*LEDGER_KEY, *amounts, "status", "amount_error")


@query(
    "paper_fills_by_notional",
    f"""WITH o AS (
      SELECT *, CAST(round(l_extendedprice * 100) AS HUGEINT) * 10000000000 * CASE WHEN l_linenumber = 1 THEN 10000000000 ELSE 1 END AS n,
        CAST(round(l_extendedprice * 100) AS HUGEINT) % 99991 + 3 AS c FROM lineitem),
    v AS (SELECT *, n * 100 // c AS v FROM o)
    SELECT {KEY}, {units_text("v")} AS executed_volume, {units_text("c * 10000000000")} AS avg_executed_price,
      {units_text(half_up(half_up("v * c", "100") + " * 5", "10000"))} AS fee_amount FROM v""",
)
def paper_fills_by_notional(spark, sf):
    """Fills of orders that give notional and price only; one line in each order has a notional of 1e12 and more."""
    large = F.when(F.col("l_linenumber") == 1, 10**10).otherwise(1).cast("decimal(11,0)")
    cents_ = F.round(F.col("l_extendedprice") * 100).cast("decimal(14,0)")
    rows = table(spark, sf, "lineitem").select(
        *LEDGER_KEY,
        F.lit("LIMIT").alias("order_type"),
        F.lit(None).cast("decimal(37,12)").alias("quantity"),
        (cents_ * F.lit(Decimal("0.01")) * large).cast("decimal(37,12)").alias("requested_notional"),
        ((cents_ % 99991 + 3) * F.lit(Decimal("0.01"))).cast("decimal(37,12)").alias("price"),
    )
    rows = od.paper_fill(rows, "0.0005")
    return rows.select(*LEDGER_KEY, *[text12(c).alias(c) for c in ("executed_volume", "avg_executed_price", "fee_amount")])


@query(
    "spendable_balance",
    f"WITH {ACCOUNTS} SELECT currency, floor(coalesce(TRY_CAST(balance AS DECIMAL(18,2)), 0) * CAST(0.9995 AS DECIMAL(6,4)))::DOUBLE AS spendable FROM acct",
)
def spendable_balance(spark, sf):
    rows = od.balances(acc.account_by_currency(accounts(spark, sf)))
    return rows.select("currency", r(od.spendable(F.col("balance"), "0.0005")).alias("spendable"))


CHANCE = """
chance AS (SELECT 'KRW-S' || l_suppkey AS symbol, CASE WHEN l_suppkey % 6 <> 0 THEN sum(l_quantity) * 100 END AS bid,
  CASE WHEN l_suppkey % 5 <> 0 THEN max(l_quantity) END AS ask, CASE WHEN l_suppkey % 3 = 0 THEN CAST(max(l_linenumber) AS DOUBLE) END AS avg_buy
  FROM lineitem GROUP BY l_suppkey),
ticks AS (SELECT 'KRW-S' || l_suppkey AS symbol, CAST(min(CASE WHEN l_suppkey % 2 = 0 THEN l_quantity END) AS DOUBLE) AS last_price FROM lineitem GROUP BY l_suppkey)"""


def _chance_json(spark, sf):
    """Nested order-chance records per symbol; some lack an account branch."""
    s = F.col("l_suppkey")
    t = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.sum("l_quantity").alias("q"), F.max("l_quantity").alias("m"), F.max("l_linenumber").alias("n")
    )
    text = lambda c: c.cast("string")
    bid = F.struct(text(F.col("q") * 100).alias("balance"), F.lit("1.5").alias("locked"))
    ask = F.struct(
        text(F.col("m")).alias("balance"),
        F.lit(None).cast("string").alias("locked"),
        F.when(s % 3 == 0, text(F.col("n"))).alias("avg_buy_price"),
    )
    return t.select(
        F.concat(F.lit("KRW-S"), text(s)).alias("symbol"),
        F.lit("0.0005").alias("bid_fee"),
        F.lit("0.0005").alias("ask_fee"),
        F.when(s % 6 != 0, bid).alias("bid_account"),
        F.when(s % 5 != 0, ask).alias("ask_account"),
        F.struct(
            F.struct(F.lit("5000").alias("min_total")).alias("bid"), F.struct(F.lit("").alias("min_total")).alias("ask")
        ).alias("market"),
    )


@query(
    "order_chance_flat",
    f"""WITH {CHANCE} SELECT symbol, coalesce(bid, 0)::DOUBLE AS bid_balance, CASE WHEN bid IS NULL THEN 0.0::DOUBLE ELSE 1.5::DOUBLE END AS bid_locked,
    coalesce(ask, 0)::DOUBLE AS ask_balance, CASE WHEN ask IS NOT NULL THEN coalesce(avg_buy, 0) ELSE 0 END::DOUBLE AS ask_avg_buy_price,
    5000.0::DOUBLE AS bid_min_total, 0.0::DOUBLE AS ask_min_total FROM chance""",
)
def order_chance_flat(spark, sf):
    rows = od.flatten_chance(_chance_json(spark, sf))
    cols = ["bid_balance", "bid_locked", "ask_balance", "ask_avg_buy_price", "bid_min_total", "ask_min_total"]
    return rows.select("symbol", *[r(c).alias(c) for c in cols])


ESTIMATE = f"""{VALID}, {CHANCE},
sized AS (SELECT v.*, {NOTIONAL} AS notional, coalesce(c.bid, 0) AS bid, coalesce(c.ask, 0) AS ask,
  CASE WHEN c.ask IS NOT NULL THEN coalesce(c.avg_buy, 0) ELSE 0 END AS avg_buy, t.last_price
  FROM valid v LEFT JOIN chance c USING (symbol) LEFT JOIN ticks t USING (symbol) WHERE v.mode = 'LIVE'),
ref AS (SELECT *, CASE WHEN price > 0 THEN price WHEN avg_buy > 0 THEN avg_buy WHEN last_price > 0 THEN last_price END AS reference,
  floor(bid * 0.9995) AS budget FROM sized),
est AS (SELECT *, CASE WHEN notional > 0 THEN notional WHEN order_type = 'MARKET_BUY' THEN CASE WHEN budget > 0 THEN budget END
  WHEN order_type = 'MARKET_SELL' THEN quantity * reference ELSE coalesce(notional, 0) END AS amount FROM ref)"""


def _estimated(spark, sf):
    ticks = table(spark, sf, "lineitem").groupBy(F.concat(F.lit("KRW-S"), F.col("l_suppkey").cast("string")).alias("symbol")).agg(
        F.min(F.when(F.col("l_suppkey") % 2 == 0, F.col("l_quantity"))).alias("last_price")
    )
    orders = _orders(spark, sf).where(F.col("mode") == "LIVE").withColumnRenamed("market", "symbol")
    return od.with_notional_estimate(orders, od.flatten_chance(_chance_json(spark, sf)), ticks, "0.0005")


@query(
    "notional_estimate",
    f"""WITH {ESTIMATE} SELECT {KEY}, round(amount, 6) + 0.0 AS estimated_notional, CASE WHEN amount IS NULL THEN
    CASE WHEN order_type = 'MARKET_BUY' THEN 'insufficient_balance' ELSE 'missing_reference_price' END END AS estimate_error FROM est""",
)
def notional_estimate(spark, sf):
    return _estimated(spark, sf).select(*LEDGER_KEY, r("estimated_notional").alias("estimated_notional"), "estimate_error")


@query(
    "balance_check",
    f"""WITH {ESTIMATE} SELECT {KEY}, CASE WHEN side = 'BUY' THEN bid >= amount ELSE ask >= coalesce(quantity, 0) END AS sufficient
    FROM est WHERE amount IS NOT NULL""",
)
def balance_check(spark, sf):
    rows = _estimated(spark, sf).where(F.col("estimate_error").isNull())
    return rows.select(*LEDGER_KEY, od.balance_sufficient().alias("sufficient"))


@query(
    "exchange_requests",
    f"""WITH {VALID} SELECT {KEY}, CASE WHEN side = 'BUY' THEN 'bid' ELSE 'ask' END AS side,
    CASE order_type WHEN 'LIMIT' THEN 'limit' WHEN 'MARKET_BUY' THEN 'price' ELSE 'market' END AS ord_type,
    CASE WHEN order_type <> 'MARKET_BUY' THEN regexp_replace(regexp_replace(CAST(CAST(quantity AS DECIMAL(24,12)) AS VARCHAR), '0+$', ''), '\\.$', '') END AS volume,
    CASE WHEN order_type <> 'MARKET_SELL' THEN regexp_replace(regexp_replace(CAST(CAST(CAST(price AS DECIMAL(18,2)) AS DECIMAL(24,12)) AS VARCHAR), '0+$', ''), '\\.$', '') END AS price
    FROM valid""",
)
def exchange_requests(spark, sf):
    good = _orders(spark, sf).withColumnRenamed("market", "symbol")
    keyed = good.withColumn("client_order_id", F.struct(*LEDGER_KEY))
    rows = od.exchange_request(keyed)
    return rows.select(*[F.col(f"identifier.{c}").alias(c) for c in LEDGER_KEY], "side", "ord_type", "volume", "price")


@query(
    "signal_order_requests",
    f"""{LIVE_SQL} SELECT market, CASE WHEN buy_signal THEN 'BUY' ELSE 'SELL' END AS side,
    round(CASE WHEN buy_signal THEN floor(100000 / close * 1e8) / 1e8 ELSE qty END, 6) + 0.0 AS quantity,
    round(CASE WHEN buy_signal THEN 100000 ELSE close END, 6) + 0.0 AS price FROM signals WHERE buy_signal OR (sell_signal AND qty > 0)""",
)
def signal_order_requests(spark, sf):
    rows = od.signal_requests(live(spark, sf), "PAPER", "100000")
    return rows.select("market", "side", r("quantity").alias("quantity"), r("price").alias("price"))


@query(
    "paper_buy_sizes",
    f"""WITH {CANDLES} SELECT market, {"strftime(ts, '%Y-%m-%d')"} AS day,
    {units_text("100000 * CAST(10000000000000000000 AS HUGEINT) // CAST(round(close * 10000000) AS HUGEINT)")} AS quantity FROM candles""",
)
def paper_buy_sizes(spark, sf):
    """Size of a paper buy at each close (seven places), as if every candle gave a buy signal."""
    c = candles(spark, sf).withColumn("close", F.round("close", 7).cast("decimal(37,12)"))
    c = c.withColumns({"buy_signal": F.lit(True), "sell_signal": F.lit(False), "position_qty": F.lit(0.0)})
    rows = od.signal_requests(c.withColumnRenamed("ts", "signal_ts"), "PAPER", "100000")
    return rows.select("market", day("signal_ts").alias("day"), text12("quantity").alias("quantity"))


@query(
    "slippage",
    f"""WITH {CANDLES} SELECT market, {"strftime(ts, '%Y-%m-%d')"} AS day, round((close / open - 1) * 100, 6) + 0.0 AS slippage_pct,
    round((close / open - 1) * 10000, 4) + 0.0 AS slippage_bps FROM candles""",
)
def slippage(spark, sf):
    pct = od.slippage_pct(F.col("open"), F.col("close"))
    return candles(spark, sf).select("market", day().alias("day"), r(pct).alias("slippage_pct"), r(pct * 100, 4).alias("slippage_bps"))


@query(
    "unrealized_returns",
    f"""{LIVE_SQL} SELECT market, round(CASE WHEN has AND avg_price > 0 THEN (close / avg_price - 1) * 100 END, 6) + 0.0 AS unrealized_return_pct FROM signals""",
)
def unrealized_returns(spark, sf):
    pct = od.unrealized_return_pct(F.col("has_position"), F.col("close"), F.col("position_avg_price"))
    return live(spark, sf).select("market", r(pct).alias("unrealized_return_pct"))


# --- ledger folds ---------------------------------------------------------------------------------------------


@query(
    "managed_quantity",
    f"""WITH {FILLED}, d AS (SELECT symbol, rn, CASE WHEN side = 'BUY' THEN qty ELSE -qty END AS d FROM filled),
    w AS (SELECT symbol, rn, sum(d) OVER (PARTITION BY symbol ORDER BY rn) AS w FROM d),
    l AS (SELECT *, least(0, min(w) OVER (PARTITION BY symbol ORDER BY rn)) AS low FROM w)
    SELECT symbol, arg_max(w - low, rn) AS managed_qty FROM l GROUP BY symbol""",
)
def managed_quantity_query(spark, sf):
    rows = managed_quantity(filled_orders(spark, sf), ["symbol"], LEDGER_ORDER)
    return rows.select("symbol", F.col("managed_qty").cast("double").alias("managed_qty"))


def trips_sql(filled: str) -> str:
    """Round trips of a CTE ``filled``, stepping order by order."""
    return filled + """,
run AS (
  SELECT symbol, rn, CASE WHEN side = 'BUY' THEN qty ELSE 0 END::DOUBLE AS held, CASE WHEN side = 'BUY' THEN price * qty + fee ELSE 0 END::DOUBLE AS basis,
    0.0::DOUBLE AS pnl, 0.0::DOUBLE AS cost, 0::BIGINT AS trip, false AS closed FROM filled WHERE rn = 1
  UNION ALL
  SELECT symbol, rn, CASE WHEN side = 'BUY' THEN before + qty ELSE before - sold END, CASE WHEN side = 'BUY' THEN basis0 + price * qty + fee
      WHEN before - sold > 0 THEN basis0 - basis0 * sold / before ELSE 0 END,
    CASE WHEN sold > 0 THEN price * sold - fee * sold / qty - basis0 * sold / before ELSE 0 END,
    CASE WHEN sold > 0 THEN basis0 * sold / before ELSE 0 END, trip, sold > 0 AND before - sold = 0
  FROM (SELECT f.*, r.held AS before, r.basis AS basis0, r.trip + CASE WHEN r.closed THEN 1 ELSE 0 END AS trip,
          CASE WHEN f.side = 'SELL' THEN least(r.held, f.qty) ELSE 0 END AS sold
        FROM run r JOIN filled f ON f.symbol = r.symbol AND f.rn = r.rn + 1)),
live AS (SELECT * FROM run WHERE held > 0 OR closed),
trips AS (SELECT symbol, trip, sum(pnl) AS pnl, sum(cost) AS cost, bool_or(closed) AS closed FROM live GROUP BY 1, 2)"""


TRIPS = f"WITH RECURSIVE {trips_sql(FILLED)}"


@query(
    "round_trips",
    f"{TRIPS} SELECT symbol, trip, round(pnl, 7) + 0.0 AS pnl, round(cost, 7) + 0.0 AS cost, closed FROM trips",
)
def round_trips_query(spark, sf):
    rows = round_trips(filled_orders(spark, sf), ["symbol"], LEDGER_ORDER)
    return rows.select("symbol", "trip", r("pnl", 7).alias("pnl"), r("cost", 7).alias("cost"), "closed")


METRICS_SQL = """
rets AS (SELECT *, CASE WHEN closed AND cost > 0 THEN pnl / cost * 100 END AS ret FROM trips),
    curve AS (SELECT *, product(1 + coalesce(ret, 0) / 100) OVER (PARTITION BY symbol ORDER BY trip) AS c FROM rets),
    peak AS (SELECT *, greatest(1, max(c) OVER (PARTITION BY symbol ORDER BY trip)) AS p FROM curve),
    s AS (SELECT symbol, sum(pnl) AS pnl, sum(cost) AS cost, count(ret) AS n, count(*) FILTER (ret > 0) AS w, avg(ret) FILTER (ret > 0) AS aw,
      -avg(ret) FILTER (ret < 0) AS al, avg(ret) AS ex, least(0, min((c / p - 1) * 100)) AS dd FROM peak GROUP BY symbol),
    metrics AS (SELECT symbol, pnl AS realized_pnl, CASE WHEN cost > 0 THEN pnl / cost * 100 END AS realized_return_pct,
      CASE WHEN n > 0 THEN dd END AS max_drawdown_pct, n AS trade_count, CASE WHEN n > 0 THEN w * 100.0 / n END AS win_rate_pct,
      aw AS avg_win_pct, al AS avg_loss_pct, CASE WHEN al > 0 THEN aw / al END AS rr_ratio, ex AS expectancy_pct FROM s)"""


@query(
    "execution_metrics",
    f"""{TRIPS}, {METRICS_SQL}
    SELECT symbol, round(realized_pnl, 7) + 0.0 AS realized_pnl, trade_count, {", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in METRICS if c not in ("realized_pnl", "trade_count"))} FROM metrics""",
)
def execution_metrics_query(spark, sf):
    rows = execution_metrics(filled_orders(spark, sf), ["symbol"], LEDGER_ORDER)
    return rows.select("symbol", *[F.col(c) if c == "trade_count" else r(c, 7 if c == "realized_pnl" else 5).alias(c) for c in METRICS])


MARKET_FILLED = """
filled AS (
  SELECT o_orderpriority AS symbol, CASE WHEN o_orderkey % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS side,
         CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE 3 END AS qty, 100 + o_totalprice / 25000 AS price, 0.05::DOUBLE AS fee,
         row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS rn
  FROM orders)"""


def market_orders(spark, sf):
    """Filled orders of the same markets as the candles, out of orders."""
    sell = F.col("o_orderkey") % 3 == 0
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("symbol"),
        F.when(sell, "SELL").otherwise("BUY").alias("side"),
        F.when(sell, 7).otherwise(3).cast("decimal(38,12)").alias("executed_volume"),
        (100 + F.col("o_totalprice") / 25000).alias("avg_executed_price"),
        F.lit(0.05).alias("fee_amount"),
        "o_orderdate",
        "o_orderkey",
    )


EVENT_NUMBERS = {
    "close": "close", "live_price": "close + 1", "position_qty": "coalesce(qty, 0)", "position_avg_price": "coalesce(avg_price, 0)",
    "total_qty": "coalesce(qty, 0)",
    "unrealized_return_pct": "coalesce(CASE WHEN has AND avg_price > 0 THEN ((close + 1) / avg_price - 1) * 100 END, 0)",
    "realized_pnl_krw": "coalesce(m.realized_pnl, 0)", "realized_return_pct": "coalesce(m.realized_return_pct, 0)",
    "max_drawdown_pct": "coalesce(m.max_drawdown_pct, 0)", "trade_win_rate_pct": "coalesce(m.win_rate_pct, 0)",
    "trade_avg_win_pct": "coalesce(m.avg_win_pct, 0)", "trade_avg_loss_pct": "coalesce(m.avg_loss_pct, 0)",
    "trade_rr_ratio": "coalesce(m.rr_ratio, 0)", "trade_expectancy_pct": "coalesce(m.expectancy_pct, 0)",
}


@query(
    "candle_signal_events",
    f"""{LIVE_SQL}, {trips_sql(MARKET_FILLED)}, {METRICS_SQL}
    SELECT 'candle_signal' AS event, s.market, 'v5' AS strategy_version, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
    {", ".join(f"round({x}, 4) + 0.0 AS {c}" for c, x in EVENT_NUMBERS.items())}, has AS has_position,
    CAST(coalesce(m.trade_count, 0) AS BIGINT) AS trade_count, buy_signal, sell_signal, signal_reason,
    {DIAGNOSTIC_SQL} AS diagnostics, {SCHEMA_SQL} AS diagnostics_schema FROM signals s LEFT JOIN metrics m ON m.symbol = s.market""",
)
def candle_signal_events(spark, sf):
    from tidemark.plans.live import candle_signal_rows

    signals = live(spark, sf)
    ticks = signals.select("market", (F.col("close") + 1).alias("trade_price"))
    metrics = execution_metrics(market_orders(spark, sf), ["symbol"], ["o_orderdate", "o_orderkey"])
    rows = event_rows(candle_signal_rows(signals, metrics, ticks, digits=4), "candle_signal")
    rows = rows.withColumns({"ts": stamp("ts"), "trade_count": F.col("trade_count").cast("bigint")})
    return rows.withColumns({c: r(c, 4) for c in EVENT_NUMBERS})


@query(
    "weighted_positions",
    f"""WITH RECURSIVE {FILLED},
    exact AS (SELECT symbol, rn, side, CAST(qty AS HUGEINT) * 1000000000000 AS qty, CAST(round(price * 1e12) AS HUGEINT) AS price FROM filled),
    pos AS (
      SELECT symbol, rn, CASE WHEN side = 'BUY' THEN qty ELSE 0 END::HUGEINT AS q, CASE WHEN side = 'BUY' THEN price ELSE 0 END::HUGEINT AS a FROM exact WHERE rn = 1
      UNION ALL
      SELECT f.symbol, f.rn, CASE WHEN f.side = 'BUY' THEN p.q + f.qty ELSE greatest(0::HUGEINT, p.q - f.qty) END,
        CASE WHEN f.side = 'BUY' THEN {half_up('p.a * p.q + f.price * f.qty', 'p.q + f.qty')} WHEN p.q - f.qty <= 0 THEN 0 ELSE p.a END
      FROM pos p JOIN exact f ON f.symbol = p.symbol AND f.rn = p.rn + 1)
    SELECT symbol, {units_text('q')} AS qty, {units_text('a')} AS avg_price, CASE WHEN q > 0 THEN 'LONG' ELSE 'FLAT' END AS state FROM pos
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) = 1""",
)
def weighted_positions_query(spark, sf):
    moves = filled_orders(spark, sf).withColumnsRenamed({"executed_volume": "qty", "avg_executed_price": "price"})
    rows = weighted_positions(moves, ["symbol"], LEDGER_ORDER)
    return rows.select("symbol", text12("qty").alias("qty"), text12("avg_price").alias("avg_price"), "state")


# --- reconciliation -------------------------------------------------------------------------------------------


@query(
    "order_status_map",
    """SELECT event_type, value > 50 AS executed, CASE WHEN event_type = 'purchase' THEN 'FILLED' WHEN event_type = 'error' THEN 'CANCELED'
    WHEN value > 50 THEN 'PARTIALLY_FILLED' ELSE 'SUBMITTED' END AS status, count(*) AS n FROM events GROUP BY ALL""",
)
def order_status_map(spark, sf):
    e = table(spark, sf, "events")
    state = F.when(F.col("event_type") == "purchase", "Done").when(F.col("event_type") == "error", "CANCEL").otherwise("wait")
    done = F.when(F.col("value") > 50, 1).otherwise(0)
    rows = e.select("event_type", (F.col("value") > 50).alias("executed"), rec.order_status(state, done).alias("status"))
    return rows.groupBy("event_type", "executed", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "exploded_trades",
    f"""WITH {SNAPSHOTS} SELECT order_id, event_id, CAST(pos AS BIGINT) AS pos, strftime(filled_at, '%Y-%m-%d %H:%M:%S') AS filled_at, trade_id,
    volume::DOUBLE AS fill_qty, price::DOUBLE AS fill_price, CAST(CAST(funds AS DECIMAL(38,12)) AS VARCHAR) AS funds FROM trades""",
)
def exploded_trades(spark, sf):
    rows = rec.explode_trades(order_snapshots(spark, sf))
    num = [F.col(c).cast("double").alias(c) for c in ("fill_qty", "fill_price")]
    return rows.select(
        "order_id", F.col("seq.event_id").alias("event_id"), F.col("pos").cast("bigint").alias("pos"),
        stamp("filled_at").alias("filled_at"), "trade_id", *num, text12("funds").alias("funds"),
    )


@query(
    "new_fills",
    f"""WITH {SNAPSHOTS} SELECT order_id, strftime(filled_at, '%Y-%m-%d %H:%M:%S') AS filled_at, trade_id, event_id, volume::DOUBLE AS fill_qty
    FROM fills WHERE (order_id, filled_at, trade_id) NOT IN (SELECT (order_id, filled_at, trade_id) FROM fills WHERE event_id % 4 = 0)""",
)
def new_fills(spark, sf):
    fills = materialize(rec.first_fills(rec.explode_trades(order_snapshots(spark, sf))))
    known = fills.where(F.col("seq.event_id") % 4 == 0).select("order_id", "filled_at", "trade_id")
    rows = rec.new_fills(fills, known)
    return rows.select(
        "order_id", stamp("filled_at").alias("filled_at"), "trade_id", F.col("seq.event_id").alias("event_id"),
        F.col("fill_qty").cast("double").alias("fill_qty"),
    )


@query("order_vwap", f"WITH {SNAPSHOTS} SELECT order_id, event_id, {units_text('avg_price')} AS avg_price FROM snap")
def order_vwap(spark, sf):
    s = order_snapshots(spark, sf)
    return s.select("order_id", F.col("seq.event_id").alias("event_id"), text12(rec.average_price()).alias("avg_price"))


MOVED_SQL = f"""order_id, event_id, symbol, side, executed::DOUBLE AS executed_volume, {units_text("avg_price")} AS avg_executed_price, status,
    delta_qty::DOUBLE AS delta_qty, {units_text("delta_price")} AS delta_price"""


@query("reconciled_orders", f"WITH {SNAPSHOTS} SELECT {MOVED_SQL} FROM moved")
def reconciled_orders(spark, sf):
    return moved_columns(rec.reconcile(order_snapshots(spark, sf)).withColumn("event_id", F.col("seq.event_id")))


def moved_columns(rows):
    return rows.select(
        "order_id", "event_id", "symbol", "side", F.col("executed_volume").cast("double").alias("executed_volume"),
        text12("avg_executed_price").alias("avg_executed_price"), "status",
        F.col("delta_qty").cast("double").alias("delta_qty"), text12("delta_price").alias("delta_price"),
    )


@query(
    "reconciled_positions",
    f"""WITH RECURSIVE {SNAPSHOTS},
    mv AS (SELECT symbol, side, delta_qty::DOUBLE AS qty, delta_price / 1e12 AS price, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) AS rn FROM moved WHERE delta_qty > 0),
    pos AS (
      SELECT symbol, rn, CASE WHEN side = 'BUY' THEN qty ELSE 0 END AS q, CASE WHEN side = 'BUY' THEN price ELSE 0 END AS a FROM mv WHERE rn = 1
      UNION ALL
      SELECT f.symbol, f.rn, CASE WHEN f.side = 'BUY' THEN p.q + f.qty ELSE greatest(0, p.q - f.qty) END,
        CASE WHEN f.side = 'BUY' THEN (p.a * p.q + f.price * f.qty) / (p.q + f.qty) WHEN p.q - f.qty <= 1e-9 THEN 0 ELSE p.a END
      FROM pos p JOIN mv f ON f.symbol = p.symbol AND f.rn = p.rn + 1)
    SELECT symbol, round(q, 4) + 0.0 AS qty, round(a, 5) + 0.0 AS avg_price, CASE WHEN q > 1e-9 THEN 'LONG' ELSE 'FLAT' END AS state FROM pos
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) = 1""",
)
def reconciled_positions(spark, sf):
    moves = rec.reconcile(order_snapshots(spark, sf)).where(F.col("delta_qty") > 0)
    moves = moves.select("symbol", "seq", "side", F.col("delta_qty").alias("qty"), F.col("delta_price").alias("price"))
    rows = weighted_positions(materialize(moves), ["symbol"], ["seq"])
    return rows.select("symbol", r("qty", 4).alias("qty"), r("avg_price", 5).alias("avg_price"), "state")


# --- batch twin of the signal filter --------------------------------------------------------------------------

DEDUP = """
sig AS (SELECT event_type AS market, CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, date_trunc('hour', ts) AS signal_ts, ts, event_id FROM events),
sent AS (SELECT *, lag(signal_ts) OVER (PARTITION BY market, side ORDER BY ts, event_id) AS before FROM sig)"""
DEDUP_SQL = f"WITH {DEDUP} SELECT market, side, strftime(signal_ts, '%Y-%m-%d %H:%M:%S') AS signal_ts, event_id FROM sent WHERE before IS DISTINCT FROM signal_ts"


def signal_stream_rows(events):
    """Signals out of events; repeated within the hour."""
    return events.select(
        F.col("event_type").alias("market"),
        F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        F.date_trunc("hour", F.col("ts")).cast("timestamp").alias("signal_ts"),
        F.col("ts").cast("timestamp").alias("at"),
        "event_id",
    )


@query("signal_dedup", DEDUP_SQL)
def signal_dedup(spark, sf):
    from tidemark.operators.signals import drop_repeats

    rows = drop_repeats(signal_stream_rows(table(spark, sf, "events")), ["at", "event_id"])
    return rows.select("market", "side", stamp("signal_ts").alias("signal_ts"), "event_id")
