"""Query registry and the inputs that queries derive from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.scan import lay_out
from tidemark.session import compile_in_pieces
from tidemark.sources.candles import candles_from_trades

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, if there is one, the SQL that gives the same rows."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    compile_in_pieces(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(x: Column | str, digits: int = 6) -> Column:
    """Rounded double without negative zero."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x.cast("double"), digits) + F.lit(0.0)


def day(x: str = "ts") -> Column:
    return F.date_format(F.col(x), "yyyy-MM-dd")


def stamp(x: str = "ts") -> Column:
    return F.date_format(F.col(x), "yyyy-MM-dd HH:mm:ss")


def candles(spark: SparkSession, sf: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Daily candles: market = order priority, price from the order total."""
    price = 100 + F.col("o_totalprice") / 25000
    return candles_from_trades(table(spark, sf, "orders"), "o_orderpriority", "o_orderdate", price, "o_orderkey", start=start, end=end)


CANDLES = """
candles AS (
  SELECT o_orderpriority AS market, date_trunc('day', o_orderdate) AS ts,
         arg_min(100 + o_totalprice / 25000, o_orderkey) AS open, max(100 + o_totalprice / 25000) AS high,
         min(100 + o_totalprice / 25000) AS low, arg_max(100 + o_totalprice / 25000, o_orderkey) AS close,
         CAST(count(*) AS DOUBLE) AS volume
  FROM orders GROUP BY 1, 2),
bars AS (
  SELECT *, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY market) AS n,
         lag(close) OVER w AS pc, lead(open) OVER w AS nopen
  FROM candles WINDOW w AS (PARTITION BY market ORDER BY ts))"""


def ema_cte(name: str, source: str, keys: str, x: str, length: int, alpha: str | None = None) -> str:
    """Recursive average seeded with the mean of the first ``length`` rows of ``source(keys, idx, n, x)``."""
    a = alpha or f"(2.0 / {length + 1})"
    cols = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"s.{c} = e.{c}" for c in cols)
    pick = ", ".join(f"s.{c}" for c in cols)
    return f"""
{name} AS (
  SELECT {keys}, CAST({length - 1} AS BIGINT) AS idx, avg({x}) AS v FROM {source}
  WHERE idx < {length} AND n >= {length} GROUP BY {keys}
  UNION ALL
  SELECT {pick}, s.idx, {a} * s.{x} + (1 - {a}) * e.v FROM {name} e JOIN {source} s ON {on} AND s.idx = e.idx + 1)"""


LEDGER_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
LEDGER_SORT = ", ".join(LEDGER_ORDER)


def filled_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Filled orders out of line items: symbol = supplier, side from the line status."""
    t = table(spark, sf, "lineitem")
    return t.select(
        F.col("l_suppkey").alias("symbol"),
        F.when(F.col("l_linestatus") == "O", "BUY").otherwise("SELL").alias("side"),
        F.col("l_quantity").cast("decimal(38,12)").alias("executed_volume"),
        (100 + F.col("l_extendedprice") / 2000).alias("avg_executed_price"),
        F.col("l_tax").alias("fee_amount"),
        *LEDGER_ORDER,
    )


FILLED = f"""
filled AS (
  SELECT l_suppkey AS symbol, CASE WHEN l_linestatus = 'O' THEN 'BUY' ELSE 'SELL' END AS side,
         l_quantity AS qty, 100 + l_extendedprice / 2000 AS price, l_tax AS fee,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY {LEDGER_SORT}) AS rn, {LEDGER_SORT}
  FROM lineitem)"""


def ledger(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """Order rows of all types, modes and states out of line items, with ``more`` of their columns."""
    t = table(spark, sf, "lineitem")
    buy = F.col("l_linestatus") == "O"
    flag = F.col("l_returnflag")
    qty = F.when(F.col("l_linenumber") % 5 != 0, F.col("l_quantity").cast("decimal(24,12)"))
    price = F.when(F.col("l_linenumber") % 3 != 0, F.round(F.col("l_extendedprice"), 2).cast("decimal(24,12)"))
    other = F.when(F.col("l_partkey") % 10 == 0, F.when(buy, "MARKET_SELL").otherwise("MARKET_BUY"))
    kind = F.when(flag == "A", "LIMIT").otherwise(
        F.coalesce(other, F.when(buy, "MARKET_BUY").otherwise("MARKET_SELL"))
    )
    return t.select(
        F.concat(F.lit("KRW-S"), F.col("l_suppkey").cast("string")).alias("symbol"),
        F.when(F.col("l_partkey") % 97 == 0, F.lit(None)).when(buy, "BUY").otherwise("SELL").alias("side"),
        kind.alias("order_type"),
        F.when(F.col("l_tax") < 0.04, "PAPER").otherwise("LIVE").alias("mode"),
        F.when(F.col("l_partkey") % 53 == 0, -qty).otherwise(qty).alias("quantity"),
        price.alias("price"),
        F.when(flag == "R", "CANCELED").when(flag == "A", "SUBMITTED").otherwise("FILLED").alias("status"),
        *LEDGER_ORDER,
        *more,
    )


LEDGER = f"""
ledger AS (
  SELECT 'KRW-S' || l_suppkey AS symbol,
    CASE WHEN l_partkey % 97 = 0 THEN NULL WHEN l_linestatus = 'O' THEN 'BUY' ELSE 'SELL' END AS side,
    CASE WHEN l_returnflag = 'A' THEN 'LIMIT'
         WHEN l_partkey % 10 = 0 THEN CASE WHEN l_linestatus = 'O' THEN 'MARKET_SELL' ELSE 'MARKET_BUY' END
         WHEN l_linestatus = 'O' THEN 'MARKET_BUY' ELSE 'MARKET_SELL' END AS order_type,
    CASE WHEN l_tax < 0.04 THEN 'PAPER' ELSE 'LIVE' END AS mode,
    CASE WHEN l_linenumber % 5 <> 0 THEN CASE WHEN l_partkey % 53 = 0 THEN -l_quantity ELSE l_quantity END END AS quantity,
    CASE WHEN l_linenumber % 3 <> 0 THEN round(l_extendedprice, 2) END AS price,
    CASE WHEN l_returnflag = 'R' THEN 'CANCELED' WHEN l_returnflag = 'A' THEN 'SUBMITTED' ELSE 'FILLED' END AS status,
    {LEDGER_SORT}
  FROM lineitem)"""
LEDGER_KEY = ["l_orderkey", "l_linenumber", "l_partkey"]


def text12(x: Column | str) -> Column:
    """Ledger decimal as text with twelve places."""
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(38,12)").cast("string")


def units_text(units: str) -> str:
    """SQL text with twelve places of a non-negative whole number of 1e-12."""
    u = f"CAST({units} AS HUGEINT)"
    return f"(CAST({u} // 1000000000000 AS VARCHAR) || '.' || lpad(CAST({u} % 1000000000000 AS VARCHAR), 12, '0'))"


def half_up(a: str, b: str) -> str:
    """SQL for a / b of whole numbers, rounded half up."""
    return f"((2 * ({a}) + ({b})) // (2 * ({b})))"


def cents(x: str = "value") -> Column:
    return F.col(x).cast("decimal(18,2)").cast("string")


def accounts(spark: SparkSession, sf: str) -> DataFrame:
    """Account rows out of events: many rows per currency in both letter cases, some unreadable balances."""
    e = table(spark, sf, "events")
    code = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return e.select(
        F.when(F.col("event_id") % 2 == 0, F.upper(code)).otherwise(code).alias("currency"),
        F.when(F.col("event_id") % 11 == 0, "bad").otherwise(cents()).alias("balance"),
        (F.col("event_id") % 3).cast("string").alias("locked"),
        (F.col("event_id") % 1000 + 50).cast("string").alias("avg_buy_price"),
        F.lit("KRW").alias("unit_currency"),
        F.col("event_id").alias("seq"),
    )


ACCOUNTS = """
accounts AS (
  SELECT CASE WHEN event_id % 2 = 0 THEN 'U' || user_id ELSE 'u' || user_id END AS currency,
         CASE WHEN event_id % 11 = 0 THEN 'bad' ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS balance,
         CAST(event_id % 3 AS VARCHAR) AS locked, CAST(event_id % 1000 + 50 AS VARCHAR) AS avg_buy_price,
         'KRW' AS unit_currency, event_id AS seq
  FROM events),
acct AS (
  SELECT upper(currency) AS currency, arg_min(balance, seq) AS balance, arg_min(locked, seq) AS locked,
         arg_min(avg_buy_price, seq) AS avg_buy_price
  FROM accounts GROUP BY 1)"""


def user_markets(spark: SparkSession, sf: str) -> DataFrame:
    """Raw market codes of users: lower case, padded, repeated."""
    e = table(spark, sf, "events")
    return e.select(F.concat(F.lit(" krw-u"), F.col("user_id").cast("string"), F.lit(" ")).alias("market"))


def user_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Executed orders of users out of events."""
    e = table(spark, sf, "events")
    return e.select(
        F.concat(F.lit("KRW-U"), F.col("user_id").cast("string")).alias("symbol"),
        F.when(F.col("event_type").isin("view", "click", "signup"), "BUY").otherwise("SELL").alias("side"),
        F.floor("value").cast("decimal(24,12)").alias("executed_volume"),
        (100 + F.col("value") / 10).alias("price"),
        F.col("ts").alias("created_at"),
        "event_id",
    )


USER_MANAGED = """
moves AS (
  SELECT 'KRW-U' || user_id AS symbol, ts, event_id,
         CASE WHEN event_type IN ('view', 'click', 'signup') THEN floor(value) ELSE -floor(value) END AS d
  FROM events),
w AS (SELECT symbol, ts, event_id, sum(d) OVER o AS w FROM moves WINDOW o AS (PARTITION BY symbol ORDER BY ts, event_id)),
lowest AS (SELECT *, least(0, min(w) OVER (PARTITION BY symbol ORDER BY ts, event_id)) AS low FROM w),
managed AS (SELECT symbol, arg_max(w - low, (ts, event_id)) AS managed_qty FROM lowest GROUP BY symbol)"""


def order_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Polled order snapshots out of events: order = user, executed volume grows with each event.

    Each snapshot lists its own trade and the one before, some without id or funds.
    """
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    e, series = lay_out(e, ["user_id"], ["ts", "event_id"])
    trade = F.struct(
        F.lit("KRW-BTC").alias("market"),
        F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit("t"), F.col("event_id").cast("string"))).alias("uuid"),
        (F.col("event_id") % 90 + 10).cast("string").alias("price"),
        cents().alias("volume"),
        F.when(F.col("event_id") % 3 == 0, "0")
        .otherwise((F.col("value").cast("decimal(18,2)") * 20).cast("decimal(18,2)").cast("string"))
        .alias("funds"),
        F.lit("bid").alias("side"),
        F.when(F.col("event_id") % 7 == 0, "soon")
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .alias("created_at"),
    )
    e = series.running(e.withColumn("t", trade), sum=("sum", F.col("value").cast("decimal(18,2)")))
    e = series.shift(e, before=F.col("t"))
    trades = F.when(F.col("before").isNull(), F.array("t")).otherwise(F.array("t", "before"))
    user = F.col("user_id").cast("string")
    return e.select(
        F.concat(F.lit("o"), user).alias("order_id"),
        F.struct("ts", "event_id").alias("seq"),
        F.concat(F.lit("KRW-A"), (F.col("user_id") % 10).cast("string")).alias("symbol"),
        F.when(F.col("user_id") % 3 == 0, "SELL").otherwise("BUY").alias("order_side"),
        F.concat(F.lit("x"), user).alias("uuid"),
        F.when(F.col("event_type") == "purchase", "DONE").when(F.col("event_type") == "error", "Cancel").otherwise("wait").alias("state"),
        F.col("sum").cast("string").alias("executed_volume"),
        (F.col("event_id") % 90 + 10).cast("string").alias("price"),
        F.lit("0.5").alias("paid_fee"),
        trades.alias("trades"),
    )


SNAPSHOTS = f"""
ev AS (
  SELECT 'o' || user_id AS order_id, user_id, ts, event_id, event_type,
    CAST(value AS DECIMAL(18,2)) AS volume, CAST(event_id % 90 + 10 AS DECIMAL(18,2)) AS price,
    CASE WHEN event_id % 3 = 0 THEN 0 ELSE CAST(value AS DECIMAL(18,2)) * 20 END AS funds,
    CASE WHEN event_id % 7 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS created_text,
    CASE WHEN event_id % 7 = 0 THEN TIMESTAMP '1970-01-01' ELSE date_trunc('second', ts) END AS filled_at,
    CASE WHEN event_id % 5 = 0 THEN '' ELSE 't' || event_id END AS uuid,
    sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS executed
  FROM events),
pairs AS (
  SELECT order_id, ts, event_id, 0 AS pos, volume, price, funds, created_text, filled_at, uuid FROM ev
  UNION ALL
  SELECT order_id, ts, event_id, 1, lag(volume) OVER w, lag(price) OVER w, lag(funds) OVER w, lag(created_text) OVER w,
         lag(filled_at) OVER w, lag(uuid) OVER w
  FROM ev WINDOW w AS (PARTITION BY order_id ORDER BY ts, event_id)),
trades AS (
  SELECT order_id, ts, event_id, pos, volume, price, CASE WHEN funds > 0 THEN funds ELSE price * volume END AS funds,
         funds AS given_funds, filled_at,
         CASE WHEN uuid = '' THEN order_id || ':' || created_text || ':' || CAST(CAST(price AS INTEGER) AS VARCHAR) || ':'
              || CAST(volume AS VARCHAR) || ':' || pos ELSE uuid END AS trade_id
  FROM pairs WHERE volume IS NOT NULL),
fills AS (
  SELECT * FROM trades QUALIFY row_number() OVER (PARTITION BY order_id, filled_at, trade_id ORDER BY ts, event_id, pos) = 1),
fresh AS (SELECT order_id, ts, event_id, sum(volume) AS q, sum(funds) AS f FROM fills GROUP BY ALL),
vw AS (SELECT order_id, ts, event_id, sum(given_funds) AS f, sum(volume) AS v FROM trades GROUP BY ALL),
snap AS (
  SELECT ev.*, executed - coalesce(lag(executed) OVER (PARTITION BY ev.order_id ORDER BY ev.ts, ev.event_id), 0) AS delta,
    CASE WHEN vw.v > 0 THEN {half_up("CAST(vw.f * 100 AS HUGEINT) * 1000000000000", "CAST(vw.v * 100 AS HUGEINT)")}
      ELSE CAST(ev.price * 100 AS HUGEINT) * 10000000000 END AS avg_price,
    {half_up("CAST(fresh.f * 10000 AS HUGEINT) * 10000000000", "CAST(fresh.q * 100 AS HUGEINT)")} AS fresh_price, fresh.q AS fresh_qty
  FROM ev LEFT JOIN vw USING (order_id, ts, event_id) LEFT JOIN fresh USING (order_id, ts, event_id)),
moved AS (
  SELECT order_id, ts, event_id, 'KRW-A' || (user_id % 10) AS symbol,
    CASE WHEN user_id % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS side, executed, avg_price,
    CASE WHEN event_type = 'purchase' THEN 'FILLED' WHEN event_type = 'error' THEN 'CANCELED'
         WHEN executed > 0 THEN 'PARTIALLY_FILLED' ELSE 'SUBMITTED' END AS status,
    CASE WHEN delta > 0 THEN delta END AS delta_qty,
    CASE WHEN delta > 0 THEN CASE WHEN fresh_qty > 0 THEN fresh_price ELSE avg_price END END AS delta_price
  FROM snap)"""
