"""Queries over stored ledger tables: written from the given tables, then read by their layout."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.catalog.base import LEDGER, LEDGER_KEY, ledger, query, r, stamp, table
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources.stores import PositionTable, order_by_id, orders_of, symbols_with_open_orders, write_orders

BATCHES = 4


def _path(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}"


@query(
    "stored_positions",
    f"""WITH ch AS (SELECT 'KRW-S' || l_suppkey AS symbol, l_orderkey % 64 AS slot, l_linenumber % {BATCHES} AS batch, l_quantity AS q, l_shipdate AS shipped FROM lineitem),
    b AS (SELECT symbol || '-' || slot AS symbol, batch, sum(q) AS qty, max(shipped) AS shipped FROM ch GROUP BY ALL)
    SELECT symbol, qty::DOUBLE AS qty, CAST(batch AS BIGINT) AS batch, strftime(shipped, '%Y-%m-%d %H:%M:%S') AS updated_at FROM b
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY batch DESC) = 1""",
)
def stored_positions(spark, sf):
    """Positions upserted in four batches, the third of them twice."""
    t = table(spark, sf, "lineitem").withColumns({"slot": F.col("l_orderkey") % 64, "batch": F.col("l_linenumber") % BATCHES})
    name = F.concat(F.lit("KRW-S"), F.col("l_suppkey").cast("string"), F.lit("-"), F.col("slot").cast("string"))
    rows = t.groupBy(name.alias("symbol"), "batch").agg(F.sum("l_quantity").cast("decimal(38,12)").alias("qty"), F.max("l_shipdate").alias("updated_at"))
    positions = PositionTable(spark, _path(spark), "symbol string, qty decimal(38,12), batch bigint, updated_at timestamp", buckets=16)
    for batch in (0, 1, 2, 2, 3):
        positions.upsert(rows.where(F.col("batch") == batch), batch)
    return positions.read().select("symbol", F.col("qty").cast("double").alias("qty"), "batch", stamp("updated_at").alias("updated_at"))


def _stored_orders(spark, sf) -> str:
    path = _path(spark)
    number = F.concat_ws("-", *[F.col(c).cast("string") for c in LEDGER_KEY])
    write_orders(ledger(spark, sf).withColumn("client_order_id", number), path)
    return path


@query(
    "stored_order_scan",
    f"""WITH {LEDGER} SELECT symbol, mode, status, CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, round(price, 2) + 0.0 AS price
    FROM ledger WHERE mode = 'LIVE' AND status = 'FILLED' AND symbol = 'KRW-S7'""",
)
def stored_order_scan(spark, sf):
    rows = orders_of(spark, _stored_orders(spark, sf), "KRW-S7", "LIVE", "FILLED", "l_shipdate")
    number = F.col("l_linenumber").cast("bigint").alias("l_linenumber")
    return rows.select("symbol", "mode", "status", "l_orderkey", number, "l_partkey", r("price", 2).alias("price"))


@query(
    "stored_order_lookup",
    f"""WITH {LEDGER}, first AS (SELECT * FROM ledger ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 1)
    SELECT l.symbol, l.mode, l.status, l.l_orderkey, l.l_partkey FROM ledger l JOIN first f
      ON l.l_orderkey = f.l_orderkey AND l.l_linenumber = f.l_linenumber AND l.l_partkey = f.l_partkey""",
)
def stored_order_lookup(spark, sf):
    """The order with the smallest key, looked up by its id."""
    first = ledger(spark, sf).agg(F.min(F.struct(*LEDGER_KEY)).alias("k")).first()["k"]
    rows = order_by_id(spark, _stored_orders(spark, sf), "-".join(map(str, first or ())))
    return rows.select("symbol", "mode", "status", "l_orderkey", "l_partkey")


@query(
    "stored_open_symbols",
    f"WITH {LEDGER} SELECT DISTINCT symbol FROM ledger WHERE mode = 'PAPER' AND status IN ('CREATED', 'SUBMITTED', 'PARTIALLY_FILLED')",
)
def stored_open_symbols(spark, sf):
    return symbols_with_open_orders(spark, _stored_orders(spark, sf), "PAPER")
