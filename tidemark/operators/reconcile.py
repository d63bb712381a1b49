"""Order snapshots to fills, order columns and position moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import AMOUNT, WIDE, dec, div_half_up, let, mul12
from tidemark.operators.scan import lay_out
from tidemark.session import work_partitions

EPOCH = "1970-01-01 00:00:00"
SNAPSHOT_SCHEMA = (
    "uuid string, side string, ord_type string, price string, state string, market string, created_at string, "
    "volume string, remaining_volume string, reserved_fee string, remaining_fee string, paid_fee string, "
    "locked string, executed_volume string, trades_count int, "
    "trades array<struct<market:string,uuid:string,price:string,volume:string,funds:string,side:string,created_at:string>>"
)


def order_status(state: Column, executed: Column) -> Column:
    """Ledger status of an exchange state, in any letter case."""
    return (
        F.when(F.lower(state) == "done", "FILLED")
        .when(F.lower(state) == "cancel", "CANCELED")
        .when(executed > 0, "PARTIALLY_FILLED")
        .otherwise("SUBMITTED")
    )


def trade_key(t: Column, pos: Column) -> Column:
    """Id of a trade; a blank one is built from order, time, price, volume and position."""
    blank = F.length(F.trim(F.coalesce(t["uuid"], F.lit("")))) == 0
    parts = [F.coalesce(t[c], F.lit("")) for c in ("created_at", "price", "volume")]
    built = F.concat_ws(":", F.col("order_id"), *parts, pos.cast("string"))
    return F.when(blank, built).otherwise(t["uuid"])


def trade_cells(rows: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and position, fill key and amounts of the trade ``_t`` at ``_pos``; null where there is none.

    ``filled_at`` is the epoch when the text has no readable time with offset; ``trade_id`` is ``trade_key``. Each amount
    is a column before the next one names it, so that its text is read once.
    """
    t, pos, there = F.col("_t"), F.col("_pos"), F.col("_t").isNotNull()
    with_zone = F.endswith(t["created_at"], F.lit("Z")) | t["created_at"].rlike(r"(Z|[+-]\d{2}:?\d{2})$")  # mostly without a pattern
    at = F.when(with_zone, t["created_at"].try_cast("timestamp"))
    cells = {
        "pos": pos.cast("int"),
        "filled_at": F.coalesce(at, F.lit(EPOCH).cast("timestamp")),
        "trade_id": trade_key(t, pos),
        "fill_qty": dec(t["volume"]),
        "fill_price": dec(t["price"]),
        "given_funds": dec(t["funds"]),
    }
    rows = rows.select(*keep, *[F.when(there, x).alias(c) for c, x in cells.items()])
    worth = mul12(F.col("fill_price"), F.col("fill_qty"))
    return rows.withColumn("funds", F.when(F.col("given_funds") > 0, F.col("given_funds").cast(WIDE)).otherwise(worth))


def explode_trades(snapshots: DataFrame) -> DataFrame:
    """One row per trade of each snapshot."""
    rows = snapshots.select("order_id", "seq", F.posexplode("trades").alias("_pos", "_t"))
    return trade_cells(rows, "order_id", "seq")


def first_fills(trades: DataFrame) -> DataFrame:
    """Each fill (order, time, trade id) once, as the first snapshot brought it."""
    rest = [c for c in trades.columns if c not in ("order_id", "filled_at", "trade_id")]
    first = F.min_by(F.struct(*rest), F.struct("seq", "pos")).alias("f")
    return trades.groupBy("order_id", "filled_at", "trade_id").agg(first).select(
        "order_id", "filled_at", "trade_id", *[F.col(f"f.{c}").alias(c) for c in rest]
    )


def new_fills(fills: DataFrame, known: DataFrame) -> DataFrame:
    """Fills whose (order, time, trade id) is not in the ledger yet."""
    return fills.join(known, ["order_id", "filled_at", "trade_id"], "left_anti")


def _trade_sums() -> dict[str, Column]:
    """Funds and volume of a snapshot's trades; null from where they no longer fit."""
    total = lambda f: F.aggregate(
        F.col("trades"), F.lit(0).cast(AMOUNT), lambda acc, t: F.try_add(acc, dec(t[f])).try_cast(AMOUNT)
    )
    return {"_funds": total("funds"), "_volume": total("volume")}


def _price_of(funds: Column, volume: Column) -> Column:
    return F.when(volume > 0, div_half_up(funds, volume))


def average_price() -> Column:
    """Volume-weighted price over a snapshot's trades; the order price without trades or volume."""
    sums = F.struct(*[c.alias(n) for n, c in _trade_sums().items()])  # added up once
    return F.coalesce(let(sums, lambda s: _price_of(s["_funds"], s["_volume"])), dec(F.col("price")).cast(WIDE))


def with_average_price(rows: DataFrame) -> DataFrame:
    """``average_price`` as a column, with the sums as columns before it, so that Spark compiles the quotient."""
    price = F.coalesce(_price_of(F.col("_funds"), F.col("_volume")), dec(F.col("price")).cast(WIDE))
    return rows.withColumns(_trade_sums()).withColumn("avg_executed_price", price).drop("_funds", "_volume")


def reconcile(
    snapshots: DataFrame, rows_per_task: int | None = None, fills: DataFrame | None = None
) -> DataFrame:
    """Order columns after each snapshot and the position move it causes.

    A snapshot moves the position only when the executed volume grew; the price is that of the fills the
    snapshot brought first, else the order's average.  ``snapshots`` has ``order_id``, ``seq`` (arrival order),
    ``symbol``, ``order_side`` and the exchange fields.  ``fills`` limits new fills to the given ones.
    """
    if fills is not None:
        fresh = fills.groupBy("order_id", "seq").agg(*_fresh_sums(F.lit(True)))
        return order_columns(with_executed_before(snapshots, rows_per_task).join(fresh, ["order_id", "seq"], "left"))
    return cell_moves(snapshot_cells(snapshots, rows_per_task))


#: Columns of a snapshot that the ledger reads.
SNAPSHOT_COLUMNS = ["order_id", "seq", "symbol", "order_side", "uuid", "state", "paid_fee", "executed_volume", "price", "trades"]


def with_executed_before(snapshots: DataFrame, rows_per_task: int | None = None, before: DataFrame | None = None) -> DataFrame:
    """Add ``executed``, the average price and ``_prev``, the executed volume before the snapshot.

    ``before`` are rows of what was there before all given snapshots of an order: ``order_id``, ``_executed`` and
    ``_since`` once, and ``_known`` (time and id) for each known fill. They have no ``seq``, so that they lie before the
    snapshots, and stay in the result; ``since`` of a snapshot is then the order's ``_since``.
    """
    if before is not None:
        snapshots = snapshots.unionByName(before, allowMissingColumns=True)
    rows, series = lay_out(snapshots, ["order_id"], ["seq"], rows_per_task)
    if series.chunk is None:  # a fixed partition count: decimals cost more than the size of the rows shows
        rows = rows.repartition(work_partitions(rows.sparkSession), "order_id")
    executed = dec(F.col("executed_volume"))
    # A volume beyond the ledger is null and named; the next snapshot counts from the last one that fits.
    prev = {"_prev": ("last", F.col("executed"))}
    if before is None:
        return series.sweep(with_average_price(rows.withColumn("executed", executed)), before=prev)
    real = F.col("seq").isNotNull()
    rows = rows.withColumn("executed", F.when(real, executed).otherwise(F.col("_executed")))
    rows = series.sweep(rows, running={"since": ("first", F.col("_since"))}, before=prev)
    return with_average_price(rows)


def snapshot_cells(
    snapshots: DataFrame, rows_per_task: int | None = None, before: DataFrame | None = None
) -> DataFrame:
    """One row per trade of each snapshot (one without trade where it has none); ``_new``: the first to bring this fill.

    With ``before`` (see ``with_executed_before``) known fills are not new.
    """
    rows = with_executed_before(snapshots, rows_per_task, before)
    # One pass: the trades of a snapshot carry its columns along, and come together again once it is known which are new.
    # All of it is partitioned by order (or parts of one), so that the rows move once.
    kept = ["symbol", "order_side", "uuid", "state", "paid_fee", "executed", "_prev", "avg_executed_price"]
    also = [] if before is None else ["since", "_known"]
    if before is not None:
        rows = rows.where("seq IS NOT NULL OR _known IS NOT NULL")
    cells = rows.select("order_id", "seq", *also, F.struct(*kept).alias("_row"), F.posexplode_outer("trades").alias("_pos", "_t"))
    cells = trade_cells(cells, "order_id", "seq", *also, "_row")
    first = ["order_id", "filled_at", "trade_id"]
    if before is not None:
        cells = cells.withColumns({c: F.coalesce(f"_known.{c}", c) for c in first[1:]}).drop("_known")
    new = F.col("trade_id").isNotNull() & (F.row_number().over(Window.partitionBy(*first).orderBy("seq", "pos")) == 1)
    cells = cells.withColumn("_new", new)
    return cells if before is None else cells.where(F.col("seq").isNotNull())


def cell_moves(cells: DataFrame) -> DataFrame:
    """Order columns and moves from the rows of ``snapshot_cells``."""
    rows = cells.groupBy("order_id", "seq").agg(F.first("_row").alias("_row"), *_fresh_sums(F.col("_new")))
    return order_columns(rows.select("order_id", "seq", "_row.*", "_q", "_f", "_lost"))


def _fresh_sums(new: Column) -> list[Column]:
    """Quantity and funds of the new fills, and how many of them do not fit the ledger."""
    qty, funds = (F.when(new, F.col(c)) for c in ("fill_qty", "funds"))
    return [
        F.try_sum(qty).try_cast(AMOUNT).alias("_q"),
        F.try_sum(funds).try_cast(AMOUNT).alias("_f"),
        F.count_if(new & (F.col("fill_qty").isNull() | F.col("funds").isNull())).alias("_lost"),
    ]


def order_columns(rows: DataFrame) -> DataFrame:
    """Order columns and move of snapshots with ``executed``, the executed volume before (``_prev``), the average
    price, quantity and funds of the fills they brought first (``_q``, ``_f``) and how many of these do not fit (``_lost``)."""
    fresh = F.coalesce(F.when(F.col("_q") > 0, div_half_up(F.col("_f"), F.col("_q"))), F.col("avg_executed_price"))
    rows = rows.withColumns({"_delta": F.col("executed") - F.coalesce("_prev", F.lit(0).cast(AMOUNT)), "_price": fresh})
    delta, price = F.col("_delta"), F.col("_price")
    return rows.select(
        "order_id",
        "seq",
        "symbol",
        F.col("order_side").alias("side"),
        F.col("uuid").alias("exchange_order_id"),
        F.col("executed").cast(WIDE).alias("executed_volume"),
        dec(F.col("paid_fee")).cast(WIDE).alias("fee_amount"),
        "avg_executed_price",
        order_status(F.col("state"), F.col("executed")).alias("status"),
        F.when(delta > 0, delta.cast(WIDE)).alias("delta_qty"),
        F.when(delta > 0, price).alias("delta_price"),
        snapshot_error(delta, price).alias("error"),
    )


def snapshot_error(delta: Column, price: Column) -> Column:
    """Names what of a snapshot is beyond the ledger; such a snapshot moves no position by itself."""
    checks = [
        (F.col("executed").isNull(), "executed volume beyond the ledger"),
        (dec(F.col("paid_fee")).isNull(), "fee beyond the ledger"),
        (F.col("_lost") > 0, "fills beyond the ledger"),
        (F.col("avg_executed_price").isNull(), "average price beyond the ledger"),
        ((delta > 0) & price.isNull(), "move price beyond the ledger"),
    ]
    return F.nullif(F.concat_ws("; ", *[F.when(c, text) for c, text in checks]), F.lit(""))
