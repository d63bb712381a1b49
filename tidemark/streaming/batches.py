"""Polling loops as Structured Streaming with keyed state.

What must be remembered of a key (its last row, the executed volume of an order) is a table with one row per key that
each micro-batch writes under its number and the next one joins; the fills known of orders are those written so far, of
which a micro-batch reads one number each, and whole ones from the micro-batches that have some of its own.
No row passes through Python. The newest candles of a market are state of ``transformWithState``, kept by Spark's
RocksDB store. What comes before what inside a micro-batch is found by the scans of the batch form. All other work is
the columns and plans of the batch form. Outputs are written once per micro-batch under its number, so a batch that is
repeated replaces its own output.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.reconcile import SNAPSHOT_COLUMNS, cell_moves, order_status, snapshot_cells, trade_key
from tidemark.operators.scan import CHUNK, lay_out
from tidemark.plans.live import LiveParams, live_signals
from tidemark.session import ensure_checkpoint_dir, share_package
from tidemark.sources.candles import PRICES, checked_candles, history_size, mapped
from tidemark.sources.sinks import append_batch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Stores:
    """Folders of one stream: outputs and checkpoint (which holds the state)."""

    root: str

    @classmethod
    def fresh(cls, spark: SparkSession) -> Stores:
        return cls(f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, spark: SparkSession, name: str = "out") -> DataFrame:
        return spark.read.parquet(self.path(name)).drop("batch")


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], stores: Stores) -> int:
    """Process everything the source has, one micro-batch after the other, and stop; the number of micro-batches."""
    conf = stream.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    empty = "spark.sql.streaming.noDataMicroBatches.enabled"  # timers fire with the next rows; without rows there is no batch
    before = conf.get(empty)
    conf.set(empty, "false")
    try:
        writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", stores.path("checkpoint"))
        query = writer.outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        conf.set(empty, before)
    return len(query.recentProgress)


def stateful(
    rows: DataFrame, keys: Sequence[str], processor: StatefulProcessor, schema: T.StructType, time: str = "none"
) -> DataFrame:
    share_package(rows.sparkSession)
    return rows.groupBy(*keys).transformWithState(processor, schema, "append", time)


def joined(rows: DataFrame, more: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which a null key is a key like any other."""
    more = more.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return rows.join(more, on, "left").drop(*[f"_k_{k}" for k in keys])


def state_before(stores: Stores, spark: SparkSession, number: int) -> DataFrame | None:
    """What the micro-batches before this one left of each key; none before the first."""
    return spark.read.parquet(f"{stores.path('state')}/batch={number - 1}") if number else None


def row_before(
    batch: DataFrame, number: int, keys: Sequence[str], order: Sequence[str], seen: Sequence[str], rows_per_task: int | None, stores: Stores
) -> DataFrame:
    """``_p`` (the ``seen`` columns) of the row before: within the micro-batch, or the newest row of earlier ones.

    Writes the newest row of each key for the next micro-batch.
    """
    held = state_before(stores, batch.sparkSession, number)
    newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*seen), F.struct(*order)).alias("_held"))
    if held is not None:
        both = newest.withColumn("_now", F.lit(1)).unionByName(held.withColumn("_now", F.lit(0)))
        newest = both.groupBy(*keys).agg(F.max_by("_held", "_now").alias("_held"))
    append_batch(newest, stores.path("state"), number)
    rows, series = lay_out(batch, keys, order, rows_per_task)
    rows = series.sweep(rows, lag={"_p": F.struct(*seen)}).drop(CHUNK)
    if held is None:
        return rows
    return joined(rows, held, keys).withColumn("_p", F.coalesce("_p", "_held")).drop("_held")


def dedup_signals(signals: DataFrame, order: Sequence[str], stores: Stores, rows_per_task: int | None = None) -> int:
    """Drop a signal whose time equals the last one of the same market and side."""
    keys, seen = ["market", "side"], ["signal_ts"]

    def handle(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        rows = row_before(batch, number, keys, order, seen, rows_per_task, stores)
        new = F.col("_p").isNull() | ~F.col("_p.signal_ts").eqNullSafe(F.col("signal_ts"))
        append_batch(rows.where(new).drop("_p"), stores.path("out"), number)
        batch.unpersist()

    return run_available(signals, handle, stores)


def alert_drift(snapshots: DataFrame, order: Sequence[str], stores: Stores, rows_per_task: int | None = None) -> int:
    """Alert on drift snapshots that differ from the one before."""
    seen = ["drift_detected", "drift_qty", "total_qty", "managed_qty"]

    def handle(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        rows = row_before(batch, number, ["symbol"], order, seen, rows_per_task, stores)
        same = F.col("_p.drift_detected")
        for c in seen[1:]:
            same = same & (F.col(f"_p.{c}") == F.col(c))
        alert = F.col("drift_detected") & ~F.coalesce(same, F.lit(False))
        append_batch(rows.where(alert).drop("_p"), stores.path("out"), number)
        batch.unpersist()

    return run_available(snapshots, handle, stores)


#: How long a closed order is remembered.
KEEP_CLOSED = dt.timedelta(days=7)


def reconcile_orders(
    snapshots: DataFrame, order: Sequence[str], stores: Stores, keep_closed: dt.timedelta = KEEP_CLOSED, rows_per_task: int | None = None
) -> int:
    """Order snapshots to order columns and position moves; polling the same snapshot again moves nothing.

    State of each order: its executed volume and the keys of its fills. New fills go to ``fills``. ``keep_closed`` after
    its last snapshot the state of an order that is done or cancelled is dropped; polling it again after that counts as
    a new order, so it must be longer than closed orders are polled.
    """
    keep_ms = int(keep_closed.total_seconds() * 1000)

    def handle(batch: DataFrame, number: int) -> None:
        now = int(time.time() * 1000)
        held = state_before(stores, batch.sparkSession, number)
        batch = batch.withColumn("seq", F.struct(*order)).select(*SNAPSHOT_COLUMNS).persist()
        if held is None:
            cells = snapshot_cells(batch, rows_per_task).withColumn("since", F.lit(None).cast("bigint"))
        else:
            orders = held.select("order_id", F.col("executed").alias("_executed"), F.col("since").alias("_since"))
            # Fills that an order brought before its state was dropped do not count: they have another ``since``.
            wanted = wanted_codes(batch).persist()
            fills = known_fills(wanted, number, stores)
            fills = fills.join(orders, fills["order_id"].eqNullSafe(orders["order_id"]) & (F.col("since") == F.col("_since")), "left_semi")
            fills = fills.select("order_id", F.struct("filled_at", "trade_id").alias("_known")).persist()
            before = orders.unionByName(fills, allowMissingColumns=True)
            cells = snapshot_cells(batch, rows_per_task, before.withColumn("seq", F.lit(None).cast(batch.schema["seq"].dataType)))
        cells = cells.persist()
        append_batch(cell_moves(cells), stores.path("out"), number)
        new = cells.where("_new").withColumn("since", F.coalesce("since", F.lit(number).cast("bigint")))
        append_batch(new.drop("seq", "_row", "_new", "pos"), stores.path("fills"), number)
        append_batch(new.select(_fill_code(F.col("trade_id")).alias("code")), stores.path("codes"), number)
        append_batch(_orders_after(cells, held, number, now, keep_ms), stores.path("state"), number)
        for done in (cells, batch) if held is None else (cells, fills, wanted, batch):
            done.unpersist()

    return run_available(snapshots, handle, stores)


def _fill_code(trade_id: Column) -> Column:
    return F.xxhash64("order_id", trade_id)


#: Codes of a micro-batch's fills that are broadcast at most, after a count (about 130 MB).
BROADCAST_CODES = 2_000_000


def wanted_codes(batch: DataFrame) -> DataFrame:
    """The codes of all trades of a micro-batch, each once."""
    trades = batch.select("order_id", F.posexplode("trades").alias("_pos", "_t")).where(F.col("_t").isNotNull())
    return trades.select(_fill_code(trade_key(F.col("_t"), F.col("_pos"))).alias("code")).distinct()


def known_fills(wanted: DataFrame, number: int, stores: Stores) -> DataFrame:
    """The fills of the micro-batches before this one that have a ``wanted`` code.

    Each micro-batch writes one number per new fill, a hash of order and trade id. All these numbers are read, and with
    them the fills of those micro-batches only that have a wanted one. The caller compares the fills themselves.
    """
    spark = wanted.sparkSession
    some = F.broadcast(wanted) if wanted.count() <= BROADCAST_CODES else wanted.hint("shuffle_hash")
    codes = spark.read.option("basePath", stores.path("codes")).parquet(*[f"{stores.path('codes')}/batch={k}" for k in range(number)])
    found = sorted(r.batch for r in codes.join(some, "code", "left_semi").select("batch").distinct().collect())
    fills = spark.read.parquet(*[f"{stores.path('fills')}/batch={k}" for k in found or [number - 1]])
    fills = fills.withColumn("code", _fill_code(F.col("trade_id"))).join(some, "code", "left_semi")
    return fills.select("order_id", "filled_at", "trade_id", "since")


def _orders_after(cells: DataFrame, held: DataFrame | None, number: int, now: int, keep_ms: int) -> DataFrame:
    """State of each order: executed volume, closed or not, when it came last, and the micro-batch its state began with.

    Closed orders that did not come again for ``keep_ms`` are dropped.
    """
    closed = order_status(F.col("_row.state"), F.col("_row.executed")).isin("FILLED", "CANCELED")
    rows = cells.where("pos IS NULL OR pos = 0").select(
        "order_id",
        "seq",
        "_row.executed",
        closed.alias("closed"),
        F.lit(now).cast("bigint").alias("came"),
        F.lit(number).cast("bigint").alias("since"),
    )
    if held is not None:  # without ``seq`` the state lies before all snapshots
        rows = rows.unionByName(held, allowMissingColumns=True)
    at = F.struct("seq")
    out = rows.groupBy("order_id").agg(
        F.max_by("executed", F.when(F.col("executed").isNotNull(), at)).alias("executed"),
        *[F.max_by(c, at).alias(c) for c in ("closed", "came")],
        F.min("since").alias("since"),
        F.max(F.col("seq").isNotNull()).alias("_now"),
    )
    gone = ~F.col("_now") & F.col("closed") & (F.col("came") + keep_ms <= now)
    return out.where(~gone).drop("_now")


class Newest(StatefulProcessor):
    """Keeps the newest candles of a market and gives them out whenever new ones come; passes refused rows on."""

    def __init__(self, size: int) -> None:
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        values = ", ".join(f"{c} double" for c in (*PRICES, "volume"))
        self.candles = handle.getMapState("candles", "ts timestamp", values)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        came = 0
        for row in rows:
            if row["sound"]:
                came += 1
                self.candles.updateValue((row["ts"],), tuple(row[c] for c in (*PRICES, "volume")))
                if came % self.size == 0:  # never more than twice the history is held
                    self.newest()
            else:
                yield row
        if came:
            for ts, values in self.newest():
                yield Row(market=key[0], ts=ts, **dict(zip((*PRICES, "volume"), values, strict=True)), sound=True, raw=None)

    def newest(self) -> list[tuple]:
        """Drop all but the newest candles and return these, in order."""
        held = sorted((k[0], tuple(v)) for k, v in self.candles.iterator())
        for ts, _ in held[: -self.size]:
            self.candles.removeKey((ts,))
        return held[-self.size :]

    def close(self) -> None:
        pass


def refresh_signals(
    raw: DataFrame,
    positions: Callable[[SparkSession], DataFrame],
    params: LiveParams,
    stores: Stores,
    candle_count: int = 400,
    allowed: Callable[[SparkSession], DataFrame] | None = None,
) -> int:
    """New raw candles to signals: each batch extends the newest candles of its markets and evaluates them.

    Rows that cannot be used go to ``quarantine`` (with their JSON text) and hold up no other market. A market gives
    one output row per signal candle; state is the newest candles of each market.
    """
    columns = ["market", "ts", *PRICES, "volume", "sound", "raw"]
    rows = checked_candles(mapped(raw.withColumn("raw", F.to_json(F.struct("*")))))
    rows = rows.withColumn("raw", F.when(~F.col("sound"), F.col("raw"))).select(*columns)
    processor = Newest(history_size(candle_count, params.warmup))

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        append_batch(batch.where("not sound").select("market", "raw"), stores.path("quarantine"), number)
        history = batch.where("sound").drop("sound", "raw")
        touched = history.select("market").distinct()
        usable = touched if allowed is None else touched.join(allowed(spark), "market", "left_semi")
        signals = live_signals(history, positions(spark), params, candle_count, allowed=usable)
        append_batch(signals, stores.path("out"), number)
        batch.unpersist()

    return run_available(stateful(rows, ["market"], processor, rows.schema), handle, stores)
