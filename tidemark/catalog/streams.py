"""Streaming queries: the same rows as their batch forms, read as streams from the given tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.catalog.base import SNAPSHOTS, order_snapshots, query, r, stamp, table
from tidemark.catalog.ledger import ALERT_SQL, ALERTS, DEDUP_SQL, MOVED_SQL, moved_columns, signal_stream_rows
from tidemark.catalog.market import LIVE_SQL, LIVE, live_positions, rd
from tidemark.operators import account as acc
from tidemark.streaming.batches import Stores, alert_drift, dedup_signals, reconcile_orders, refresh_signals


#: Micro-batches at least, files of each, and rows of one at most (about).
STEPS, FILES, ROWS = 4, 2, 1_000_000
#: Rows of a file at least (about), when there are more files because there are more micro-batches.
FILE_ROWS = 100_000


def feed(df, at, stores):
    """``df`` as a stream of micro-batches in the order of the time column ``at``; their number grows with the rows.

    Up to ``STEPS`` times ``ROWS`` rows each step is written as ``FILES`` files after the step before, and the stream
    takes as many at a time. With more rows all steps are written at the same time, each row once: the times are read
    first, then the source, and each row goes straight to a file of its step.
    """
    spark = df.sparkSession
    rows = df.withColumn("_at", F.unix_micros(at))
    steps = max(STEPS, -(-rows.count() // ROWS))
    source, files = stores.path("in"), FILES
    if steps == STEPS:
        rows.write.parquet(stores.path("all"))
        rows = spark.read.parquet(stores.path("all"))
    cuts = rows.agg(F.percentile_approx("_at", [k / steps for k in range(1, steps)], 100 * steps).alias("c")).first().c or []
    cuts = sorted(set(cuts))
    if steps == STEPS:
        step_by_step(rows, cuts, source)
    else:
        files = max(FILES, min(spark.sparkContext.defaultParallelism, ROWS // FILE_ROWS))
        all_at_once(rows, cuts, files, source)
        if not in_order(spark, source, len(cuts) + 1, files):
            source, files = one_by_one(spark, source, files, stores.path("steps")), 1
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(source)


def step_by_step(rows, cuts, path):
    edges = [None, *cuts, None]
    for low, high in zip(edges, edges[1:], strict=False):
        part = rows if low is None else rows.where(F.col("_at") > low)
        part = part if high is None else part.where(F.col("_at") <= high)
        if low is None:
            part = part.unionByName(rows.where(F.col("_at").isNull()))
        part.drop("_at").repartition(FILES).write.mode("append").parquet(path)


def all_at_once(rows, cuts, files, path):
    """Every step as ``files`` files, whose numbers tell the step."""
    plain = [c.name for c in rows.schema if not isinstance(c.dataType, (T.ArrayType, T.MapType, T.StructType))]
    place = step_of(cuts) * files + F.pmod(F.xxhash64(*plain), F.lit(files))
    placed = rows.withColumn("_place", place.cast("int")).repartitionById((len(cuts) + 1) * files, "_place")
    # Most texts are there once: dictionaries would be built and given up again.
    placed.drop("_at", "_place").write.option("parquet.enable.dictionary", "false").parquet(path)


def step_of(cuts):
    """Number of the step of ``_at``: how many cuts lie before it, found by halving. Null comes first."""

    def within(low, high):
        if low == high:
            return F.lit(low)
        half = (low + high) // 2
        return F.when(F.col("_at") > cuts[half], within(half + 1, high)).otherwise(within(low, half))

    return within(0, len(cuts))


def placed_files(spark, path):
    """The store and the files under ``path`` by the number of the place they were written for."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = ((f, re.match(r"part-(\d+)-", f.getPath().getName())) for f in store.listStatus(folder))
    return store, sorted(((int(m[1]), f) for f, m in names if m), key=lambda x: x[0])


def in_order(spark, path, steps, files):
    """Give the files under ``path`` times a second apart from step to step.

    False if a step does not have ``files`` of them (it has few rows) or the store does not keep such times.
    """
    store, found = placed_files(spark, path)
    if [n for n, _ in found] != list(range(steps * files)):
        return False
    last = max(f.getModificationTime() for _, f in found) // 1000 * 1000
    times = [last - 1000 * (steps - n // files) for n, _ in found]
    for (_, f), at in zip(found, times, strict=True):
        store.setTimes(f.getPath(), at, -1)
    return [f.getModificationTime() for _, f in placed_files(spark, path)[1]] == times


def one_by_one(spark, path, files, to):
    """Each step written as one file after the step before, so that the files have their order by themselves."""
    steps = {}
    for n, f in placed_files(spark, path)[1]:
        steps.setdefault(n // files, []).append(f.getPath().toString())
    for _, paths in sorted(steps.items()):
        spark.read.parquet(*paths).coalesce(1).write.mode("append").parquet(to)
    return to


@query("stream_signal_dedup", DEDUP_SQL)
def stream_signal_dedup(spark, sf):
    stores = Stores.fresh(spark)
    dedup_signals(feed(signal_stream_rows(table(spark, sf, "events")), "at", stores), ["at", "event_id"], stores)
    return stores.read(spark).select("market", "side", stamp("signal_ts").alias("signal_ts"), "event_id")


@query("stream_drift_alerts", f"WITH {ALERTS} SELECT {ALERT_SQL} FROM alerts")
def stream_drift_alerts(spark, sf):
    stores = Stores.fresh(spark)
    e = table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        F.floor(F.col("value") / 50).cast("decimal(38,12)").alias("total_qty"),
        (F.col("event_id") % 2).cast("decimal(38,12)").alias("managed_qty"),
    )
    rows = e.withColumns(acc.drift_columns(F.col("total_qty"), F.col("managed_qty")))
    alert_drift(feed(rows, "ts", stores), ["ts", "event_id"], stores)
    num = [F.col(c).cast("double").alias(c) for c in ("total_qty", "managed_qty", "drift_qty")]
    return stores.read(spark).select("symbol", "event_id", *num)


@query("stream_reconcile", f"WITH {SNAPSHOTS} SELECT {MOVED_SQL} FROM moved")
def stream_reconcile(spark, sf):
    stores = Stores.fresh(spark)
    flat = order_snapshots(spark, sf).select("*", F.col("seq.ts").cast("timestamp").alias("ts"), "seq.event_id").drop("seq")
    reconcile_orders(feed(flat, "ts", stores), ["ts", "event_id"], stores)
    return moved_columns(stores.read(spark).withColumn("event_id", F.col("seq.event_id")))


@query(
    "stream_signals",
    f"""{LIVE_SQL} SELECT market, strftime(ts, '%Y-%m-%d') AS day, {rd('close', 'close')}, {rd('stop', 'trail_stop')}, has AS has_position,
    buy_signal, sell_signal, signal_reason FROM signals""",
)
def stream_signals(spark, sf):
    from tidemark.catalog.base import candles

    stores = Stores.fresh(spark)
    raw = candles(spark, sf).select(
        "market",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("candle_date_time_utc"),
        F.col("open").alias("opening_price"),
        F.col("high").alias("high_price"),
        F.col("low").alias("low_price"),
        F.col("close").alias("trade_price"),
        F.col("volume").alias("candle_acc_trade_volume"),
    )
    stream = feed(raw.withColumn("_ts", F.col("candle_date_time_utc").cast("timestamp")), "_ts", stores).drop("_ts")
    refresh_signals(stream, lambda s: live_positions(s, sf), LIVE, stores)
    # Each micro-batch gives a signal of each market it touches; the last one is the batch form's.
    rows = stores.read(spark)
    rest = [c for c in rows.columns if c != "market"]
    newest = rows.groupBy("market").agg(F.max_by(F.struct(*rest), "signal_ts").alias("n"))
    out = newest.select("market", *[F.col(f"n.{c}").alias(c) for c in rest])
    return out.select(
        "market", F.date_format("signal_ts", "yyyy-MM-dd").alias("day"), r("close").alias("close"), r("trail_stop").alias("trail_stop"),
        "has_position", "buy_signal", "sell_signal", "signal_reason",
    )
