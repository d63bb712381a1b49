import datetime as dt
from decimal import Decimal as D

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.catalog import QUERIES
from tidemark.catalog.base import order_snapshots, table
from tidemark.catalog.ledger import drift_series, moved_columns, signal_stream_rows
from tidemark.plans.live import LiveParams
from tidemark.streaming.batches import Stores, alert_drift, dedup_signals, reconcile_orders, refresh_signals

SF = "/root/testdata/sf0.001"


def feed(spark, df, order, path, parts):
    """Write ``df`` as ``parts`` files in arrival order and read them back one per micro-batch."""
    rows = df.withColumn("_f", F.ntile(parts).over(Window.orderBy(*order)))
    for i in range(1, parts + 1):
        rows.where(F.col("_f") == i).drop("_f").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("parts", [1, 4])
def test_dedup_equals_batch(spark, tmp_path, parts):
    rows = signal_stream_rows(table(spark, SF, "events"))
    stores = Stores(str(tmp_path / "s"))
    dedup_signals(feed(spark, rows, ["at", "event_id"], str(tmp_path / "in"), parts), ["at", "event_id"], stores)
    got = stores.read(spark).select("market", "side", F.date_format("signal_ts", "yyyy-MM-dd HH:mm:ss").alias("signal_ts"), "event_id")
    assert rows_of(got) == rows_of(QUERIES["signal_dedup"](spark, SF))


def test_drift_alerts_equal_batch(spark, tmp_path):
    stores = Stores(str(tmp_path / "s"))
    stream = feed(spark, drift_series(spark, SF), ["ts", "event_id"], str(tmp_path / "in"), 3)
    alert_drift(stream, ["ts", "event_id"], stores)
    cols = ["symbol", "event_id"] + [F.col(c).cast("double").alias(c) for c in ("total_qty", "managed_qty", "drift_qty")]
    assert rows_of(stores.read(spark).select(*cols)) == rows_of(QUERIES["drift_alerts"](spark, SF))


def test_reconcile_equals_batch(spark, tmp_path):
    flat = order_snapshots(spark, SF).select("*", "seq.ts", "seq.event_id").drop("seq")
    stores = Stores(str(tmp_path / "s"))
    reconcile_orders(feed(spark, flat, ["ts", "event_id"], str(tmp_path / "in"), 3), ["ts", "event_id"], stores)
    got = moved_columns(stores.read(spark).withColumn("event_id", F.col("seq.event_id")))
    assert rows_of(got) == rows_of(QUERIES["reconciled_orders"](spark, SF))
    fills = stores.read(spark, "fills")
    assert fills.count() == fills.select("order_id", "filled_at", "trade_id").distinct().count()
    assert fills.agg(F.sum("fill_qty")).first()[0] > D(0)


def test_signal_refresh_isolates_bad_rows(spark, tmp_path):
    day = lambda i: (dt.datetime(2026, 1, 1) + dt.timedelta(days=i)).strftime("%Y-%m-%dT%H:%M:%S")
    closes = {"A": [100, 90, 110, 95], "B": [100, 120, 90, 91]}
    rows = [(i, m, day(i), c, c + 1.0, c - 1.0, float(c), 1.0) for m, cs in closes.items() for i, c in enumerate(map(float, cs))]
    rows.append((1, "C", "broken", 1.0, 1.0, 1.0, 1.0, None))
    schema = "n int, market string, candle_date_time_utc string, opening_price double, high_price double, low_price double, trade_price double, candle_acc_trade_volume double"
    df = spark.createDataFrame(rows, schema)
    for i in range(2):
        df.where(F.col("n") <= 2 if i == 0 else F.col("n") == 3).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("n")
    flat = spark.createDataFrame([], "symbol string, qty double, avg_price double, updated_at timestamp")
    stores = Stores(str(tmp_path / "s"))
    refresh_signals(stream, lambda s: flat, LiveParams(2, 1, 2.0, 3.0, 2, 0.7, 0.0), stores)
    got = {(r["market"], r["signal_ts"].day): r["signal_reason"] for r in stores.read(spark).collect()}
    assert set(got) == {("A", 2), ("A", 3), ("B", 2), ("B", 3)} and got[("A", 3)] == "BUY_REGIME_TRANSITION"
    assert [r["market"] for r in stores.read(spark, "quarantine").collect()] == ["C"]


def test_one_key_with_most_rows_is_cut_into_chunks(spark, tmp_path):
    """26,000 rows of one key in a micro-batch, out of order: more than one Arrow batch, chunks of 4,000 rows."""
    base = F.lit("2026-01-01").cast("timestamp")
    rows = spark.range(52_000).select(
        F.when(F.col("id") % 50 == 0, "B").otherwise("A").alias("market"),
        F.lit("BUY").alias("side"),
        F.timestamp_add("HOUR", F.floor(F.col("id") / 7).cast("int"), base).alias("signal_ts"),
        F.col("id").alias("n"),
    )
    path, stores = str(tmp_path / "in"), Stores(str(tmp_path / "s"))
    for low in (0, 26_000):
        part = rows.where((F.col("n") >= low) & (F.col("n") < low + 26_000)).orderBy(F.hash("n")).coalesce(1)
        part.write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    assert dedup_signals(stream, ["n"], stores, rows_per_task=4_000) == 2
    got = sorted(r.n for r in stores.read(spark).select("n").collect())
    want, last = [], {}
    for n in range(52_000):
        key = n % 50 == 0
        if last.get(key) != n // 7:
            want.append(n)
        last[key] = n // 7
    assert got == want


@pytest.mark.parametrize("keep,again", [(dt.timedelta(days=1), None), (dt.timedelta(0), 5.0)])
def test_state_of_closed_orders_is_dropped_after_its_time(spark, tmp_path, keep, again):
    """The closed order is polled again in the third micro-batch: nothing moves while it is remembered. The open one stays."""
    trade = {"market": "A", "price": "2", "volume": "5", "funds": "10", "side": "bid", "created_at": "2026-01-01T00:00:00Z"}
    poll = lambda n, order, state: (n, order, "A", "BUY", f"u-{order}", state, "2", "0", "5", [trade | {"uuid": f"t-{order}"}])
    batches = [[poll(1, "shut", "done"), poll(2, "open", "wait")], [poll(3, "open", "wait")], [poll(4, "shut", "done"), poll(5, "open", "wait")]]
    cell = "array<struct<market:string,uuid:string,price:string,volume:string,funds:string,side:string,created_at:string>>"
    schema = f"n bigint, order_id string, symbol string, order_side string, uuid string, state string, price string, paid_fee string, executed_volume string, trades {cell}"
    path, stores = str(tmp_path / "in"), Stores(str(tmp_path / "s"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    assert reconcile_orders(stream, ["n"], stores, keep) == 3
    moves = {r["seq"]["n"]: r["delta_qty"] and float(r["delta_qty"]) for r in stores.read(spark).collect()}
    assert moves == {1: 5.0, 2: 5.0, 3: None, 4: again, 5: None}
    assert stores.read(spark, "fills").where("order_id = 'shut'").count() == (2 if again else 1)


def test_rows_do_not_pass_through_python_state(spark, tmp_path, monkeypatch):
    """Repeats across micro-batches are dropped, also under a null key, without a processor that sees row after row."""
    from tidemark.streaming import batches

    monkeypatch.setattr(batches, "stateful", None)
    at, path, stores = dt.datetime(2026, 1, 1), str(tmp_path / "in"), Stores(str(tmp_path / "s"))
    for rows in ([(1, "A"), (2, None)], [(3, "A"), (4, None)], [(5, "B"), (6, None)]):
        df = spark.createDataFrame([(n, m, "BUY", at) for n, m in rows], "n bigint, market string, side string, signal_ts timestamp")
        df.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    assert dedup_signals(stream, ["n"], stores) == 3
    assert sorted(r.n for r in stores.read(spark).collect()) == [1, 2, 5]


def polls(path, spark, batches):
    """Order snapshots as one file per micro-batch: (n, order, ids of its trades); each trade adds 1 to the volume."""
    cell = "array<struct<market:string,uuid:string,price:string,volume:string,funds:string,side:string,created_at:string>>"
    schema = f"n bigint, order_id string, symbol string, order_side string, uuid string, state string, price string, paid_fee string, executed_volume string, trades {cell}"
    trade = lambda t: {"market": "A", "uuid": t, "price": "2", "volume": "1", "funds": "2", "side": "bid", "created_at": "2026-01-01T00:00:00Z"}
    for rows in batches:
        rows = [(n, o, "A", "BUY", f"u-{o}", "wait", "2", "0", str(n), [trade(t) for t in ts]) for n, o, ts in rows]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_fills_of_micro_batches_without_a_repeat_are_not_read(spark, tmp_path):
    """The third micro-batch repeats a fill of the second one only; those of the first are unreadable by then."""
    path, stores = str(tmp_path / "in"), Stores(str(tmp_path / "s"))
    assert reconcile_orders(polls(path, spark, [[(1, "a", ["t1"])], [(2, "b", ["t2"])]]), ["n"], stores) == 2
    for file in (tmp_path / "s" / "fills" / "batch=0").glob("part-*"):
        file.write_bytes(b"not a table")
        file.with_name(f".{file.name}.crc").unlink()
    assert reconcile_orders(polls(path, spark, [[(3, "b", ["t2", "t3"])]]), ["n"], stores) == 1
    assert sorted(r.trade_id for r in spark.read.parquet(*[stores.path(f"fills/batch={k}") for k in (1, 2)]).collect()) == ["t2", "t3"]


def test_fills_with_equal_codes_stay_apart(spark, tmp_path, monkeypatch):
    """All codes are equal: repeats, also of the first micro-batch and of an order without id, are known, others are new."""
    from tidemark.streaming import batches

    monkeypatch.setattr(batches, "_fill_code", lambda trade_id: F.lit(7).cast("bigint"))
    path, stores = str(tmp_path / "in"), Stores(str(tmp_path / "s"))
    stream = polls(path, spark, [[(1, "a", ["t1"]), (2, None, ["t1"])], [(3, "b", ["t1"])], [(4, "a", ["t1", "t2"]), (5, None, ["t1", "t3"])]])
    assert reconcile_orders(stream, ["n"], stores) == 3
    got = [(r.order_id or "", r.trade_id) for r in stores.read(spark, "fills").collect()]
    assert sorted(got) == [("", "t1"), ("", "t3"), ("a", "t1"), ("a", "t2"), ("b", "t1")]
    moves = {r.seq.n: r.delta_qty and float(r.delta_qty) for r in stores.read(spark).collect()}
    assert moves == {1: 1.0, 2: 2.0, 3: 3.0, 4: 3.0, 5: 3.0}


def test_reconcile_in_chunks_equals_batch(spark, tmp_path):
    """Micro-batches whose orders span several chunks, with state and known fills before the first one."""
    flat = order_snapshots(spark, SF).select("*", "seq.ts", "seq.event_id").drop("seq")
    stores = Stores(str(tmp_path / "s"))
    stream = feed(spark, flat, ["ts", "event_id"], str(tmp_path / "in"), 2)
    reconcile_orders(stream, ["ts", "event_id"], stores, rows_per_task=10)
    got = moved_columns(stores.read(spark).withColumn("event_id", F.col("seq.event_id")))
    assert rows_of(got) == rows_of(QUERIES["reconciled_orders"](spark, SF))


@pytest.mark.parametrize("keeps_times", [True, False])
def test_feed_writes_each_row_once_in_order_of_time(spark, tmp_path, monkeypatch, keeps_times):
    """Eight micro-batches of one time range each, from rows in no order; a store that keeps no file times takes a second write."""
    from tidemark.catalog import streams

    monkeypatch.setattr(streams, "ROWS", 500)
    monkeypatch.setattr(streams, "FILE_ROWS", 100)
    if not keeps_times:
        monkeypatch.setattr(streams, "in_order", lambda *a: False)
    start = F.lit("2026-01-01").cast("timestamp")
    at = F.when(F.col("id") > 0, F.timestamp_add("SECOND", ((F.col("id") * 7919) % 4000).cast("int"), start))
    rows = spark.range(4000).select("id", at.alias("at"))
    stores, seen = Stores(str(tmp_path / "s")), []
    stream = streams.feed(rows, "at", stores)
    query = stream.writeStream.foreachBatch(lambda b, n: seen.append(b.collect())).option("checkpointLocation", str(tmp_path / "c"))
    query.trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 8 and sorted(r.id for b in seen for r in b) == list(range(4000))
    times = [sorted(r["at"] for r in b if r["at"]) for b in seen]
    assert all(a[-1] < b[0] for a, b in zip(times, times[1:], strict=False)) and any(r["at"] is None for r in seen[0])
    assert {p.name for p in (tmp_path / "s").iterdir()} == ({"in"} if keeps_times else {"in", "steps"})


def test_steps_with_few_rows_keep_their_order(spark, tmp_path, monkeypatch):
    """More steps than the least number, but too few rows for the files of each step."""
    from tidemark.catalog import streams

    monkeypatch.setattr(streams, "ROWS", 1)
    monkeypatch.setattr(streams, "FILE_ROWS", 1)
    rows, seen, stores = spark.range(6).select("id", F.timestamp_seconds(-F.col("id")).alias("at")), [], Stores(str(tmp_path / "s"))
    query = streams.feed(rows, "at", stores).writeStream.foreachBatch(lambda b, k: seen.append([r.id for r in b.collect()]))
    query.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [i for b in seen for i in b] == [5, 4, 3, 2, 1, 0]
