"""Stored positions and the order layout: what is rewritten, what is read."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.sources.stores import PositionTable, order_by_id, orders_of, symbols_with_open_orders, write_orders

SCHEMA = "symbol string, qty decimal(38,12), at int"


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def rows_of(df):
    return {r.symbol: (float(r.qty), r["at"]) for r in df.collect()}


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    path, rng, want = f"{tmp_path}/p", random.Random(4), {}
    t = PositionTable(spark, path, SCHEMA, buckets=32)
    assert t.read().count() == 0
    for batch in range(5):
        n = 400 if batch == 0 else 3
        new = {f"S{rng.randrange(600)}": (float(rng.randrange(99)), batch) for _ in range(n)}
        changes = spark.createDataFrame([(k, *v) for k, v in new.items()], "symbol string, qty double, at int")
        before = files(path)
        t.upsert(changes, batch)
        want |= new
        assert rows_of(t.read()) == want
        touched = {r[0] for r in changes.select(t._bucket()).distinct().collect()}
        changed = {n for n, m in files(path).items() if before.get(n) != m}
        assert {int(n.split("/")[0].split("=")[1]) for n in changed} == touched and len(touched) <= 32
        # The same batch again: same rows, and no other bucket is written.
        again = files(path)
        t.upsert(changes, batch)
        assert rows_of(t.read()) == want
        assert {n.split("/")[0] for n, m in files(path).items() if again.get(n) != m} <= {f"bucket={b}" for b in touched}
    versions = [len(list(p.iterdir())) for p in Path(path).glob("bucket=*")]
    assert max(versions) <= 2
    keys = spark.createDataFrame([("S1",), ("S2",), ("none",)], "k string")
    assert rows_of(t.lookup(keys)) == {k: v for k, v in want.items() if k in ("S1", "S2")}
    t.upsert(changes.where("false"), 9)
    assert rows_of(t.read()) == want


def test_repeated_keys_need_an_order(spark, tmp_path):
    t = PositionTable(spark, f"{tmp_path}/p", SCHEMA, buckets=4)
    twice = spark.createDataFrame([("A", 1.0, 1), ("A", 2.0, 2), ("B", None, 3)], "symbol string, qty double, at int")
    with pytest.raises(Exception, match="twice"):
        t.upsert(twice, 0)
    t.upsert(twice, 0, order="at")
    assert {r.symbol: r.qty for r in t.read().collect()} == {"A": 2, "B": None}
    with pytest.raises(Exception, match="null"):
        t.upsert(spark.createDataFrame([(None, 1.0, 1)], "symbol string, qty double, at int"), 1)


def rows_scanned(df):
    """Rows that the scan handed on, after the row groups it skipped."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


def test_scans_skip_folders_and_row_groups(spark, tmp_path):
    path, n = f"{tmp_path}/o", 60_000
    orders = spark.range(n).select(
        F.concat(F.lit("o-"), F.sha2(F.col("id").cast("string"), 256)).alias("client_order_id"),
        F.format_string("S%04d", F.col("id") * 7919 % 1000).alias("symbol"),
        F.when(F.col("id") % 3 == 0, "LIVE").otherwise("PAPER").alias("mode"),
        F.when(F.col("id") % 5 == 0, "SUBMITTED").otherwise("FILLED").alias("status"),
        F.col("id").alias("created_at"),
    )
    write_orders(orders, path, ids=2000, row_group=64 * 1024)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        folder = orders.where("mode = 'LIVE' AND status = 'FILLED'").count()
        one = orders_of(spark, path, "S0014", "LIVE", "FILLED")
        want = [r.created_at for r in orders.where("symbol = 'S0014' AND mode = 'LIVE' AND status = 'FILLED'").orderBy("created_at").collect()]
        assert [r.created_at for r in one.collect()] == want and want
        assert rows_scanned(one) < folder / 2
        # A lookup by id reads the row groups whose Bloom filter holds it.
        key = orders.where("created_at = 4711").first().client_order_id
        found = order_by_id(spark, path, key)
        assert [r.created_at for r in found.collect()] == [4711] and rows_scanned(found) < n / 4
        assert rows_scanned(order_by_id(spark, path, "o-none")) < n / 10
        busy = symbols_with_open_orders(spark, path, "PAPER")
        assert rows_scanned(busy) <= orders.where("mode = 'PAPER' AND status = 'SUBMITTED'").count()
        assert {r.symbol for r in symbols_with_open_orders(spark, path, "PAPER", ["S0001", "S0002"]).collect()} <= {"S0001", "S0002"}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
