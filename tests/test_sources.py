import datetime as dt
import json

import pytest

from pyspark.sql import functions as F

from tidemark.functions.scalar import asset_of, escape_label, parse_utc, partition_name, plain_decimal
from tidemark.sources.candles import latest, read_candles_csv, read_candles_json, signal_rows, synthetic_candles
from tidemark.sources.sinks import append_batch, read_positions, upsert_positions, write_candles, write_candles_csv

SCHEMA = "market string, ts timestamp, open double, high double, low double, close double, volume double"


def bars(spark, n=5, market="A-1"):
    rows = [(market, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), 1.0 + i, 2.0 + i, 0.5 + i, 1.5 + i, 10.0) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "c")
    write_candles_csv(bars(spark), path)
    back = read_candles_csv(spark, path, "A-1")
    assert sorted(back.collect()) == sorted(bars(spark).select(*back.columns).collect())


def test_csv_short_rows_and_duplicates(spark, tmp_path):
    head = "timestamp,open,high,low,close,volume\n"
    text = head + "2024-01-01T00:00:00Z,1,2,0.5,1.5,3\nshort,1\n2024-01-01T00:00:00,9,9,9,9,9\n2024-01-02T09:00:00+09:00,1,2,0.5,1.5,3\n"
    (tmp_path / "a.csv").write_text(text)
    got = {str(r["ts"]): r["close"] for r in read_candles_csv(spark, str(tmp_path / "a.csv"), "A").collect()}
    assert got == {"2024-01-01 00:00:00": 9.0, "2024-01-02 00:00:00": 1.5}


def test_json(spark, tmp_path):
    rows = [
        {"market": "M", "candle_date_time_utc": "2024-01-01T00:00:00", "opening_price": 1, "high_price": 2, "low_price": 1, "trade_price": 2},
        {"market": "M", "candle_date_time_utc": "nope", "opening_price": 1, "high_price": 2, "low_price": 1, "trade_price": 2},
        {"market": "M", "candle_date_time_utc": "2024-01-02T00:00:00", "opening_price": None, "high_price": 2, "low_price": 1, "trade_price": 2},
    ]
    (tmp_path / "c.json").write_text("\n".join(json.dumps(r) for r in rows))
    got = read_candles_json(spark, str(tmp_path / "c.json")).collect()
    assert len(got) == 1 and got[0]["volume"] == 0.0


def test_partitioned_parquet_prunes(spark, tmp_path):
    path = str(tmp_path / "p")
    write_candles(bars(spark, 400, "KRW/BTC"), path)
    one = spark.read.parquet(path).where((F.col("market_dir") == "KRW_BTC") & (F.col("year") == 2025))
    assert one.count() == 400 - 366


def test_latest_and_signal_rows(spark):
    both = bars(spark, 5).unionByName(bars(spark, 2, "B-1"))
    assert latest(both, 3).groupBy("market").count().orderBy("market").collect() == [("A-1", 3), ("B-1", 2)]
    assert [(r["market"], r["ts"].day) for r in signal_rows(both).collect()] == [("A-1", 4)]
    assert {(r["market"], r["ts"].day) for r in signal_rows(both, closed_only=False).collect()} == {("A-1", 5), ("B-1", 2)}


def test_synthetic_matches_stepwise(spark):
    import math

    price, want = 100.0, []
    for i in range(420):
        price = max(1.0, price + math.sin(i / 14.0) * 2.0 + (0.18 if i < 420 * 0.55 else -0.10) + (0.0 if i % 41 else -3.5))
        want.append(price)
    got = [r["close"] for r in synthetic_candles(spark).orderBy("ts").collect()]
    assert got == pytest.approx(want, rel=1e-12) and min(got) >= 1.0


def test_append_is_idempotent_and_positions_read_latest(spark, tmp_path):
    path = str(tmp_path / "pos")
    p = lambda rows: spark.createDataFrame(rows, "symbol string, qty double")
    append_batch(p([("A", 1.0), ("B", 2.0)]), path, 0)
    append_batch(p([("A", 9.0)]), path, 1)
    append_batch(p([("A", 3.0)]), path, 1)
    assert sorted(read_positions(spark, path).collect()) == [("A", 3.0), ("B", 2.0)]
    assert sorted(upsert_positions(p([("A", 1.0), ("B", 2.0)]), p([("B", 5.0), ("C", 1.0)])).collect()) == [("A", 1.0), ("B", 5.0), ("C", 1.0)]


def test_scalars(spark):
    df = spark.createDataFrame([(" krw-btc ", "2024-01-01T00:00:00z", 'a"b\\')], "m string, t string, s string")
    ts = F.lit("2024-02-03").cast("timestamp")
    r = df.select(
        asset_of(F.col("m")).alias("a"), parse_utc(F.col("t")).cast("string").alias("t"), escape_label(F.col("s")).alias("e"),
        plain_decimal(F.lit("12.500").cast("decimal(38,12)")).alias("d"), plain_decimal(F.lit("100").cast("decimal(38,12)")).alias("i"),
        partition_name(F.lit("KRW/BTC"), ts, ts, "days").alias("n"), asset_of(F.lit("KRW-")).alias("z"),
    ).first()
    assert (r["a"], r["t"], r["e"]) == ("BTC", "2024-01-01 00:00:00", 'a\\"b\\\\')
    assert (r["d"], r["i"], r["n"], r["z"]) == ("12.5", "100", "KRW_BTC_20240203_20240203_days", "")
