"""Candle sources: files, raw rows, trades; and the history scans on top of them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import parse_utc, partition_name
from tidemark.operators.scan import lay_out

PRICES = ["open", "high", "low", "close"]
# Header of candle files and field names of raw exchange candles.
CSV_COLUMNS = ["timestamp", "open", "high", "low", "close", "volume"]
RAW_FIELDS = {
    "candle_date_time_utc": "ts",
    "opening_price": "open",
    "high_price": "high",
    "low_price": "low",
    "trade_price": "close",
    "candle_acc_trade_volume": "volume",
}
CSV_SCHEMA = "timestamp string, open double, high double, low double, close double, volume string"
RAW_SCHEMA = (
    "market string, candle_date_time_utc string, opening_price decimal(38,12), high_price decimal(38,12), "
    "low_price decimal(38,12), trade_price decimal(38,12), candle_acc_trade_volume decimal(38,12)"
)


def checked_candles(raw: DataFrame, flag: str = "sound") -> DataFrame:
    """Typed candles, a missing volume being 0, and whether each can be used.

    Rows without time or prices cannot, nor can prices that are not finite and opens that are not positive: a return
    over such an open has no value.
    """
    typed = raw.withColumns({c: F.col(c).try_cast("double") for c in PRICES}).withColumn(
        "volume", F.coalesce(F.col("volume").try_cast("double"), F.lit(0.0))
    )
    sound = F.col("ts").isNotNull() & (F.col("open") > 0)
    for c in PRICES:
        sound = sound & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return typed.withColumn(flag, F.coalesce(sound, F.lit(False)))


def normalize_candles(raw: DataFrame) -> DataFrame:
    """The typed candles that can be used."""
    return checked_candles(raw, "_sound").where("_sound").drop("_sound")


def refused_candles(raw: DataFrame) -> DataFrame:
    """The typed candles that cannot be used, for a second output."""
    return checked_candles(raw, "_sound").where("not _sound").drop("_sound")


def dedup_candles(df: DataFrame, keys: tuple[str, ...] = ("market", "ts"), seq: str = "load_seq") -> DataFrame:
    """One row per key; the one loaded last wins.  An aggregate, so copies shrink before the shuffle."""
    rest = [c for c in df.columns if c not in (*keys, seq)]
    newest = F.max_by(F.struct(*rest), F.col(seq)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def read_candles_csv(spark: SparkSession, path: str, market: str) -> DataFrame:
    """Candle files with a six-column header; short rows go, the last duplicate time wins.

    The load order of rows is file path, then position in the file.
    """
    return _from_csv(spark.read.schema(CSV_SCHEMA), path, F.lit(market))


def read_candle_files(spark: SparkSession, path: str) -> DataFrame:
    """Candle files of many markets, each in the folder ``market=<name>``; a filter on the market opens its folder only."""
    return _from_csv(spark.read.schema(f"{CSV_SCHEMA}, market string"), path, F.col("market"))


def _from_csv(reader: DataFrameReader, path: str, market: Column) -> DataFrame:
    raw = reader.option("header", True).option("mode", "PERMISSIVE").csv(path)
    rows = raw.where(F.col("volume").isNotNull()).select(
        market.alias("market"),
        parse_utc(F.col("timestamp")).alias("ts"),
        *PRICES,
        F.col("volume").cast("double").alias("volume"),
        F.struct(
            F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
        ).alias("load_seq"),
    )
    return dedup_candles(normalize_candles(rows))


def read_candles_json(spark: SparkSession, path: str) -> DataFrame:
    """Raw exchange candles (JSON lines) mapped to candle columns."""
    return from_raw(spark.read.schema(RAW_SCHEMA).json(path))


def mapped(raw: DataFrame) -> DataFrame:
    """Raw exchange field names mapped to candle columns; other columns stay."""
    named = raw.withColumnsRenamed(RAW_FIELDS)
    return named.withColumn("ts", parse_utc(F.col("ts").cast("string")))


def from_raw(raw: DataFrame) -> DataFrame:
    """Map raw exchange field names and normalise; other columns stay."""
    return normalize_candles(mapped(raw))


def candles_from_trades(
    trades: DataFrame,
    market: str | Column,
    ts: str,
    price: Column,
    seq: str,
    unit: str = "day",
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Candles per market and calendar unit; ``seq`` orders trades inside a candle.

    ``start`` and ``end`` limit the candles to those that begin between them, both included. The limits are put on
    the times of the trades themselves, so that the scan can leave out what lies outside.

    Hash aggregation with map-side partials: a market with most of the trades still reaches the shuffle as at
    most one row per input partition and candle.
    """
    kind = trades.schema[ts].dataType
    if start is not None:
        # The first candle that begins at or after the start.
        begin = F.date_trunc(unit, F.lit(start).cast("timestamp"))
        late = begin + F.expr(f"INTERVAL 1 {unit}")
        begin = F.when(begin < F.lit(start).cast("timestamp"), late).otherwise(begin)
        trades = trades.where(F.col(ts) >= begin.cast(kind))
    if end is not None:
        stop = F.date_trunc(unit, F.lit(end).cast("timestamp")) + F.expr(f"INTERVAL 1 {unit}")
        trades = trades.where(F.col(ts) < stop.cast(kind))
    rows = trades.select(
        (F.col(market) if isinstance(market, str) else market).alias("market"),
        F.date_trunc(unit, F.col(ts)).cast("timestamp").alias("ts"),
        price.alias("p"),
        F.col(seq).alias("s"),
    )
    return rows.groupBy("market", "ts").agg(
        F.min_by("p", "s").alias("open"),
        F.max("p").alias("high"),
        F.min("p").alias("low"),
        F.max_by("p", "s").alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )


def between(df: DataFrame, start: datetime | str, end: datetime | str | None = None) -> DataFrame:
    """Candles from ``start`` to ``end``, both included; without ``end`` up to now."""
    upper = F.current_timestamp() if end is None else F.lit(end).cast("timestamp")
    return df.where(F.col("ts").between(F.lit(start).cast("timestamp"), upper))


def warmup_rows(*lengths: int) -> int:
    """Candles a strategy needs before its first defined value."""
    return max(lengths)


def history_size(candle_count: int, warmup: int) -> int:
    """Candles to read for one live signal."""
    return max(candle_count, warmup + 2)


def latest(df: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` candles of each market (top-n is cut before the shuffle)."""
    newest_first = Window.partitionBy("market").orderBy(F.col("ts").desc())
    return df.withColumn("_rn", F.row_number().over(newest_first)).where(F.col("_rn") <= n).drop("_rn")


def signal_rows(df: DataFrame, closed_only: bool = True) -> DataFrame:
    """The candle a live signal looks at: the last closed one; markets with no candle before it are left out."""
    rank = 2 if closed_only else 1
    newest_first = Window.partitionBy("market").orderBy(F.col("ts").desc())
    top = df.withColumn("_rn", F.row_number().over(newest_first)).where(F.col("_rn") <= rank + 1)
    has_earlier = F.max("_rn").over(Window.partitionBy("market")) > rank
    return top.withColumn("_ok", has_earlier).where((F.col("_rn") == rank) & F.col("_ok")).drop("_rn", "_ok")


def with_partition_name(df: DataFrame, start: Column, end: Column, interval: str = "days") -> DataFrame:
    """Add the storage name of the requested range of each market."""
    return df.withColumn("part_name", partition_name(F.col("market"), start, end, interval))


def synthetic_candles(spark: SparkSession, n: int = 420, market: str = "SYN-TEST") -> DataFrame:
    """Sine wave with a drift switch at 55 % and a shock every 41 bars, never below 1."""
    i = F.col("id")
    wave = F.sin(i / 14.0) * 2.0
    drift = F.when(i < n * 0.55, 0.18).otherwise(-0.10)
    shock = F.when(i % 41 != 0, 0.0).otherwise(-3.5)
    base = spark.range(n).select(F.lit(market).alias("market"), "id", (wave + drift + shock).alias("step"))
    base, series = lay_out(base, ["market"], ["id"])
    walk = series.running(base, sum=("sum", F.col("step")))
    low = series.running(walk, deep=("max", 1.0 - F.col("sum")))
    path = low.withColumn("close", F.col("sum") + F.greatest(F.lit(100.0), F.col("deep")))
    path = series.shift(path, open=F.col("close")).withColumn("open", F.coalesce("open", F.lit(100.0)))
    return path.select(
        "market",
        F.timestamp_seconds(F.unix_timestamp(F.lit("2023-01-01").cast("timestamp")) + i * 86400).alias("ts"),
        "open",
        (F.greatest("open", "close") + 0.8).alias("high"),
        (F.least("open", "close") - 0.8).alias("low"),
        "close",
        (i + 1200.0).alias("volume"),
    )

