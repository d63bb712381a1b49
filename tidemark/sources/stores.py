"""Stored ledger tables: positions that are upserted, and orders laid out so that scans skip what they do not need.

Positions lie in hash buckets.  A batch reads and rewrites the buckets it touches and no others, so its cost follows the
batch, not the table (the number of buckets is chosen with the table's final size in mind).  A bucket's folder holds
its versions, one folder for each batch that touched it: readers take the newest, the one before is kept until the next
batch, so a batch that is run again starts from the same rows and ends with the same ones, and a batch that fails half
way is simply run again.  One writer at a time.

Orders lie in folders by mode and status; inside a folder they are ranged and sorted by symbol, and each row group has
its bounds of the symbol and a Bloom filter of the order id.  A scan by symbol, mode and status opens one folder and
skips the row groups of other symbols; a lookup by id asks the filters.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Statuses of orders that are still under way.
OPEN_STATUSES = ("CREATED", "SUBMITTED", "PARTIALLY_FILLED")


class PositionTable:
    """A table with one row per key, stored under ``path`` in ``buckets`` hash buckets.

    ``buckets`` and ``key`` must stay the same for the life of a table.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: str = "symbol", buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _folders(self, path: str, name: str) -> list[int]:
        """Numbers n of the folders ``name=n`` under a path."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        names = (status.getPath().getName() for status in files.listStatus(folder) if status.isDirectory())
        return sorted(int(m[1]) for m in (re.fullmatch(rf"{name}=(\d+)", n) for n in names) if m)

    def _versions(self, buckets: Iterable[int], before: int | None = None) -> dict[int, list[int]]:
        found = {b: self._folders(f"{self.path}/bucket={b}", "version") for b in buckets}
        return {b: [v for v in vs if before is None or v < before] for b, vs in found.items()}

    def _rows(self, versions: dict[int, list[int]]) -> DataFrame:
        paths = [f"{self.path}/bucket={b}/version={vs[-1]}" for b, vs in sorted(versions.items()) if vs]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        """All rows, as the last finished batch left them."""
        return self._rows(self._versions(self._folders(self.path, "bucket")))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of the ``keys`` (one column); only their buckets are read."""
        wanted = keys.select(F.col(keys.columns[0]).alias(self.key)).distinct()
        return self._rows(self._versions(self._touched(wanted))).join(wanted, self.key, "left_semi")

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())  # at most one row per bucket

    def upsert(self, changes: DataFrame, batch: int, order: Column | str | None = None) -> None:
        """Put the rows of ``changes`` in; keys that are there already take the new row.

        ``batch`` numbers the changes, rising from 0; running the same batch again changes nothing.  With several rows
        of a key the one with the largest ``order`` counts; without ``order`` a key must come once.  Rows without a key
        are refused.
        """
        names = self.schema.names
        if order is not None:
            rest = [n for n in names if n != self.key]
            picked = F.max_by(F.struct(*rest), order if isinstance(order, Column) else F.col(order)).alias("row")
            changes = changes.groupBy(self.key).agg(picked).select(self.key, *[F.col(f"row.{n}").alias(n) for n in rest])
        once = F.when(F.col("n") == 1, True).otherwise(F.raise_error(F.lit("a key comes twice in a batch, or is null")))
        changes = changes.select(*[F.col(n).cast(self.schema[n].dataType).alias(n) for n in names])
        touched = self._touched(changes)
        if not touched:
            return
        held = self._rows(self._versions(touched, before=batch))
        # New rows and held ones meet in one shuffle; a key takes its new row if it has one.
        new, old = (df.select(self.key, F.struct(*names).alias("row"), F.lit(k).alias("new")) for df, k in ((changes, 1), (held, 0)))
        both = new.unionByName(old).groupBy(self.key).agg(
            F.max_by("row", "new").alias("row"), F.sum("new").alias("many")
        )
        both = both.withColumn("n", F.when(F.col(self.key).isNull(), 2).otherwise(F.greatest("many", F.lit(1))))
        rows = both.where(once).select("row.*").withColumns({"bucket": self._bucket(), "version": F.lit(batch)})
        rows = rows.repartition(len(touched), "bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(self.path)
        self._forget(touched, batch)

    def _forget(self, buckets: list[int], batch: int) -> None:
        """Remove all versions but the newest and the one before it."""
        jvm = self.spark._jvm
        for bucket, versions in self._versions(buckets, before=batch).items():
            for old in versions[:-1]:
                folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={bucket}/version={old}")
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_orders(orders: DataFrame, path: str, ids: int = 1_000_000, row_group: int | None = None, mode: str = "overwrite") -> None:
    """Orders (``symbol``, ``mode``, ``status``, ``client_order_id`` and others) in the layout that the scans below use.

    ``ids`` sizes the Bloom filter of a row group, ``row_group`` its bytes (Parquet's default if not given).
    """
    rows = orders.repartitionByRange("mode", "status", "symbol").sortWithinPartitions("mode", "status", "symbol")
    writer = rows.write.mode(mode).partitionBy("mode", "status")
    writer = writer.option("parquet.bloom.filter.enabled#client_order_id", "true").option("parquet.bloom.filter.expected.ndv#client_order_id", str(ids))
    if row_group:
        writer = writer.option("parquet.block.size", str(row_group))
    writer.parquet(path)


def orders_of(spark: SparkSession, path: str, symbol: str, mode: str, status: str | None = None, created: str = "created_at") -> DataFrame:
    """Orders of a symbol and mode, of one status if given, oldest first."""
    rows = spark.read.parquet(path).where((F.col("symbol") == symbol) & (F.col("mode") == mode))
    return (rows if status is None else rows.where(F.col("status") == status)).orderBy(created)


def order_by_id(spark: SparkSession, path: str, client_order_id: str) -> DataFrame:
    """The order of this id, if there is one."""
    return spark.read.parquet(path).where(F.col("client_order_id") == client_order_id)


def symbols_with_open_orders(spark: SparkSession, path: str, mode: str, symbols: Iterable[str] | None = None) -> DataFrame:
    """Symbols (of the given ones) with an order under way; only the folders of those statuses are opened."""
    rows = spark.read.parquet(path).where((F.col("mode") == mode) & F.col("status").isin(*OPEN_STATUSES))
    return (rows if symbols is None else rows.where(F.col("symbol").isin(*symbols))).select("symbol").distinct()
