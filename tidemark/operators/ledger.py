"""Ledger folds: managed quantity, realised profit per round trip, weighted-average positions.

The held quantity of a symbol is a running sum that never goes below zero, which window sums give exactly in
decimals.  Everything else is linear in the cost basis (or average price) carried from row to row, so rows fold
into linear maps: blocks of rows first, then blocks of blocks.  No symbol, however hot, is folded in one piece.

The average price of a position is rounded after each buy, which is not linear: it is a walk over the buys since the
position was last flat, in whole numbers of 1e-12, and a long walk goes block by block, each block taking over where
the one before stopped.

Amounts are decimal(37,12).  A key with an amount beyond it, or whose amounts add up to more than ``MOST``, has no result
and says so in ``error``; all other keys are not affected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import AMOUNT, WIDE
from tidemark.operators.scan import Series, lay_out
from tidemark.session import materialize, share_package, stored, work_partitions

BLOCK = 4096
#: A key's amounts may add up to this: sums and differences of them keep all twelve places.
MOST = 9e24
BEYOND = "amount beyond the ledger"
UNIT = 10**12


def signed_volume(side: Column, volume: Column) -> Column:
    """Bought quantity as plus, sold as minus; rows without side or volume, or beyond the ledger, count nothing."""
    zero = F.lit(0).cast(AMOUNT)
    amount = F.coalesce(F.when(volume > 0, volume).try_cast(AMOUNT), zero)
    return F.when(side == "BUY", amount).when(side == "SELL", (-amount).cast(AMOUNT)).otherwise(zero)


def _size(side: Column, *amounts: Column) -> Column:
    """How much an order adds to what its key may add up to; infinite where an amount does not fit."""
    sizes = [F.coalesce(F.abs(x.try_cast("double")), F.lit(0.0)) for x in amounts]
    fits = F.lit(True)
    for x in amounts:
        fits = fits & (x.isNull() | x.try_cast(AMOUNT).isNotNull())
    return F.when(side.isin("BUY", "SELL"), F.when(fits, F.greatest(*sizes, F.lit(0.0))).otherwise(float("inf"))).otherwise(0.0)


def _with_beyond(rows: DataFrame, series: Series) -> DataFrame:
    """Flag ``_beyond`` on all rows of the keys that the ledger cannot hold, from ``_size``."""
    rows = series.whole(rows, _all=("sum", F.col("_size")))
    return rows.withColumn("_beyond", F.coalesce(~(F.col("_all") <= MOST), F.lit(False))).drop("_all", "_size")


def running_quantity(df: DataFrame, series: Series, delta: Column, name: str = "held") -> DataFrame:
    """Running sum of ``delta`` with a floor of zero at every step: W - min(0, lowest W so far)."""
    df = series.running(df, _w=("amount", delta.cast(AMOUNT)))
    df = series.running(df, _low=("min", F.col("_w")))
    zero = F.lit(0).cast(AMOUNT)
    held = F.col("_w").try_cast(AMOUNT) - F.least(zero, F.col("_low").try_cast(AMOUNT))
    return df.withColumn(name, held.cast(WIDE)).drop("_w", "_low")


def managed_quantity(
    orders: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_task: int | None = None
) -> DataFrame:
    """Quantity the engine's own executed orders account for, per key."""
    volume = F.col("executed_volume")
    slim = orders.select(*keys, *order, signed_volume(F.col("side"), volume).alias("_d"), _size(F.col("side"), F.when(volume > 0, volume)).alias("_size"))
    rows, series = lay_out(slim, keys, order, rows_per_task)
    rows = running_quantity(rows, series, F.col("_d"), "managed_qty")
    held = rows.groupBy(*keys).agg(F.max_by("managed_qty", F.struct(*order)).alias("q"), (~(F.sum("_size") <= MOST)).alias("b"))
    return held.select(*keys, F.when(~F.col("b"), F.col("q")).alias("managed_qty"), F.when(F.col("b"), BEYOND).alias("error"))


def _fold_levels(
    rows: DataFrame, keys: list[str], at: str, start: Column, step: Callable[[Column, Column], Column], join_: Callable
) -> DataFrame:
    """Fold rows to one struct ``m`` per key: row blocks with ``step``, then blocks with ``join_``."""
    payload = [c for c in rows.columns if c not in keys and c != at]
    out = rows.groupBy(*keys, F.floor(F.col(at) / BLOCK).alias("_b")).agg(
        F.aggregate(F.array_sort(F.collect_list(F.struct(at, *payload))), start, step).alias("m")
    )
    for wider in (F.floor(F.col("_b") / BLOCK), F.lit(0).cast("bigint")):
        out = out.groupBy(*keys, wider.alias("_up")).agg(
            F.aggregate(
                F.array_sort(F.collect_list(F.struct("_b", "m"))), start, lambda acc, e: join_(acc, e["m"])
            ).alias("m")
        ).withColumnRenamed("_up", "_b")
    return out.select(*keys, "m")


def _struct(**cols: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for n, c in cols.items()])


def round_trips(
    orders: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_task: int | None = None
) -> DataFrame:
    """Profit and cost of each round trip (flat to flat) with average cost including buy fees.

    Needs ``side``, ``executed_volume``, ``avg_executed_price``, ``fee_amount``.  A sell is capped at the held
    quantity, its fee in proportion.  ``closed`` tells whether the trip ended flat.  A key beyond the ledger has one
    row, with ``error``.
    """
    keys = list(keys)
    volume, price = F.col("executed_volume"), F.col("avg_executed_price").try_cast("double")
    valid = F.col("side").isin("BUY", "SELL") & (volume > 0) & (price > 0)
    slim = orders.where(valid).select(
        *keys,
        *order,
        F.col("side"),
        F.coalesce(volume.try_cast(AMOUNT), F.lit(0)).cast(WIDE).alias("qty"),
        _size(F.col("side"), volume).alias("_size"),
        price.alias("price"),
        F.greatest(F.coalesce(F.col("fee_amount").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("fee"),
    )
    rows, series = lay_out(slim, keys, order, rows_per_task)
    rows = _with_beyond(rows, series)
    rows = running_quantity(rows, series, F.when(F.col("_beyond"), F.lit(0)).otherwise(signed_volume(F.col("side"), F.col("qty"))))
    rows = series.shift(rows, before=F.col("held"))
    rows = rows.withColumn("before", F.coalesce("before", F.lit(0).cast(WIDE)))
    flat = (F.col("side") == "SELL") & (F.col("before") > 0) & (F.col("held") == 0)
    rows = series.running(rows, _n=("sum", F.lit(1).cast("bigint")), _flats=("sum", flat.cast("bigint")))
    live = F.when(F.col("_beyond"), F.col("_n") == 1).otherwise((F.col("side") == "BUY") | (F.col("before") > 0))
    sold = F.least(F.col("before"), F.col("qty")).cast("double")
    share = F.when(sold < F.col("qty").cast("double"), sold / F.col("qty").cast("double")).otherwise(F.lit(1.0))
    is_buy = F.col("side") == "BUY"
    moves = rows.where(live).select(
        *keys,
        "_beyond",
        (F.col("_flats") - flat.cast("bigint")).alias("trip"),
        F.col("_n").alias("at"),
        F.when(is_buy, F.col("price") * F.col("qty").cast("double") + F.col("fee")).otherwise(0.0).alias("paid"),
        F.when(is_buy, 0.0).otherwise(F.col("price") * sold - F.col("fee") * share).alias("got"),
        F.when(is_buy, 0.0).otherwise(sold / F.nullif(F.col("before"), F.lit(0)).cast("double")).alias("part"),
        F.when(flat, 1.0).otherwise(0.0).alias("flat"),
    )
    # Carried cost basis c: c' = m*c + b;  profit = pa*c + pb;  cost of sold units = ca*c + cb.
    zero = F.lit(0.0)
    start = _struct(m=F.lit(1.0), b=zero, pa=zero, pb=zero, ca=zero, cb=zero, flat=zero)

    def step(acc: Column, e: Column) -> Column:
        sell_m, sell_b = acc["m"] * e["part"], acc["b"] * e["part"]
        return _struct(
            m=acc["m"] - sell_m,
            b=F.when(e["flat"] > 0, 0.0).otherwise(acc["b"] + e["paid"] - sell_b),
            pa=acc["pa"] - sell_m,
            pb=acc["pb"] + e["got"] - sell_b,
            ca=acc["ca"] + sell_m,
            cb=acc["cb"] + sell_b,
            flat=F.greatest(acc["flat"], e["flat"]),
        )

    def both(a: Column, b: Column) -> Column:
        return _struct(
            m=a["m"] * b["m"],
            b=a["b"] * b["m"] + b["b"],
            pa=a["pa"] + a["m"] * b["pa"],
            pb=a["pb"] + a["b"] * b["pa"] + b["pb"],
            ca=a["ca"] + a["m"] * b["ca"],
            cb=a["cb"] + a["b"] * b["ca"] + b["cb"],
            flat=F.greatest(a["flat"], b["flat"]),
        )

    trips = _fold_levels(moves, [*keys, "trip", "_beyond"], "at", start, step, both)
    good = ~F.col("_beyond")
    return trips.select(
        *keys,
        "trip",
        F.when(good, F.col("m.pb")).alias("pnl"),
        F.when(good, F.col("m.cb")).alias("cost"),
        (good & (F.col("m.flat") > 0)).alias("closed"),
        F.when(~good, BEYOND).alias("error"),
    )


METRICS = [
    "realized_pnl",
    "realized_return_pct",
    "max_drawdown_pct",
    "trade_count",
    "win_rate_pct",
    "avg_win_pct",
    "avg_loss_pct",
    "rr_ratio",
    "expectancy_pct",
]


def execution_metrics(
    orders: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_task: int | None = None
) -> DataFrame:
    """Realised result, win rate, averages and drawdown of the closed trades of each key."""
    keys = list(keys)
    trips = materialize(round_trips(orders, keys, order, rows_per_task))
    trips, series = lay_out(trips, keys, ["trip"], rows_per_task)
    ret = F.when(F.col("closed") & (F.col("cost") > 0), F.col("pnl") / F.col("cost") * 100.0)
    trips = trips.withColumn("ret", ret)
    trips = series.running(trips, _curve=("product", 1.0 + F.col("ret") / 100.0))
    trips = series.running(trips, _peak=("max", F.greatest(F.lit(1.0), F.col("_curve"))))
    fall = F.when(F.col("ret").isNotNull(), (F.col("_curve") / F.col("_peak") - 1.0) * 100.0)
    sums = trips.groupBy(*keys).agg(
        F.sum("pnl").alias("realized_pnl"),
        F.sum("cost").alias("_cost"),
        F.least(F.lit(0.0), F.min(fall)).alias("_fall"),
        F.count("ret").alias("trade_count"),
        F.count_if(F.col("ret") > 0).alias("_wins"),
        F.avg(F.when(F.col("ret") > 0, F.col("ret"))).alias("avg_win_pct"),
        F.avg(F.when(F.col("ret") < 0, -F.col("ret"))).alias("avg_loss_pct"),
        F.avg("ret").alias("expectancy_pct"),
        F.max("error").alias("error"),
    )
    traded = F.col("trade_count") > 0
    return sums.select(
        *keys,
        "realized_pnl",
        F.when(F.col("_cost") > 0, F.col("realized_pnl") / F.col("_cost") * 100.0).alias("realized_return_pct"),
        F.when(traded, F.col("_fall")).alias("max_drawdown_pct"),
        "trade_count",
        F.when(traded, F.col("_wins") * 100.0 / F.col("trade_count")).alias("win_rate_pct"),
        "avg_win_pct",
        "avg_loss_pct",
        F.when(F.col("avg_loss_pct") > 0, F.col("avg_win_pct") / F.col("avg_loss_pct")).alias("rr_ratio"),
        "expectancy_pct",
        "error",
    )


def _units(column: pa.Array) -> list[int | None]:
    """Decimals with twelve places as whole numbers of 1e-12."""
    halves = np.frombuffer(column.buffers()[1], np.int64)[2 * column.offset : 2 * (column.offset + len(column))]
    low, high = halves[0::2].view(np.uint64).tolist(), halves[1::2].tolist()
    given = column.is_valid().to_pylist()
    return [(h << 64) + x if ok else None for ok, x, h in zip(given, low, high, strict=True)]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The average price after a key's buys, rounded half up to twelve places after each of them.

    The last four columns are the place, quantity, price and the quantity held afterwards.  A first row without
    quantity brings the average so far.
    """
    first, at, average = None, -1, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if first is None:
            first = batch.slice(0, 1)
        place, qty, price, held = (batch.column(batch.num_columns - k) for k in (4, 3, 2, 1))
        for n, q, p, h in zip(place.to_pylist(), _units(qty), _units(price), _units(held), strict=True):
            if n < at:
                raise ValueError("buys out of order")
            at = n
            if q is None:
                average = p
            else:
                average = (2 * (average * (h - q) + p * q) + h) // (2 * h)
    if first is not None:
        text = f"{average // UNIT}.{average % UNIT:012d}"
        keys = first.schema.names[:-4]
        yield pa.RecordBatch.from_arrays([*(first.column(c) for c in keys), pa.array([text])], [*keys, "avg_price"])


_walk.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}


def average_after(buys: DataFrame, keys: list[str], rows_per_task: int) -> DataFrame:
    """(keys, avg_price) after the ``buys`` (keys, _n, qty, price, held) of each key, in the order of ``_n`` from 1.

    Keys of up to ``rows_per_task`` places are one group each.  Longer ones are stored by block of places and go round by
    round: a round reads one block of each key, and the price it ends with is the first row of the next round.
    """
    share_package(buys.sparkSession)
    schema = buys.select(*keys).schema.add("avg_price", "string")
    parts = work_partitions(buys.sparkSession)
    walk = lambda df: df.repartition(parts, *keys).sortWithinPartitions(*keys, "_n").groupBy(*keys).applyInArrow(_walk, schema)
    rows = stored(buys.withColumn("_block", F.floor((F.col("_n") - 1) / rows_per_task).cast("int")), "_block")
    last = rows.agg(F.max("_block")).first()[0]
    if not last:
        return walk(rows.drop("_block")).withColumn("avg_price", F.col("avg_price").cast(WIDE))
    names = [*keys, "_n", "qty", "price", "held"]
    ends = rows.groupBy(*keys).agg(F.max("_block").alias("_end"))
    done, state = None, None
    for block in range(last + 1):
        part = rows.where(F.col("_block") == block).select(*names)
        if state is not None:
            none = F.lit(None).cast(WIDE)
            part = part.unionByName(state.select(*keys, F.lit(0).cast("long").alias("_n"), none.alias("qty"), F.col("avg_price").alias("price"), none.alias("held")))
        after = walk(part).withColumn("avg_price", F.col("avg_price").cast(WIDE)).join(ends, keys)
        after = materialize(after)
        over = after.where(F.col("_end") <= block).select(*keys, "avg_price")
        done = over if done is None else done.unionByName(over)
        state = after.where(F.col("_end") > block)
    return done


def weighted_positions(
    moves: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_task: int | None = None
) -> DataFrame:
    """Quantity, average price and state per key after buys (weighted average) and sells (average kept).

    Needs ``side``, ``qty`` > 0 and ``price``.  Selling everything or more leaves a flat position at price 0.  Prices
    are decimals of twelve places (a finer one is rounded), and the average is rounded half up after every buy.
    """
    keys = list(keys)
    wanted = F.when(F.col("price").isNull(), F.lit(0)).otherwise(F.col("price"))
    slim = moves.where((F.col("qty") > 0) & F.col("side").isin("BUY", "SELL")).select(
        *keys,
        *order,
        "side",
        F.coalesce(F.col("qty").try_cast(AMOUNT), F.lit(0)).cast(WIDE).alias("qty"),
        F.coalesce(wanted.try_cast(AMOUNT), F.lit(0)).cast(WIDE).alias("price"),
        _size(F.col("side"), F.col("qty"), F.when(F.col("side") == "BUY", wanted)).alias("_size"),
    )
    rows, series = lay_out(slim, keys, order, rows_per_task)
    rows = _with_beyond(rows, series)
    rows = running_quantity(rows, series, F.when(F.col("_beyond"), F.lit(0)).otherwise(signed_volume(F.col("side"), F.col("qty"))))
    rows = series.running(rows, _n=("sum", F.lit(1).cast("bigint")))
    # Nothing before the last flat point matters, and sells keep the average.
    rows = materialize(series.whole(rows, _flat=("max", F.when(F.col("held") == 0, F.col("_n")))))
    ends = rows.groupBy(*keys).agg(F.max_by("held", "_n").alias("qty"), F.max("_beyond").alias("b"))
    since = F.col("_n") - F.coalesce("_flat", F.lit(0).cast("bigint"))
    buys = rows.where((F.col("side") == "BUY") & (since > 0) & ~F.col("_beyond"))
    buys = buys.select(*keys, since.alias("_n"), "qty", "price", "held")
    joined = ends.join(average_after(buys, keys, series.rows_per_task), keys, "left")
    long, bad = F.col("qty") > 0, F.col("b")
    return joined.select(
        *keys,
        F.when(~bad, F.col("qty")).alias("qty"),
        F.when(~bad, F.when(long, F.col("avg_price")).otherwise(F.lit(0).cast(WIDE))).alias("avg_price"),
        F.when(~bad, F.when(long, "LONG").otherwise("FLAT")).alias("state"),
        F.when(bad, BEYOND).alias("error"),
    )
