"""Running aggregates over ordered series, with a way round hot keys.

A *series* is all rows of one key (a market, a symbol) in a total order.  ``lay_out`` counts the rows of the
largest series.  When it fits one task, running aggregates are plain window functions.  When it does not, the
rows are range-partitioned on (key, order), so that one hot key spreads over many partitions, and a running
aggregate becomes: a window inside each chunk, one total per chunk, an exclusive scan over the totals, and a
join of that carry back to its chunk.  Only the totals are stored.  Both ways give the same values.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.scalar import AMOUNT
from tidemark.session import materialize

ROWS_PER_TASK = 1_000_000
#: Chunks at most; beyond that a chunk holds more rows.
MOST_CHUNKS = 20_000
CHUNK = "_chunk"


def _both(combine: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """Combine two partial values, where either may be missing."""
    return lambda carry, local: F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(combine(carry, local))


# kind -> (window aggregate, order-free?, combine(carry, local))
KINDS: dict[str, tuple[Callable, bool, Callable]] = {
    "sum": (F.sum, True, _both(lambda c, x: c + x)),
    # Ledger amounts: decimal(38,12) sums of values that fit decimal(37,12), so that adding two keeps all digits.
    # What does not fit is null; callers flag such keys by the size of their amounts.
    "amount": (F.try_sum, True, _both(lambda c, x: c.try_cast(AMOUNT) + x.try_cast(AMOUNT))),
    "max": (F.max, True, _both(lambda c, x: F.greatest(c, x))),
    "min": (F.min, True, _both(lambda c, x: F.least(c, x))),
    "product": (F.product, True, _both(lambda c, x: c * x)),
    "last": (lambda c: F.last(c, ignorenulls=True), False, lambda c, x: F.coalesce(x, c)),
    "first": (lambda c: F.first(c, ignorenulls=True), False, lambda c, x: F.coalesce(c, x)),
}


Specs = dict[str, tuple[str, Column]]


@dataclass(frozen=True)
class Series:
    """Key and order columns of a panel; ``chunk`` is set when a key may span several tasks."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    chunk: str | None = None
    rows_per_task: int = ROWS_PER_TASK

    def with_keys(self, *extra: str) -> Series:
        return replace(self, keys=self.keys + tuple(k for k in extra if k not in self.keys))

    def with_order(self, *order: str) -> Series:
        return replace(self, order=tuple(order))

    @property
    def cluster(self) -> list[str]:
        """Columns whose equal values may share a task."""
        return list(self.keys) + ([self.chunk] if self.chunk else [])

    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.cluster).orderBy(*self.order)

    def upto(self) -> WindowSpec:
        return self.ordered().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def _position(self) -> Column:
        return F.struct(*self.order)

    def settle(self, df: DataFrame) -> DataFrame:
        """With chunks, write the rows once, so that later sweeps start from here; plain series stay as they are."""
        return df if self.chunk is None else materialize(df)

    def sweep(
        self,
        df: DataFrame,
        running: Specs | None = None,
        before: Specs | None = None,
        lag: dict[str, Column] | None = None,
        lead: dict[str, Column] | None = None,
        whole: Specs | None = None,
    ) -> DataFrame:
        """All aggregates that read the columns of ``df`` as they are, in one pass: ``name=(kind, expression)``.

        ``running`` includes the row itself, ``before`` ends with the row before; nulls do not take part in either.
        ``lag`` and ``lead`` give the value the row before or after has, ``whole`` (kind sum, min or max) aggregates
        the whole series.

        With chunks the pass goes up and down: up, all results are reduced to one row per chunk, and these rows are
        moved along the chunks of their key and stored; down, each chunk takes its row and completes its own windows.
        Only the rows per chunk are written. The rows themselves move once, to the chunks they already have, and
        several sweeps are one plan over them; each stored reduction runs the sweeps since the last ``settle`` again.
        """
        running, before, lag, lead, whole = (x or {} for x in (running, before, lag, lead, whole))
        over, past = self.ordered(), self.ordered().rowsBetween(Window.unboundedPreceding, -1)
        inside = {n: KINDS[k][0](x).over(self.upto()) for n, (k, x) in running.items()}
        inside |= {n: KINDS[k][0](x).over(past) for n, (k, x) in before.items()}
        inside |= {n: F.lag(x, 1).over(over) for n, x in lag.items()} | {n: F.lead(x, 1).over(over) for n, x in lead.items()}
        if self.chunk is None:
            series = Window.partitionBy(*self.keys)
            return df.withColumns(inside | {n: KINDS[k][0](x).over(series) for n, (k, x) in whole.items()})
        # Helper names: a result may have the name of a column that another one still reads.
        local = df.withColumns(
            {f"_n_{n}": c for n, c in inside.items()}
            | ({"_head": F.lag(F.lit(1), 1).over(over).isNull()} if lag else {})
            | ({"_tail": F.lead(F.lit(1), 1).over(over).isNull()} if lead else {})
        )
        joined = local.join(self._carries(df, running | before, lag, lead, whole), self.cluster, "left")
        done = {n: KINDS[k][2](F.col(f"_c_{n}"), F.col(f"_n_{n}")) for n, (k, _) in (running | before).items()}
        for names, edge in ((lag, "_head"), (lead, "_tail")):
            done |= {n: F.when(F.col(edge), F.col(f"_c_{n}")["v"]).otherwise(F.col(f"_n_{n}")) for n in names}
        done |= {n: F.col(f"_c_{n}") for n in whole}
        return joined.withColumns(done).drop("_head", "_tail", *[f"_{p}_{n}" for p in "cn" for n in done])

    def _carries(self, df: DataFrame, totals: Specs, lag: dict[str, Column], lead: dict[str, Column], whole: Specs) -> DataFrame:
        """One row per chunk: what its key has before it, what its edge rows miss, and what the whole key has."""
        up = {}
        for n, (kind, x) in totals.items():
            agg, order_free, _ = KINDS[kind]
            pick = F.max_by if kind == "last" else F.min_by
            up[n] = agg(x) if order_free else pick(x, F.when(x.isNotNull(), self._position()))
        up |= {n: F.max_by(F.struct(x.alias("v")), self._position()) for n, x in lag.items()}
        up |= {n: F.min_by(F.struct(x.alias("v")), self._position()) for n, x in lead.items()}
        up |= {n: KINDS[k][0](x) for n, (k, x) in whole.items()}
        per_chunk = df.groupBy(*self.cluster).agg(*[c.alias(f"_t_{n}") for n, c in up.items()])
        series = Window.partitionBy(*self.keys)
        along = series.orderBy(self.chunk)
        past = along.rowsBetween(Window.unboundedPreceding, -1)
        down = {n: KINDS[k][0](F.col(f"_t_{n}")).over(past) for n, (k, _) in totals.items()}
        down |= {n: F.lag(f"_t_{n}", 1).over(along) for n in lag} | {n: F.lead(f"_t_{n}", 1).over(along) for n in lead}
        down |= {n: KINDS[k][0](F.col(f"_t_{n}")).over(series) for n, (k, _) in whole.items()}
        return materialize(per_chunk.select(*self.cluster, *[c.alias(f"_c_{n}") for n, c in down.items()]))

    def running(self, df: DataFrame, **specs: tuple[str, Column]) -> DataFrame:
        """Add inclusive running aggregates ``name=(kind, expression)``; nulls do not take part."""
        return self.sweep(df, running=specs)

    def shift(self, df: DataFrame, forward: bool = False, **specs: Column) -> DataFrame:
        """Add the value the previous row (or with ``forward`` the next row) has for each expression."""
        return self.sweep(df, lead=specs) if forward else self.sweep(df, lag=specs)

    def whole(self, df: DataFrame, **specs: tuple[str, Column]) -> DataFrame:
        """Add aggregates of the whole series, ``name=(kind, expression)`` with kind sum, min or max."""
        return self.sweep(df, whole=specs)

    def rolling(self, df: DataFrame, rows: int, idx: str, build: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
        """Add columns that look back at most ``rows - 1`` rows; ``idx`` numbers the rows of a series from 0.

        With chunks, fixed blocks of the row number are used and each block also receives the rows it looks
        back at (a copy of at most ``rows - 1`` rows), so no block depends on another.
        """
        if self.chunk is None:
            return df.withColumns(build(Window.partitionBy(*self.keys).orderBy(*self.order)))
        size = max(self.rows_per_task, rows)
        block = F.floor(F.col(idx) / size)
        late = F.col(idx) % size >= size - (rows - 1)
        spread = df.withColumn("_own", block).withColumn(
            "_blk", F.explode(F.when(late, F.array(block, block + 1)).otherwise(F.array(block)))
        )
        over = Window.partitionBy(*self.keys, "_blk").orderBy(*self.order)
        out = spread.withColumns(build(over)).where(F.col("_blk") == F.col("_own"))
        return materialize(out.drop("_blk", "_own"))


def lay_out(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_task: int | None = None
) -> tuple[DataFrame, Series]:
    """Choose plain windows or chunks from the row count of the largest series.

    ``keys`` + ``order`` must be unique.  The count reads the key columns only.
    """
    limit = rows_per_task or ROWS_PER_TASK
    sizes = df.groupBy(*keys).count().agg(F.max("count").alias("top"), F.sum("count").alias("rows")).first()
    series = Series(tuple(keys), tuple(order), None, limit)
    if (sizes["top"] or 0) <= limit:
        return df, series
    parts = min(MOST_CHUNKS, max(2, math.ceil(sizes["rows"] / limit)))
    spread = df.repartitionByRange(parts, *keys, *order).withColumn(CHUNK, F.spark_partition_id())
    return materialize(spread), replace(series, chunk=CHUNK)


def number(
    df: DataFrame, series: Series, idx: str = "bar_idx", n: str | None = "n_bars", **around: dict[str, Column]
) -> DataFrame:
    """Row number from 0 in each series and, if wanted, the length of the series; ``around`` takes lag and lead."""
    one = ("sum", F.lit(1).cast("bigint"))
    out = series.sweep(df, running={idx: one}, whole={n: one} if n else None, **around)
    return out.withColumn(idx, F.col(idx) - 1)


def affine(df: DataFrame, series: Series, values: dict[str, str], alpha: str, seed: str, pos: str) -> DataFrame:
    """Smoothing recurrences ``y = alpha*x + (1-alpha)*y_prev`` seeded with the mean of the first ``seed`` rows.

    All arguments are SQL expressions; ``pos`` numbers the rows from 0, and ``y`` is undefined before row
    ``seed - 1``.  Rows after the seed are cut into runs short enough for ``(1-alpha)**-k`` to stay finite.
    Inside a run the recurrence is a scaled running sum; a run starts from the end of the run before it.  What
    lies further back has weight ``exp(-600)``, below anything a double can show.
    """
    df = df.selectExpr("*", f"{pos} - {seed} AS _rest", f"1.0D - {alpha} AS _q").selectExpr(
        "*", "if(_q > 0, floor(-600.0D / ln(if(_q > 0, _q, NULL))), 1L) AS _span"
    )
    df = df.selectExpr(
        "*",
        "if(_rest < 0, -1L, CAST(floor(_rest / _span) AS BIGINT)) AS _run",
        "if(_rest < 0, NULL, CAST(_rest % _span AS DOUBLE)) AS _off",
    )
    over = f"OVER (PARTITION BY {_names((*series.keys, '_run'))} ORDER BY {_names(series.order)} ROWS UNBOUNDED PRECEDING)"
    df = df.selectExpr(
        "*", *[f"sum(({x}) * if(_run = -1, 1.0D, power(_q, -_off))) {over} AS _sum_{n}" for n, x in values.items()]
    )
    seeded = f"if({pos} = {seed} - 1, _sum_{{0}} / {seed}, NULL)"
    inside = f"({alpha}) * power(_q, _off) * _sum_{{0}}"
    df = df.selectExpr("*", *[f"if(_run = -1, {seeded.format(n)}, {inside.format(n)}) AS _in_{n}" for n in values])
    ends = "CASE WHEN _run = -1 OR _off = _span - 1 THEN _in_{0} END"
    df = series.sweep(df, before={f"_prev_{n}": ("last", F.expr(ends.format(n))) for n in values})
    full = "if(_run = -1, _in_{0}, _in_{0} + power(_q, _off + 1) * _prev_{0}) AS {0}"
    helpers = ["_rest", "_q", "_span", "_run", "_off"] + [f"_{p}_{n}" for n in values for p in ("sum", "in", "prev")]
    return df.selectExpr("*", *[full.format(n) for n in values]).drop(*helpers)


def _names(columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}`" for c in columns)
