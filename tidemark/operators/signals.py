"""Batch form of the repeated-signal filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import lay_out


def drop_repeats(signals: DataFrame, order: Sequence[str], rows_per_task: int | None = None) -> DataFrame:
    """Signals whose time differs from the one before for the same market and side."""
    rows, series = lay_out(signals, ["market", "side"], order, rows_per_task)
    rows = series.shift(rows, _sent=F.col("signal_ts"))
    return rows.where(~F.col("signal_ts").eqNullSafe(F.col("_sent"))).drop("_sent")
