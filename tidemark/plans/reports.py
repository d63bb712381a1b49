"""Comparison tables over run summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def concat_versions(*tables: DataFrame) -> DataFrame:
    """Rows of several strategy versions under each other; columns one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def walkforward_means(rows: DataFrame) -> DataFrame:
    """Averages per version over markets and splits, best mean calmar first."""
    return (
        rows.groupBy("version")
        .agg(
            *[F.avg(c).alias(f"mean_{c}") for c in ("cagr", "mdd", "calmar", "final_equity", "trades")],
            F.count(F.lit(1)).alias("runs"),
        )
        .orderBy(F.col("mean_calmar").desc_nulls_last(), "version")
    )


def stability(rows: DataFrame) -> DataFrame:
    """Spread of test results over the splits of each market and version."""
    return rows.groupBy("version", "market").agg(
        F.avg(F.col("final_equity") / F.col("final_equity_bh")).alias("mean_vs_hold"),
        F.stddev_samp("cagr").alias("sd_cagr"),
        F.stddev_samp("final_equity").alias("sd_equity"),
        F.min("mdd").alias("worst_mdd"),
    )


def validation_gap(summaries: DataFrame) -> DataFrame:
    """Test against validation of hold-out summaries, and final equity against buy and hold."""
    pick = lambda s, c: F.max(F.when(F.col("segment") == s, F.col(c)))
    return summaries.groupBy("market").agg(
        (pick("test", "cagr") - pick("validation", "cagr")).alias("cagr_gap"),
        (pick("test", "mdd") - pick("validation", "mdd")).alias("mdd_gap"),
        (pick("test", "final_equity") / pick("test", "final_equity_bh")).alias("test_vs_hold"),
    )


def percent_text(x: Column) -> Column:
    """Share as percent with two decimals."""
    return F.format_string("%.2f%%", x * 100)


def summary_table(summaries: DataFrame, name: Column) -> DataFrame:
    """Printable summary: equity with four decimals, growth and drawdown in percent."""
    return summaries.select(
        name.alias("run"),
        F.format_string("%.4f", "final_equity").alias("final_equity"),
        F.format_string("%.4f", "final_equity_bh").alias("final_equity_bh"),
        percent_text(F.col("cagr")).alias("cagr"),
        percent_text(F.col("mdd")).alias("mdd"),
        "trades",
        "range",
    )
