import math
import random

import pytest

from pyspark.sql import functions as F

from tidemark.operators.equity import compound, drawdown, with_metrics
from tidemark.operators.scan import lay_out


def stepwise(growth, start):
    out = [start]
    for g in growth[1:]:
        out.append(max(1e-12, out[-1] * g) if math.isfinite(g) and g > 0 else 1e-12)
    return out


@pytest.mark.parametrize("rows_per_task", [None, 15])
def test_floor_restarts_and_tiny_products(spark, rows_per_task):
    rng = random.Random(5)
    series = {
        "plain": [rng.uniform(0.9, 1.12) for _ in range(60)],
        "breaks": [rng.choice([rng.uniform(0.5, 1.6), rng.uniform(0.5, 1.6), 0.0, -0.3, float("nan"), float("inf")]) for _ in range(60)],
        "floor": [1e-4] * 8 + [rng.uniform(0.8, 1.4) for _ in range(52)],
        "vanishing": [1e-9] * 50 + [2.0] * 10,
    }
    rows = [(k, i, g) for k, gs in series.items() for i, g in enumerate(gs)]
    df = spark.createDataFrame(rows, "k string, bar_idx bigint, g double")
    df, s = lay_out(df, ["k"], ["bar_idx"], rows_per_task)
    out = drawdown(compound(df, s, F.col("g"), 1.0, "equity"), s).orderBy("bar_idx").collect()
    for k, gs in series.items():
        got = [r["equity"] for r in out if r["k"] == k]
        assert got == pytest.approx(stepwise(gs, 1.0), rel=1e-9), k
        peak, want = 0.0, []
        for v in got:
            peak = max(peak, v)
            want.append(v / peak - 1)
        assert [r["drawdown"] for r in out if r["k"] == k] == pytest.approx(want, abs=1e-12)


def test_metrics(spark):
    rows = [(1.21, -0.1, "2020-01-01", "2022-01-01"), (1.5, 0.0, "2020-01-01", "2020-01-01")]
    df = spark.createDataFrame(rows, "final_equity double, mdd double, a string, b string")
    df = df.withColumns({"first_ts": F.to_timestamp("a"), "last_ts": F.to_timestamp("b")})
    got = with_metrics(df).orderBy("final_equity").collect()
    assert got[0]["cagr"] == pytest.approx(1.21 ** (365.25 / 731) - 1)
    assert got[0]["calmar"] == pytest.approx(got[0]["cagr"] / 0.1)
    assert got[1]["cagr"] == pytest.approx(1.5**365.25 - 1) and got[1]["calmar"] is None
