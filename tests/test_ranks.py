import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidemark.operators import indicators as ind
from tidemark.operators.scan import lay_out


def test_counts_equal_a_plain_loop():
    rng = random.Random(8)
    for n in (0, 1, 2, 63, 64, 65, 400):
        values = np.array([rng.choice([rng.random(), 0.5, 0.25]) for _ in range(n)])
        for back in (1, 3, 64, 1000):
            start = np.maximum(0, np.arange(n) - back + 1)
            want = [int((values[s : i + 1] <= values[i]).sum()) for i, s in enumerate(start)]
            assert ind.counts_at_most(values, start).tolist() == want


@pytest.mark.parametrize("rows_per_task", [None, 90])
def test_long_windows_equal_short_ones(spark, monkeypatch, rows_per_task):
    """Undefined ratios, ties, NaN, a null key, windows within, across and beyond blocks, and columns of all kinds."""
    rng = random.Random(9)
    pick = lambda: rng.choice([None, rng.random(), rng.random(), 0.5, float("nan")])
    rows = [(k, i, pick(), [i]) for k, n in (("hot", 400), ("b", 37), ("one", 1)) for i in range(n)]
    if rows_per_task is None:
        rows += [(None, i, 0.5, None) for i in range(3)]
    df = spark.createDataFrame(rows, "market string, bar_idx bigint, ratio double, extra array<int>")
    monkeypatch.setattr(ind, "BLOCK_BARS", 64)
    out = []
    for limit in (1000, 0):
        monkeypatch.setattr(ind, "SHORT_WINDOW", limit)
        bars, s = lay_out(df, ["market"], ["bar_idx"], rows_per_task)
        ranked = ind.rolling_ranks(bars, s, {"r1": 1, "r20": 20, "r150": 150})
        ranked = ranked.drop("_chunk").withColumn("nan", F.isnan("ratio")).fillna(-1.0, ["ratio"])
        out.append(sorted(map(str, ranked.select("market", "bar_idx", "ratio", "nan", "extra", "r1", "r20", "r150").collect())))
    assert len(out[0]) == len(rows)
    assert out[0] == out[1]
