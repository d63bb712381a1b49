import random

from pyspark.sql import functions as F

from tidemark.operators import scan
from tidemark.operators.scan import lay_out
from tidemark.session import materialize


def test_chunks_equal_plain_also_when_a_result_replaces_its_input(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice([None, rng.randint(1, 9)])) for k, n in (("hot", 90), ("b", 7)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(3)
    out = []
    for limit in (None, 11):
        rows_, s = lay_out(df, ["k"], ["i"], limit)
        assert (s.chunk is None) == (limit is None)
        rows_ = s.running(rows_, last=("last", F.col("v")), first=("first", F.col("v")), top=("max", F.col("v")), n=("sum", F.col("v")))
        rows_ = s.shift(rows_, v=F.col("v"), last=F.col("last"))
        rows_ = s.shift(rows_, forward=True, n=F.col("n"))
        rows_ = s.running(rows_, top=("min", F.col("top")))
        rows_ = s.whole(rows_, size=("sum", F.lit(1)), hi=("max", F.col("i")))
        rows_ = s.rolling(rows_, 5, "i", lambda w: {"five": F.sum("i").over(w.rowsBetween(-4, 0))})
        out.append(sorted(map(tuple, rows_.select("k", "i", "v", "last", "first", "top", "n", "size", "hi", "five").collect())))
    assert out[0] == out[1]


def test_sweeps_equal_plain_windows(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.choice([None, rng.randint(1, 9)])) for k, n in (("hot", 90), ("b", 7), ("one", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(3)
    v, out = F.col("v"), []
    for limit in (None, 11):
        rows_, s = lay_out(df, ["k"], ["i"], limit)
        first = {n: (n, v) for n in ("sum", "max", "min", "last", "first")}
        rows_ = s.sweep(
            rows_, running=first, before={f"{n}0": kind for n, kind in first.items()}, lag={"was": v}, lead={"next": v},
            whole={"size": ("sum", F.lit(1)), "hi": ("max", F.col("i"))},
        )
        rows_ = s.sweep(rows_, running={"v": ("last", v)}, before={"was": ("max", F.col("was"))}, lag={"next": F.col("v")})
        names = sorted(rows_.drop("_chunk").columns)
        out.append((names, sorted(map(tuple, rows_.select("k", "i", *names).collect()))))
    assert out[0] == out[1]


def test_only_rows_per_chunk_are_written_between_settled_panels(spark, monkeypatch):
    """The adaptive strategy in chunks: at most three writes of whole rows, the others hold one row per chunk."""
    from test_strategies import BARS, GRIDS, frame

    from tidemark.plans.experiment import panel, with_returns
    from tidemark.plans.strategies import REGISTRY, Run, backtest

    written = []

    def counted(df):
        out = materialize(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(scan, "materialize", counted)
    strategy = REGISTRY.get("v5")
    bars, series = with_returns(*panel(frame(spark), 90))
    rows, _ = backtest(strategy, Run(bars, series, strategy.grid(**{k: v[-1:] for k, v in GRIDS["v5"].items()})))
    n = sum(map(len, BARS.values()))
    assert rows.count() == n
    whole = [w for w in written if w >= n]
    assert len(whole) == 3 and len(written) <= 16
    assert max(w for w in written if w < n) <= 2 * -(-n // 90) + len(BARS)
