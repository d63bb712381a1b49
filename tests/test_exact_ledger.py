"""Average positions rounded after every buy, and amounts over the whole range of the ledger."""

import random
from decimal import ROUND_HALF_UP, Decimal, localcontext

import pytest

from tidemark.operators.ledger import BEYOND, execution_metrics, managed_quantity, round_trips, weighted_positions

D = Decimal
P12 = D("0.000000000001")
MOVES = "symbol string, n int, side string, qty decimal(38,12), price decimal(38,12)"
FILLED = "symbol string, n int, side string, executed_volume double, avg_executed_price double, fee_amount double"


def steps(moves):
    qty = avg = D(0)
    with localcontext() as c:
        c.prec = 90
        for side, q, p in moves:
            if side == "BUY":
                avg = ((avg * qty + p * q) / (qty + q)).quantize(P12, ROUND_HALF_UP)
                qty += q
            else:
                qty = qty - q if qty > q else D(0)
                avg = avg if qty else D(0)
    return qty, avg


def random_moves(rng, n, sells):
    return [
        ("SELL" if rng.random() < sells else "BUY", D(rng.randrange(1, 10**9)).scaleb(-rng.choice((0, 6, 9))).quantize(P12), D(rng.randrange(1, 10**15)).scaleb(-12))
        for _ in range(n)
    ]


@pytest.mark.parametrize("rows_per_task", [None, 900])
def test_ten_thousand_moves_to_the_last_place(spark, rows_per_task):
    rng = random.Random(5)
    data = {"hot": random_moves(rng, 6000, 0.3), "never flat": random_moves(rng, 3000, 0.0), "B": random_moves(rng, 990, 0.6), "flat": [("BUY", D(2), D(3)), ("SELL", D(2), D(9))], "sold": [("SELL", D(1), D(1))]}
    rows = [(k, i, s, q, p) for k, ms in data.items() for i, (s, q, p) in enumerate(ms)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, MOVES).repartition(7)
    got = {r.symbol: r for r in weighted_positions(df, ["symbol"], ["n"], rows_per_task).collect()}
    assert set(got) == set(data)
    for k, ms in data.items():
        qty, avg = steps(ms)
        assert (got[k].qty, got[k].avg_price, got[k].error) == (qty, avg, None), k
        assert got[k].state == ("LONG" if qty else "FLAT")


LARGE = [("m12", 1e12), ("m16", 1e16), ("m20", 1e20), ("m24", 1e24)]


@pytest.mark.parametrize("rows_per_task", [None, 2])
def test_large_amounts_are_right_and_larger_ones_are_named(spark, rows_per_task):
    rows = []
    for k, q in LARGE:
        rows += [(k, 1, "BUY", q, 2.0, 0.0), (k, 2, "SELL", q / 4, 3.0, 0.0), (k, 3, "SELL", q, 4.0, 0.0), (k, 4, "BUY", q / 2, 8.0, 0.0), (k, 5, "BUY", q / 2, 4.0, 0.0)]
    for k, q in (("m25", 1e25), ("m30", 1e30)):
        rows += [(k, 1, "BUY", 1.0, 2.0, 0.0), (k, 2, "BUY", q, 2.0, 0.0), (k, 3, "SELL", 1.0, 2.0, 0.0)]
    rows += [("small", 1, "BUY", 1.0, 2.0, 0.0), ("small", 2, "SELL", 1.0, 3.0, 0.0)]
    df = spark.createDataFrame(rows, FILLED).repartition(3)
    held = {r.symbol: r for r in managed_quantity(df, ["symbol"], ["n"], rows_per_task).collect()}
    moves = df.withColumnsRenamed({"executed_volume": "qty", "avg_executed_price": "price"})
    pos = {r.symbol: r for r in weighted_positions(moves, ["symbol"], ["n"], rows_per_task).collect()}
    trips = {(r.symbol, r.trip): r for r in round_trips(df, ["symbol"], ["n"], rows_per_task).collect()}
    result = {r.symbol: r for r in execution_metrics(df, ["symbol"], ["n"], rows_per_task).collect()}
    for k, q in LARGE:
        assert held[k].managed_qty == D(str(q)) and held[k].error is None
        assert (pos[k].qty, pos[k].avg_price, pos[k].state, pos[k].error) == (D(str(q)), D(6), "LONG", None)
        assert trips[k, 0].pnl == pytest.approx(q * 1.75) and trips[k, 0].closed
        assert result[k].realized_pnl == pytest.approx(q * 1.75) and result[k].error is None
    for k in ("m25", "m30"):
        assert (held[k].managed_qty, held[k].error) == (None, BEYOND)
        assert (pos[k].qty, pos[k].avg_price, pos[k].state, pos[k].error) == (None, None, None, BEYOND)
        assert [(r.pnl, r.closed, r.error) for (s, _), r in trips.items() if s == k] == [(None, False, BEYOND)]
        assert (result[k].realized_pnl, result[k].trade_count, result[k].error) == (None, 0, BEYOND)
    assert held["small"].managed_qty == 0 and result["small"].realized_pnl == pytest.approx(1.0) and result["small"].error is None


def test_chunks_keep_the_last_place_of_sums(spark):
    rows = [("A", i, "BUY" if i % 2 else "SELL", D("100000000000000000000.000000000001") if i % 2 else D("99999999999999999999.999999999999"), D(1)) for i in range(1, 41)]
    df = spark.createDataFrame(rows, MOVES)
    got = managed_quantity(df.withColumnRenamed("qty", "executed_volume"), ["symbol"], ["n"], 4).first()
    assert got.managed_qty == D("0.000000000040")
