"""Ledger decimals against exact arithmetic: one rounding, nothing silently zero."""

import random
from decimal import ROUND_DOWN, ROUND_HALF_UP, Decimal, getcontext

import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalar import dec, div_down, div_half_up, mul12, mul_down
from tidemark.operators.orders import paper_fill, spendable

UNIT = Decimal("0.000000000001")
LIMIT = Decimal(10) ** 25


@pytest.fixture(autouse=True)
def digits():
    getcontext().prec = 120


def fits(x):
    return x if abs(x) < LIMIT else None


def test_products_and_quotients(spark):
    r = random.Random(12)
    amount = lambda most: Decimal(r.randrange(10 ** (12 + r.choice([0, 1, 3, 6, 12, most])))) * UNIT * r.choice([1, -1])
    rows = [(amount(24), r.choice([amount(19), Decimal(r.choice([0, 1, 2, 3, 7, 8])), UNIT])) for _ in range(10_000)]
    a, b = F.col("a"), F.col("b")
    out = spark.createDataFrame(rows, "a decimal(37,12), b decimal(37,12)").select(
        a, b, mul12(a, b).alias("m"), mul_down(a, b).alias("md"), div_half_up(a, b).alias("q"), div_down(a, b).alias("qd")
    )
    for x in out.collect():
        assert (x.m, x.md) == tuple(fits((x.a * x.b).quantize(UNIT, mode)) for mode in (ROUND_HALF_UP, ROUND_DOWN)), x
        want = tuple(fits((x.a / x.b).quantize(UNIT, mode)) if x.b else None for mode in (ROUND_HALF_UP, ROUND_DOWN))
        assert (x.q, x.qd) == want, x


def test_large_amounts_are_read_or_unknown(spark):
    text = {"999999999999": 999999999999, "1000000000000": 10**12, "1e20": 10**20, "x": 0, "NaN": 0, "1e30": None}
    rows = spark.createDataFrame([(k,) for k in text], "t string").select("t", dec(F.col("t")).alias("d")).collect()
    assert {x.t: x.d for x in rows} == text
    assert spark.createDataFrame([(None,)], "t string").select(dec(F.col("t")).alias("d")).first().d == 0


def test_large_orders_are_filled_or_refused(spark):
    rows = [
        (1, "MARKET_BUY", Decimal("2"), Decimal("2000000000000"), Decimal("2000000000000")),
        (2, "LIMIT", None, Decimal("3"), Decimal(10) ** 20),
        (3, "LIMIT", Decimal(10) ** 20, Decimal(10) ** 10, Decimal(1)),
        (4, "MARKET_BUY", None, Decimal("5"), Decimal("5")),
        (5, "LIMIT", Decimal("1"), None, Decimal("0")),
    ]
    orders = spark.createDataFrame(rows, "id int, order_type string, quantity decimal(37,12), price decimal(37,12), requested_notional decimal(37,12)")
    out = {x.id: x for x in paper_fill(orders, "0.0005").collect()}
    assert (out[1].avg_executed_price, out[1].fee_amount, out[1].status) == (10**12, 10**9, "FILLED")
    assert (out[2].executed_volume, out[2].fee_amount) == (Decimal("33333333333333333333.333333333333"), Decimal("50000000000000000") - Decimal("0") )
    assert (out[3].amount_error, out[3].fee_amount, out[3].status) == ("amount_out_of_range", None, "CREATED")
    assert (out[4].executed_volume, out[4].avg_executed_price, out[4].amount_error) == (0, 0, None)
    assert (out[5].executed_volume, out[5].fee_amount, out[5].amount_error) == (1, 0, None)


def test_spendable_is_cut_once(spark):
    rows = spark.createDataFrame([("1000000000000000.5",), ("2000.9",), (None,)], "t string")
    out = [x.s for x in rows.select(spendable(dec(F.col("t")), "0.0005").alias("s")).collect()]
    assert out == [999500000000000, 1999, 0]


def test_snapshots_beyond_the_ledger_are_named_and_the_next_one_counts_on(spark):
    from tidemark.operators.reconcile import SNAPSHOT_SCHEMA, reconcile

    def poll(seq, volume, fee="0", trades=()):
        cells = [("KRW-A", f"t{k}", p, v, f, "bid", "2026-01-01T00:00:00Z") for k, (p, v, f) in enumerate(trades)]
        return ("o1", seq, "KRW-A", "BUY", "u", "bid", "limit", "10", "wait", "KRW-A", None, "1", "1", "0", "0", fee, "0", volume, len(cells), cells)

    rows = [poll(1, "1"), poll(2, "1e27"), poll(3, "3", fee="1e30"), poll(4, "4", trades=[("1e20", "1e20", None)])]
    df = spark.createDataFrame(rows, f"order_id string, seq int, symbol string, order_side string, {SNAPSHOT_SCHEMA}")
    for rows_per_task in (None, 2):
        got = {r.seq: r for r in reconcile(df, rows_per_task).collect()}
        assert [got[k].delta_qty for k in (1, 2, 3, 4)] == [1, None, 2, 1]
        assert got[1].error is None and got[2].error == "executed volume beyond the ledger" and got[2].executed_volume is None
        assert got[3].error == "fee beyond the ledger" and "fills beyond the ledger" in got[4].error


def test_usual_products_and_quotients_are_compiled(spark):
    """Nothing that Spark interprets row by row: no lambda in the plan, and short methods only."""
    from tidemark.catalog.base import table

    a, b, seven = F.col("a"), F.col("b"), F.lit(Decimal(7)).cast("decimal(37,12)")
    rows = spark.createDataFrame([(Decimal(1), Decimal(2))], "a decimal(37,12), b decimal(37,12)")
    exact = mul12(a, b), mul_down(a, b), div_half_up(a, seven), div_down(a, seven)
    out = rows.select(*[x.alias(f"x{i}") for i, x in enumerate(exact)])
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    table(spark, "/root/testdata/sf0.001", "events")
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_products_and_quotients_where_the_ways_meet(spark):
    edges = [Decimal(10) ** k + d for k in (0, 5, 7, 11, 12, 18) for d in (-UNIT, Decimal(0), UNIT)] + [UNIT * 5, Decimal("0.5"), UNIT]
    rows = [(x * s, y) for x in edges for y in edges for s in (1, -1)]
    a, b = F.col("a"), F.col("b")
    out = spark.createDataFrame(rows, "a decimal(37,12), b decimal(37,12)").select(
        a, b, mul12(a, b).alias("m"), mul_down(a, b).alias("md"), div_half_up(a, b).alias("q"), div_down(a, b).alias("qd")
    )
    for x in out.collect():
        assert (x.m, x.md) == tuple(fits((x.a * x.b).quantize(UNIT, mode)) for mode in (ROUND_HALF_UP, ROUND_DOWN)), x
        assert (x.q, x.qd) == tuple(fits((x.a / x.b).quantize(UNIT, mode)) for mode in (ROUND_HALF_UP, ROUND_DOWN)), x
