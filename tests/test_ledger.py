import random
from decimal import Decimal as D

import pytest

from pyspark.sql import functions as F

from tidemark.operators import account as acc
from tidemark.operators import orders as od
from tidemark.operators import reconcile as rec
from tidemark.operators.ledger import execution_metrics, managed_quantity, weighted_positions

FILLED = "symbol string, n int, side string, executed_volume decimal(38,12), avg_executed_price double, fee_amount double"


def metrics(spark, rows, **kw):
    df = spark.createDataFrame([("A", i, s, D(q), p, f) for i, (s, q, p, f) in enumerate(rows)], FILLED)
    return execution_metrics(df, ["symbol"], ["n"], **kw).first()


def test_split_sell_is_one_trade(spark):
    m = metrics(spark, [("BUY", "1", 100.0, 0.0), ("SELL", "0.4", 120.0, 0.0), ("SELL", "0.6", 110.0, 0.0)])
    assert (m["trade_count"], m["win_rate_pct"], m["max_drawdown_pct"]) == (1, 100.0, 0.0)
    for c in ("realized_pnl", "realized_return_pct", "avg_win_pct", "expectancy_pct"):
        assert m[c] == pytest.approx(14.0, abs=1e-9)
    assert m["avg_loss_pct"] is None and m["rr_ratio"] is None


def test_win_and_loss(spark):
    rows = [("BUY", "1", 100.0, 0.0), ("SELL", "1", 110.0, 0.0), ("BUY", "1", 100.0, 0.0), ("SELL", "1", 90.0, 0.0)]
    m = metrics(spark, rows)
    assert m["trade_count"] == 2 and m["realized_pnl"] == pytest.approx(0.0, abs=1e-9)
    want = {"win_rate_pct": 50, "avg_win_pct": 10, "avg_loss_pct": 10, "rr_ratio": 1, "expectancy_pct": 0, "max_drawdown_pct": -10}
    for c, v in want.items():
        assert m[c] == pytest.approx(v, abs=1e-9)


def test_open_position_only(spark):
    m = metrics(spark, [("BUY", "1", 100.0, 0.0)])
    assert m["trade_count"] == 0 and m["realized_pnl"] == 0.0
    assert all(m[c] is None for c in ("realized_return_pct", "win_rate_pct", "expectancy_pct", "max_drawdown_pct"))


def test_capped_sell_shares_its_fee_and_bad_rows_are_skipped(spark):
    rows = [("BUY", "1", 100.0, 1.0), ("SELL", "4", 120.0, 2.0), ("SELL", "1", 90.0, 0.0), (None, "1", 5.0, 0.0), ("BUY", "0", 5.0, 0.0)]
    m = metrics(spark, rows)
    assert m["realized_pnl"] == pytest.approx(120 - 0.5 - 101)
    assert m["trade_count"] == 1


def ledger_steps(rows):
    """Plain fold: held, average price incl. fee, profit and cost, trades."""
    held = basis = pnl = cost = 0.0
    qty, avg, trip, rets = 0.0, 0.0, [0.0, 0.0], []
    for side, q, p, f in rows:
        if side == "BUY":
            basis += p * q + f
            held += q
            avg = (avg * qty + p * q) / (qty + q)
            qty += q
        else:
            s = min(held, q)
            if s > 0:
                part = basis * s / held
                gain = p * s - f * s / q - part
                pnl, cost, trip = pnl + gain, cost + part, [trip[0] + gain, trip[1] + part]
                basis, held = basis - part, held - s
                if held == 0:
                    rets.append(trip[0] / trip[1] * 100)
                    basis, trip = 0.0, [0.0, 0.0]
            qty = max(0.0, qty - q)
            avg = avg if qty > 0 else 0.0
    return held, pnl, cost, rets, qty, avg


@pytest.mark.parametrize("rows_per_task,block", [(None, 4096), (300, 7)])
def test_random_ledgers_one_of_them_hot(spark, monkeypatch, rows_per_task, block):
    monkeypatch.setattr("tidemark.operators.ledger.BLOCK", block)
    rng = random.Random(11)
    sides = {"hot": 1200, "B": 60, "C": 5}
    data = {
        k: [(rng.choice(["BUY", "BUY", "SELL"] if k == "B" else ["BUY", "SELL"]), float(rng.randint(1, 9)), rng.uniform(50, 150), rng.random()) for _ in range(n)]
        for k, n in sides.items()
    }
    rows = [(k, i, s, D(int(q)), p, f) for k, rs in data.items() for i, (s, q, p, f) in enumerate(rs)]
    df = spark.createDataFrame(rows, FILLED).repartition(5)
    got = {r["symbol"]: r for r in execution_metrics(df, ["symbol"], ["n"], rows_per_task).collect()}
    held = {r["symbol"]: r["managed_qty"] for r in managed_quantity(df, ["symbol"], ["n"], rows_per_task).collect()}
    moves = df.withColumnsRenamed({"executed_volume": "qty", "avg_executed_price": "price"})
    pos = {r["symbol"]: r for r in weighted_positions(moves, ["symbol"], ["n"], rows_per_task).collect()}
    for k, rs in data.items():
        h, pnl, cost, rets, qty, avg = ledger_steps(rs)
        assert float(held[k]) == h and float(pos[k]["qty"]) == qty
        assert float(pos[k]["avg_price"]) == pytest.approx(avg, abs=1e-9)
        assert pos[k]["state"] == ("LONG" if qty > 0 else "FLAT")
        assert got[k]["realized_pnl"] == pytest.approx(pnl, abs=1e-7)
        assert got[k]["trade_count"] == len(rets)
        if rets:
            assert got[k]["expectancy_pct"] == pytest.approx(sum(rets) / len(rets), abs=1e-9)
    assert got["hot"]["trade_count"] > 20


def test_managed_quantity_keeps_the_last_decimal(spark):
    rows = [("A", 1, "BUY", D("0.300000000001"), 1.0, 0.0), ("A", 2, "SELL", D("0.200000000000"), 1.0, 0.0)]
    out = managed_quantity(spark.createDataFrame(rows, FILLED), ["symbol"], ["n"]).first()
    assert out["managed_qty"] == D("0.100000000001")


def snapshots(spark, polls, side="BUY"):
    trade = "struct<market:string,uuid:string,price:string,volume:string,funds:string,side:string,created_at:string>"
    rows = []
    for i, (volume, state, trades) in enumerate(polls):
        ts = [("M", u, p, v, f, "bid", at) for u, p, v, f, at in trades]
        rows.append(("o1", i, "A", side, "x", state, volume, "100", "0.1", ts))
    schema = f"order_id string, seq int, symbol string, order_side string, uuid string, state string, executed_volume string, price string, paid_fee string, trades array<{trade}>"
    return spark.createDataFrame(rows, schema)


AT = "2026-01-02T03:04:05+09:00"


def test_repeated_poll_moves_the_position_once(spark):
    t1 = ("t1", "100", "1.0", "100", AT)
    t2 = ("t2", "110", "1.0", "110", AT)
    s = snapshots(spark, [("1.0", "wait", [t1]), ("2.0", "DONE", [t1, t2]), ("2.0", "done", [t1, t2])])
    out = rec.reconcile(s).orderBy("seq").collect()
    assert [r["delta_qty"] for r in out] == [D("1"), D("1"), None]
    assert [r["delta_price"] for r in out] == [D("100"), D("110"), None]
    assert [r["status"] for r in out] == ["PARTIALLY_FILLED", "FILLED", "FILLED"]
    assert out[2]["avg_executed_price"] == D("105")
    assert rec.first_fills(rec.explode_trades(s)).count() == 2


def test_trade_keys_fall_back(spark):
    s = snapshots(spark, [("2", "cancel", [("", "100", "1", "0", ""), (None, "90", "1", None, "soon"), ("a", "1", "1", "1", "2026-01-02T00:00:00")])])
    out = rec.explode_trades(s).orderBy("pos").collect()
    assert [r["trade_id"] for r in out] == ["o1::100:1:0", "o1:soon:90:1:1", "a"]
    assert all(str(r["filled_at"]) == "1970-01-01 00:00:00" for r in out)
    assert [r["funds"] for r in out] == [D(100), D(90), D(1)]
    assert rec.reconcile(s).first()["status"] == "CANCELED"


def test_no_trades_take_the_order_price(spark):
    out = rec.reconcile(snapshots(spark, [("1", "wait", []), ("0.5", "wait", [])])).orderBy("seq").collect()
    assert out[0]["delta_price"] == D(100) and out[1]["delta_qty"] is None and out[1]["executed_volume"] == D("0.5")


def test_position_sync_and_drift(spark):
    accounts = spark.createDataFrame(
        [("btc", "0.1", "0.02", "50000000", "KRW", 1), ("BTC", "9", "9", "9", "KRW", 2), ("ETH", "x", None, "1", "KRW", 3)],
        "currency string, balance string, locked string, avg_buy_price string, unit_currency string, seq int",
    )
    markets = spark.createDataFrame([("KRW-BTC",), ("KRW-ETH",), ("KRW-XRP",), ("BAD",)], "market string")
    got = {r["symbol"]: r for r in acc.sync_positions(markets, accounts).collect()}
    assert set(got) == {"KRW-BTC", "KRW-ETH", "KRW-XRP"}
    assert (got["KRW-BTC"]["qty"], got["KRW-BTC"]["state"]) == (D("0.12"), "LONG")
    assert got["KRW-ETH"]["state"] == got["KRW-XRP"]["state"] == "FLAT"
    assert acc.sync_positions(markets, accounts, "PAPER").count() == 0
    managed = spark.createDataFrame([("KRW-BTC", D("0.10"))], "symbol string, managed_qty decimal(38,12)")
    d = {r["symbol"]: r for r in acc.drift_snapshots(acc.sync_positions(markets, accounts), managed).collect()}
    assert (d["KRW-BTC"]["drift_qty"], d["KRW-BTC"]["external_qty"]) == (D("0.02"), D("0.02"))
    assert d["KRW-BTC"]["drift_detected"] and not d["KRW-XRP"]["drift_detected"]


def test_request_rules(spark):
    rows = [
        ("M", "BUY", "MARKET_SELL", "LIVE", None, None, "buy_with_market_sell"),
        ("M", "SELL", "LIMIT", "LIVE", D(1), None, "limit_needs_quantity_and_price"),
        ("M", "BUY", "MARKET_BUY", "LIVE", None, None, None),
        ("M", "BUY", "MARKET_BUY", "PAPER", D(1), None, "paper_buy_needs_notional"),
        ("M", "SELL", "MARKET_SELL", "LIVE", D(1), None, None),
        ("M", "SELL", "MARKET_SELL", "PAPER", D(1), None, "paper_sell_needs_price"),
        (" ", "SELL", "MARKET_SELL", "PAPER", D(1), None, "market_blank"),
        ("M", "BUY", "MARKET_BUY", "LIVE", None, D(-1), "price_not_positive"),
        ("M", "BUY", "ICEBERG", "LIVE", None, None, "unsupported_type"),
    ]
    schema = "market string, side string, order_type string, mode string, quantity decimal(24,12), price decimal(24,12), want string"
    df = spark.createDataFrame(rows, schema).withColumn("got", od.request_error())
    assert df.where(~F.col("got").eqNullSafe(F.col("want"))).count() == 0


def test_paper_amounts(spark):
    rows = [("MARKET_BUY", D(3), D(100), D(100)), ("LIMIT", None, D(3), D(10))]
    df = spark.createDataFrame(rows, "order_type string, quantity decimal(24,12), price decimal(24,12), requested_notional decimal(38,12)")
    got = od.paper_fill(df, "0.001").collect()
    assert got[0]["avg_executed_price"] == D("33.333333333333") and got[0]["executed_volume"] == D(3)
    assert got[1]["executed_volume"] == D("3.333333333333")
    one = spark.range(1).select(od.spendable(F.lit("1000.99").cast("decimal(24,12)"), "0.1").alias("a"), od.spendable(F.lit(5), "1.5").alias("b")).first()
    assert (one["a"], one["b"]) == (D(900), D(5))


def test_paper_fills_and_estimates_work_out_amounts_once(spark):
    """An amount is a column of its own before others name it; the budget is worked out on the symbols' side of the join."""
    from tidemark.operators.orders import paper_fill, with_notional_estimate

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    fields = "symbol string, order_type string, quantity decimal(37,12), price decimal(37,12), requested_notional decimal(37,12)"
    orders = spark.read.schema(fields).json(spark.sparkContext.emptyRDD())
    assert plan(paper_fill(orders, "0.0005")).count("Project") >= 3
    chances = spark.range(1).selectExpr("string(id) AS symbol", "cast(rand() AS decimal(37,12)) AS bid_balance", "cast(rand() AS decimal(37,12)) AS ask_avg_buy_price")
    ticks = spark.range(1).selectExpr("string(id) AS symbol", "rand() AS last_price")
    out = plan(with_notional_estimate(orders, chances, ticks, "0.0005"))
    assert "_budget" in out[out.index("Join"):]


def test_amounts_of_a_snapshot_are_added_up_once(spark):
    """Each of the two sums over the trades is in the plan once."""
    from tidemark.operators.reconcile import average_price

    rows = spark.createDataFrame([("1", [("2", "1")])], "price string, trades array<struct<volume:string,funds:string>>")
    tree = average_price().alias("a")
    assert rows.select(tree).schema[0].dataType.simpleString() == "decimal(38,12)"
    plan = rows.repartition(2).select(tree)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(trades") == 2
