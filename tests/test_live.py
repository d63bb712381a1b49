import datetime as dt

import pytest

from tidemark.operators.account import guard
from tidemark.plans.live import LiveParams, diagnostic_rows, diagnostic_schema, diagnostic_text, diagnostics, live_signals
from tidemark.sources.sinks import event_rows, event_text

SCHEMA = "market string, ts timestamp, open double, high double, low double, close double, volume double"


def candles(spark, closes, market="M"):
    start = dt.datetime(2026, 1, 1)
    rows = [(market, start + dt.timedelta(days=i), c, c + 1.0, c - 1.0, float(c), 1.0) for i, c in enumerate(map(float, closes))]
    return spark.createDataFrame(rows, SCHEMA)


def positions(spark, qty, since=dt.datetime(2026, 1, 1), market="M"):
    return spark.createDataFrame([(market, qty, 100.0, since)], "symbol string, qty double, avg_price double, updated_at timestamp")


SMALL = LiveParams(2, 1, 2.0, 3.0, 2, 0.7, 0.0)
STOP = LiveParams(2, 3, 1.0, 1.0, 3, 0.99, 0.15)


def one(spark, closes, params, qty, **kw):
    return live_signals(candles(spark, closes), positions(spark, qty, **kw), params, closed_only=False).first()


def test_buy_transition(spark):
    s = one(spark, [100, 90, 110], SMALL, 0.0)
    assert s["buy_signal"] and not s["sell_signal"] and s["signal_reason"] == "BUY_REGIME_TRANSITION"


def test_sell_transition(spark):
    s = one(spark, [100, 120, 90], SMALL, 1.0)
    assert s["sell_signal"] and s["signal_reason"] in ("SELL_REGIME_TRANSITION", "SELL_REGIME_AND_TRAIL_STOP")
    calm = LiveParams(2, 1, 0.0, 0.0, 2, 0.7, 0.0)
    assert one(spark, [100, 120, 90], calm, 1.0)["signal_reason"] == "SELL_REGIME_TRANSITION"


def test_trail_stop(spark):
    s = one(spark, [100, 101, 102, 120, 110], STOP, 1.0)
    assert s["signal_reason"] == "SELL_TRAIL_STOP" and s["trail_stop"] >= 110
    late = one(spark, [100, 101, 102, 120, 110], STOP, 1.0, since=dt.datetime(2026, 3, 1))
    assert late["trail_stop"] == pytest.approx(110 - (120 - s["trail_stop"]))
    assert one(spark, [100, 101, 102, 120, 110], STOP, 1.0, since=None)["trail_stop"] == pytest.approx(s["trail_stop"])


def test_warmup_and_bounds():
    assert LiveParams(2, 1, 2.0, 3.0, 2, 0.7, 0.0).warmup == 2
    with pytest.raises(ValueError):
        LiveParams(vol_regime_threshold=1.2)


def test_short_and_blocked_markets_give_no_row(spark):
    assert live_signals(candles(spark, [100, 90]), positions(spark, 0.0), SMALL).count() == 0
    none = spark.createDataFrame([("OTHER",)], "market string")
    assert live_signals(candles(spark, [100, 90, 110, 95]), positions(spark, 0.0), SMALL, allowed=none).count() == 0


def test_diagnostics_and_event_text(spark):
    s = live_signals(candles(spark, [100, 90, 110]), positions(spark, 0.0), SMALL, closed_only=False)
    text = s.select(diagnostic_text(diagnostics()).alias("t"), diagnostic_schema(diagnostics()).alias("s")).first()
    assert text["t"].startswith("{atr.trail_stop=0.0, regime.anchor=") and "regime.upper=" in text["t"]
    assert text["s"].startswith('{atr.trail_stop:{label="ATR Trail Stop"}, ')
    rows = diagnostic_rows(s)
    assert rows.count() == 4 and event_rows(rows, "strategy_diagnostic").where("value IS NULL").count() == 0
    line = event_text(rows.where("key = 'regime.anchor'"), "strategy_diagnostic").first()["value"]
    assert line.startswith('event=strategy_diagnostic market=M strategy_version=v5 ts=2026-01-03') and 'label="Regime Anchor"' in line


def test_guard_order(spark):
    markets = spark.createDataFrame([(m,) for m in "ABCDE"], "market string")
    orders = spark.createDataFrame([("A", "LIVE", "SUBMITTED"), ("B", "LIVE", "FILLED"), ("C", "PAPER", "CREATED")], "symbol string, mode string, status string")
    waiting = spark.createDataFrame([("A",), ("B",), ("B",), ("D",)], "market string")
    feed = spark.createDataFrame([("A", True), ("B", True), ("C", True), ("D", False)], "market string, feed_ok boolean")
    got = {r["market"]: r for r in guard(markets, orders, "LIVE", waiting, feed).collect()}
    assert {m: r["reason"] for m, r in got.items()} == {
        "A": "LOCAL_ACTIVE_ORDER", "B": "EXTERNAL_OPEN_ORDER", "C": "NONE", "D": "GUARD_QUERY_FAILED", "E": "GUARD_QUERY_FAILED",
    }
    assert got["B"]["external_open_order_count"] == 2 and got["A"]["external_open_order_count"] == 0
    paper = {r["market"]: r["reason"] for r in guard(markets, orders, "PAPER").collect()}
    assert paper["C"] == "LOCAL_ACTIVE_ORDER" and paper["D"] == "NONE"
