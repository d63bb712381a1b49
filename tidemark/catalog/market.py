"""Queries over candles: sources, indicators, regimes, live signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import CANDLES, candles, day, ema_cte, query, r, stamp, table
from tidemark.functions.scalar import partition_name
from tidemark.operators import indicators as ind
from tidemark.operators.orders import live_price
from tidemark.operators.positions import open_return
from tidemark.plans.experiment import holdout_segments, panel, slice_segments, walkforward_segments
from tidemark.plans.live import LiveParams, diagnostic_rows, diagnostic_schema, diagnostic_text, diagnostics, live_signals
from tidemark.sources.candles import between, candles_from_trades, dedup_candles, from_raw, latest, signal_rows
from tidemark.sources.sinks import event_rows

def rd(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 AS {name}"


def ohlc():
    return [r(c).alias(c) for c in ("open", "high", "low", "close")]


OHLC_SQL = ", ".join(rd(c, c) for c in ("open", "high", "low", "close"))
DAY = "strftime(ts, '%Y-%m-%d') AS day"


@query("daily_candles", f"WITH {CANDLES} SELECT market, {DAY}, {OHLC_SQL}, volume FROM candles")
def daily_candles(spark, sf):
    return candles(spark, sf).select("market", day().alias("day"), *ohlc(), "volume")


@query(
    "hourly_tick_candles",
    f"""SELECT event_type AS market, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS ts,
    {rd('arg_min(100 + value / 10, event_id)', 'open')}, {rd('max(100 + value / 10)', 'high')},
    {rd('min(100 + value / 10)', 'low')}, {rd('arg_max(100 + value / 10, event_id)', 'close')},
    CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2""",
)
def hourly_tick_candles(spark, sf):
    e = table(spark, sf, "events")
    c = candles_from_trades(e, "event_type", "ts", 100 + F.col("value") / 10, "event_id", "hour")
    return c.select("market", stamp().alias("ts"), *ohlc(), "volume")


RAW_SQL = """
raw AS (
  SELECT event_type AS market, event_id,
    CASE WHEN event_id % 13 = 0 THEN 'not a time' WHEN event_id % 2 = 0 THEN strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%SZ')
         ELSE strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S') END AS text_ts, date_trunc('hour', ts) AS ts,
    100 + value AS open, CASE WHEN event_id % 17 <> 0 THEN 101 + value END AS high, 99 + value AS low, 100.5 + value AS close,
    CASE WHEN event_id % 5 <> 0 THEN value END AS volume
  FROM events)"""


def _raw(spark, sf):
    hour = F.date_trunc("hour", F.col("ts"))
    text = F.date_format(hour, "yyyy-MM-dd'T'HH:mm:ss")
    ident, v = F.col("event_id"), F.col("value")
    return table(spark, sf, "events").select(
        F.col("event_type").alias("market"),
        F.when(ident % 13 == 0, "not a time")
        .when(ident % 2 == 0, F.concat(text, F.lit("Z")))
        .otherwise(text)
        .alias("candle_date_time_utc"),
        (100 + v).alias("opening_price"),
        F.when(ident % 17 != 0, 101 + v).alias("high_price"),
        (99 + v).alias("low_price"),
        (100.5 + v).alias("trade_price"),
        F.when(ident % 5 != 0, v).alias("candle_acc_trade_volume"),
        ident.alias("event_id"),
    )


@query(
    "normalized_candles",
    f"""WITH {RAW_SQL} SELECT market, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, {OHLC_SQL},
    round(coalesce(volume, 0), 6) + 0.0 AS volume FROM raw WHERE text_ts <> 'not a time' AND high IS NOT NULL""",
)
def normalized_candles(spark, sf):
    return from_raw(_raw(spark, sf)).select("market", stamp().alias("ts"), *ohlc(), r("volume").alias("volume"))


@query(
    "deduplicated_candles",
    f"""WITH {RAW_SQL} SELECT market, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, {OHLC_SQL}, event_id FROM raw
    WHERE text_ts <> 'not a time' AND high IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY market, ts ORDER BY event_id DESC) = 1""",
)
def deduplicated_candles(spark, sf):
    rows = from_raw(_raw(spark, sf)).withColumn("load_seq", F.col("event_id"))
    return dedup_candles(rows).select("market", stamp().alias("ts"), *ohlc(), "event_id")


@query(
    "candles_in_range",
    f"""WITH {CANDLES} SELECT market, {DAY}, {rd('close', 'close')} FROM candles
    WHERE ts BETWEEN TIMESTAMP '1995-03-01' AND TIMESTAMP '1997-06-30'""",
)
def candles_in_range(spark, sf):
    start, end = "1995-03-01", "1997-06-30"
    rows = between(candles(spark, sf, start, end), start, end)
    return rows.select("market", day().alias("day"), r("close").alias("close"))


@query(
    "candle_partition_names",
    f"""WITH {CANDLES} SELECT market, regexp_replace(market, '[^A-Za-z0-9._-]', '_', 'g') || '_' ||
    strftime(min(ts), '%Y%m%d') || '_' || strftime(max(ts), '%Y%m%d') || '_days' AS part_name, count(*) AS bars
    FROM candles GROUP BY market""",
)
def candle_partition_names(spark, sf):
    spans = candles(spark, sf).groupBy("market").agg(
        F.min("ts").alias("a"), F.max("ts").alias("b"), F.count(F.lit(1)).alias("bars")
    )
    name = partition_name(F.col("market"), F.col("a"), F.col("b"), "days")
    return spans.select("market", name.alias("part_name"), "bars")


@query(
    "latest_candles",
    f"""WITH {CANDLES} SELECT market, {DAY}, {rd('close', 'close')} FROM bars WHERE n - idx <= 122""",
)
def latest_candles(spark, sf):
    return latest(candles(spark, sf), 122).select("market", day().alias("day"), r("close").alias("close"))


@query(
    "signal_candle",
    f"WITH {CANDLES} SELECT market, {DAY}, {rd('close', 'close')} FROM bars WHERE idx = n - 2 AND idx >= 1",
)
def signal_candle(spark, sf):
    return signal_rows(candles(spark, sf)).select("market", day().alias("day"), r("close").alias("close"))


def bars_of(spark, sf):
    return panel(candles(spark, sf))


@query("sma_20", f"""WITH {CANDLES} SELECT market, idx AS bar_idx, CASE WHEN idx >= 19 THEN round(avg(close) OVER
    (PARTITION BY market ORDER BY idx ROWS 19 PRECEDING), 9) + 0.0 END AS ma FROM bars""")
def sma_20(spark, sf):
    bars, s = bars_of(spark, sf)
    return ind.sma(bars, s, 20).select("market", "bar_idx", r("ma", 9).alias("ma"))


@query(
    "ema_10_20",
    f"""WITH RECURSIVE {CANDLES}, {ema_cte('e10', 'bars', 'market', 'close', 10)}, {ema_cte('e20', 'bars', 'market', 'close', 20)}
    SELECT b.market, b.idx AS bar_idx, CAST(10 AS BIGINT) AS ema_len, round(v, 6) + 0.0 AS ema FROM bars b LEFT JOIN e10 USING (market, idx)
    UNION ALL SELECT b.market, b.idx, 20, round(v, 6) + 0.0 FROM bars b LEFT JOIN e20 USING (market, idx)""",
)
def ema_10_20(spark, sf):
    bars, s = bars_of(spark, sf)
    rows, _ = ind.ema(bars, s, [10, 20])
    return rows.select("market", "bar_idx", F.col("ema_len").cast("bigint").alias("ema_len"), r("ema").alias("ema"))


TR = """
tr AS (SELECT market, idx, n, ts, close, CASE WHEN idx = 0 THEN high - low
  ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM bars)"""


@query("true_range", f"WITH {CANDLES}, {TR} SELECT market, idx AS bar_idx, {rd('tr', 'tr')} FROM tr")
def true_range(spark, sf):
    bars, _ = bars_of(spark, sf)
    return bars.select("market", "bar_idx", r(ind.true_range()).alias("tr"))


ATR14 = f"{TR}, {ema_cte('atr', 'tr', 'market', 'tr', 14, '(1.0 / 14)')}"


@query(
    "atr_14",
    f"""WITH RECURSIVE {CANDLES}, {ATR14} SELECT b.market, b.idx AS bar_idx, {rd('v', 'atr')},
    {rd('CASE WHEN b.close > 0 THEN v / b.close END', 'ratio')} FROM bars b LEFT JOIN atr USING (market, idx)""",
)
def atr_14(spark, sf):
    bars, s = bars_of(spark, sf)
    rows = ind.atr(bars, s, 14)
    return rows.select("market", "bar_idx", r("atr").alias("atr"), r(ind.price_ratio()).alias("ratio"))


RSI = f"""
moves AS (SELECT market, idx - 1 AS idx, n - 1 AS n, greatest(close - pc, 0) AS gain, greatest(pc - close, 0) AS loss
  FROM bars WHERE idx > 0),
{ema_cte('g', 'moves', 'market', 'gain', 14, '(1.0 / 14)')}, {ema_cte('l', 'moves', 'market', 'loss', 14, '(1.0 / 14)')},
rsi AS (SELECT g.market, g.idx + 1 AS idx, CASE WHEN l.v <> 0 THEN 100 - 100 / (1 + g.v / l.v) END AS rsi
  FROM g JOIN l USING (market, idx))"""


@query(
    "rsi_14",
    f"""WITH RECURSIVE {CANDLES}, {RSI} SELECT b.market, b.idx AS bar_idx, {rd('rsi', 'rsi')}
    FROM bars b LEFT JOIN rsi USING (market, idx)""",
)
def rsi_14(spark, sf):
    bars, s = bars_of(spark, sf)
    return ind.rsi(bars, s).select("market", "bar_idx", r("rsi").alias("rsi"))


@query(
    "ma_slope",
    f"""WITH {CANDLES}, m AS (SELECT market, idx, CASE WHEN idx >= 19 THEN avg(close) OVER
    (PARTITION BY market ORDER BY idx ROWS 19 PRECEDING) END AS ma FROM bars)
    SELECT market, idx AS bar_idx, coalesce(ma > lag(ma, 3) OVER (PARTITION BY market ORDER BY idx), false) AS slope_ok FROM m""",
)
def ma_slope(spark, sf):
    bars, s = bars_of(spark, sf)
    return ind.rising(ind.sma(bars, s, 20), s, 3).select("market", "bar_idx", "slope_ok")


RANK = """
ratio AS (SELECT b.market, b.idx, atr.v / b.close AS x FROM bars b JOIN atr USING (market, idx)),
ranked AS (SELECT a.market, a.idx, count(*) FILTER (c.x <= a.x) * 1.0 / count(*) AS rank
  FROM ratio a JOIN ratio c ON c.market = a.market AND c.idx BETWEEN a.idx - 19 AND a.idx GROUP BY 1, 2)"""


@query(
    "volatility_rank",
    f"""WITH RECURSIVE {CANDLES}, {ATR14}, {RANK} SELECT b.market, b.idx AS bar_idx, {rd('rank', 'vol_rank')},
    coalesce(rank >= 0.6, false) AS is_high, CASE WHEN coalesce(rank >= 0.6, false) THEN 3.0::DOUBLE ELSE 2.0::DOUBLE END AS mult
    FROM bars b LEFT JOIN ranked USING (market, idx)""",
)
def volatility_rank(spark, sf):
    bars, s = bars_of(spark, sf)
    rows = ind.atr(bars, s, 14).withColumn("ratio", ind.price_ratio())
    rows = ind.rolling_rank(rows, s, 20)
    high = ind.is_high(F.col("vol_rank"), 0.6)
    return rows.select(
        "market", "bar_idx", r("vol_rank").alias("vol_rank"), high.alias("is_high"), F.when(high, 3.0).otherwise(2.0).alias("mult")
    )


def regime_ctes(band: float, name: str = "reg", anchor: str = "e20") -> str:
    """Recursive regime over the anchor, bar by bar."""
    return f"""
d AS (SELECT b.market, b.idx, b.ts, b.close, a.v AS anchor, a.v * (1 + {band}) AS upper, a.v * (1 - {band}) AS lower
  FROM bars b LEFT JOIN {anchor} a USING (market, idx)),
{name} AS (
  SELECT market, idx, CAST('UNKNOWN' AS VARCHAR) AS regime, CAST(NULL AS VARCHAR) AS prev FROM d WHERE idx = 0
  UNION ALL
  SELECT d.market, d.idx, CASE WHEN d.anchor IS NULL THEN 'UNKNOWN' WHEN d.close > d.upper THEN 'BULL'
    WHEN d.close < d.lower THEN 'BEAR' WHEN p.regime <> 'UNKNOWN' THEN p.regime
    WHEN d.close > d.anchor THEN 'BULL' WHEN d.close < d.anchor THEN 'BEAR' ELSE 'UNKNOWN' END, p.regime
  FROM {name} p JOIN d ON d.market = p.market AND d.idx = p.idx + 1)"""


REG = f"{ema_cte('e20', 'bars', 'market', 'close', 20)}, {regime_ctes(0.01)}"


@query(
    "regime_bands",
    f"""WITH RECURSIVE {CANDLES}, {ema_cte('e20', 'bars', 'market', 'close', 20)}
    SELECT b.market, b.idx AS bar_idx, {rd('v * 1.01', 'upper')}, {rd('v * 0.99', 'lower')}
    FROM bars b LEFT JOIN e20 USING (market, idx)""",
)
def regime_bands(spark, sf):
    bars, s = bars_of(spark, sf)
    rows, _ = ind.ema(bars, s, [20])
    lim = ind.bands(0.01)
    return rows.select("market", "bar_idx", r(lim["upper"]).alias("upper"), r(lim["lower"]).alias("lower"))


def _regimes(spark, sf):
    bars, s = bars_of(spark, sf)
    rows, s = ind.ema(bars, s, [20])
    return ind.regime(rows, s, 0.01)


@query("regime", f"WITH RECURSIVE {CANDLES}, {REG} SELECT market, idx AS bar_idx, regime FROM reg")
def regime(spark, sf):
    return _regimes(spark, sf).select("market", "bar_idx", "regime")


@query(
    "regime_turns",
    f"""WITH RECURSIVE {CANDLES}, {REG} SELECT r.market, r.idx AS bar_idx, {DAY.replace('ts', 'd.ts')},
    prev = 'BEAR' AND regime = 'BULL' AS setup_buy, prev = 'BULL' AND regime = 'BEAR' AS bear_turn
    FROM reg r JOIN d USING (market, idx) WHERE prev IN ('BULL', 'BEAR') AND regime IN ('BULL', 'BEAR') AND prev <> regime""",
)
def regime_turns(spark, sf):
    rows = _regimes(spark, sf).withColumns({"setup_buy": ind.buy_turn(), "bear_turn": ind.bear_turn()})
    turns = rows.where(F.col("setup_buy") | F.col("bear_turn"))
    return turns.select("market", "bar_idx", day().alias("day"), "setup_buy", "bear_turn")


WEEK = f"""
days AS (SELECT market, ts, close, isoyear(ts) AS iso_year, week(ts) AS iso_week FROM candles),
weeks AS (SELECT market, iso_year, iso_week, arg_max(close, ts) AS wc,
  row_number() OVER (PARTITION BY market ORDER BY iso_year, iso_week) - 1 AS idx, count(*) OVER (PARTITION BY market) AS n
  FROM days GROUP BY market, iso_year, iso_week),
{ema_cte('we', 'weeks', 'market', 'wc', 5)}"""


@query(
    "weekly_close",
    f"""WITH {CANDLES}, days AS (SELECT market, ts, close, isoyear(ts) AS iso_year, week(ts) AS iso_week FROM candles)
    SELECT market, iso_year, iso_week, round(arg_max(close, ts), 6) + 0.0 AS weekly_close FROM days GROUP BY 1, 2, 3""",
)
def weekly_close(spark, sf):
    days = candles(spark, sf).withColumns(
        {"iso_year": F.extract(F.lit("YEAROFWEEK"), "ts"), "iso_week": F.extract(F.lit("WEEK"), "ts")}
    )
    out = ind.weekly_panel(days, ["market"])
    return out.select(
        "market", *[F.col(c).cast("bigint").alias(c) for c in ("iso_year", "iso_week")], r("weekly_close").alias("weekly_close")
    )


@query(
    "weekly_trend_filter",
    f"""WITH RECURSIVE {CANDLES}, {WEEK} SELECT d.market, strftime(d.ts, '%Y-%m-%d') AS day, {rd('w.wc', 'weekly_close')},
    {rd('we.v', 'weekly_ema')}, coalesce(w.wc >= we.v, false) AS bullish FROM days d JOIN weeks w USING (market, iso_year, iso_week)
    LEFT JOIN we ON we.market = w.market AND we.idx = w.idx""",
)
def weekly_trend_filter(spark, sf):
    bars, s = bars_of(spark, sf)
    rows = ind.weekly_filter(bars, s, [5])
    flag = F.col("weekly")[0]
    return rows.select(
        "market", day().alias("day"), r("weekly_close").alias("weekly_close"), r(flag["ema"]).alias("weekly_ema"), flag["bullish"].alias("bullish")
    )


@query(
    "open_to_open_returns",
    f"WITH {CANDLES} SELECT market, idx AS bar_idx, round(coalesce(nopen / open - 1, 0), 6) + 0.0 AS ret_oo FROM bars",
)
def open_to_open_returns(spark, sf):
    bars, _ = bars_of(spark, sf)
    return bars.select("market", "bar_idx", r(open_return()).alias("ret_oo"))


@query(
    "holdout_segments",
    f"""WITH {CANDLES}, c AS (SELECT market, n, ts, idx, least(n - 2, greatest(2, CAST(floor(n * 0.7) AS BIGINT))) AS cut FROM bars),
    s AS (SELECT market, CASE WHEN idx < cut THEN 'validation' ELSE 'test' END AS segment, ts FROM c
          UNION ALL SELECT market, 'full', ts FROM c)
    SELECT market, segment, count(*) AS bars, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day
    FROM s GROUP BY 1, 2""",
)
def holdout_segments_query(spark, sf):
    return _segment_spans(spark, sf, holdout_segments(0.7))


def _segment_spans(spark, sf, segments):
    bars, s = bars_of(spark, sf)
    seg, _ = slice_segments(bars, s, segments)
    out = seg.groupBy("market", "segment").agg(F.count(F.lit(1)).alias("bars"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return out.select("market", "segment", "bars", day("a").alias("first_day"), day("b").alias("last_day"))


@query(
    "walkforward_segments",
    f"""WITH {CANDLES}, c AS (SELECT market, n, ts, idx, greatest(50, n // 4) AS size, i FROM bars, range(1, 4) t(i)),
    ok AS (SELECT * FROM c WHERE size * i >= 300 AND least(n, size * (i + 1)) - size * i >= 30),
    s AS (SELECT market, 'train_' || i AS segment, ts FROM ok WHERE idx < size * i
          UNION ALL SELECT market, 'test_' || i, ts FROM ok WHERE idx >= size * i AND idx < least(n, size * (i + 1)))
    SELECT market, segment, count(*) AS bars, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day
    FROM s GROUP BY 1, 2""",
)
def walkforward_segments_query(spark, sf):
    return _segment_spans(spark, sf, walkforward_segments(3))


LIVE = LiveParams(20, 14, 2.0, 3.0, 20, 0.6, 0.01)
POSITIONS_SQL = """
positions AS (
  SELECT market AS symbol, CASE WHEN market IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 1.5 ELSE 0 END AS qty,
    arg_max(close, ts) * 0.95 AS avg_price, CASE WHEN market <> '2-HIGH' THEN max(ts) - INTERVAL 40 DAY END AS updated_at
  FROM candles GROUP BY market)"""


def live_positions(spark, sf):
    """Three held and two flat markets, one without an entry date."""
    held = F.col("market").isin("1-URGENT", "2-HIGH", "3-MEDIUM")
    return candles(spark, sf).groupBy("market").agg(F.max_by("close", "ts").alias("c"), F.max("ts").alias("t")).select(
        F.col("market").alias("symbol"),
        F.when(held, 1.5).otherwise(0.0).alias("qty"),
        (F.col("c") * 0.95).alias("avg_price"),
        F.when(F.col("market") != "2-HIGH", F.col("t") - F.expr("INTERVAL 40 DAYS")).alias("updated_at"),
    )


LIVE_SQL = f"""WITH RECURSIVE {CANDLES.replace('bars AS', 'allbars AS')},
bars AS (SELECT market, ts, open, high, low, close, idx - greatest(0, n - 400) AS idx, least(n, 400) AS n,
  CASE WHEN idx > greatest(0, n - 400) THEN pc END AS pc, nopen FROM allbars WHERE idx >= n - 400),
{POSITIONS_SQL}, {REG}, {ATR14}, {RANK},
sig AS (
  SELECT b.market, b.ts, b.close, d.anchor, d.upper, d.lower, atr.v AS atr, coalesce(k.rank >= 0.6, false) AS hv, r.regime, r.prev,
    coalesce(p.qty > 0, false) AS has, p.qty, p.avg_price, (SELECT max(h.close) FROM bars h WHERE h.market = b.market
      AND h.idx <= b.idx AND (p.updated_at IS NULL OR CAST(h.ts AS DATE) >= CAST(p.updated_at AS DATE))) AS high
  FROM bars b JOIN d USING (market, idx) JOIN reg r USING (market, idx) LEFT JOIN atr USING (market, idx)
  LEFT JOIN ranked k USING (market, idx) LEFT JOIN positions p ON p.symbol = b.market WHERE b.idx = b.n - 2 AND b.idx >= 1),
st AS (SELECT *, CASE WHEN has THEN coalesce(high, close) - CASE WHEN hv THEN 3 ELSE 2 END * atr END AS stop,
  prev = 'BEAR' AND regime = 'BULL' AS bb, has AND prev = 'BULL' AND regime = 'BEAR' AS bs FROM sig),
fin AS (SELECT *, coalesce(close <= stop, false) AS hit FROM st),
sgn AS (SELECT *, NOT has AND bb AS buy_signal, has AND (bs OR hit) AS sell_signal FROM fin),
signals AS (SELECT *, CASE WHEN buy_signal THEN 'BUY_REGIME_TRANSITION' WHEN sell_signal AND bs AND hit THEN 'SELL_REGIME_AND_TRAIL_STOP'
  WHEN sell_signal AND hit THEN 'SELL_TRAIL_STOP' WHEN sell_signal THEN 'SELL_REGIME_TRANSITION' WHEN bb THEN 'SETUP_BUY'
  WHEN bs THEN 'SETUP_SELL' ELSE 'NONE' END AS signal_reason FROM sgn)"""


def live(spark, sf):
    return live_signals(candles(spark, sf), live_positions(spark, sf), LIVE)


@query(
    "live_signals",
    f"""{LIVE_SQL} SELECT market, {DAY}, {rd('close', 'close')}, {rd('stop', 'trail_stop')}, has AS has_position,
    buy_signal, sell_signal, signal_reason FROM signals""",
)
def live_signals_query(spark, sf):
    return live(spark, sf).select(
        "market", day("signal_ts").alias("day"), r("close").alias("close"), r("trail_stop").alias("trail_stop"),
        "has_position", "buy_signal", "sell_signal", "signal_reason",
    )


@query(
    "signal_diagnostics",
    f"""{LIVE_SQL} SELECT 'strategy_diagnostic' AS event, market, 'v5' AS strategy_version, key, label,
    round(coalesce(value, 0), 6) + 0.0 AS value, buy_signal, sell_signal, signal_reason FROM (
    SELECT *, unnest(['regime.anchor', 'regime.upper', 'regime.lower', 'atr.trail_stop']) AS key,
      unnest(['Regime Anchor', 'Regime Upper Band', 'Regime Lower Band', 'ATR Trail Stop']) AS label,
      unnest([anchor, upper, lower, stop]) AS value FROM signals)""",
)
def signal_diagnostics(spark, sf):
    rows = event_rows(diagnostic_rows(live(spark, sf)), "strategy_diagnostic")
    return rows.drop("ts").withColumn("value", r("value"))


_VALUE = "CAST(round(coalesce({0}, 0), 4) + 0.0 AS VARCHAR)"
DIAGNOSTIC_SQL = " || ".join(
    f"'{start}{key}=' || {_VALUE.format(value)}"
    for start, key, value in (
        ("{", "atr.trail_stop", "stop"), (", ", "regime.anchor", "anchor"), (", ", "regime.lower", "lower"), (", ", "regime.upper", "upper"),
    )
) + " || '}'"
SCHEMA_SQL = (
    """'{atr.trail_stop:{label="ATR Trail Stop"}, regime.anchor:{label="Regime Anchor"}, regime.lower:{label="Regime Lower Band"}, """
    """regime.upper:{label="Regime Upper Band"}}'"""
)


@query("diagnostic_text", f"{LIVE_SQL} SELECT market, {DIAGNOSTIC_SQL} AS diagnostics, {SCHEMA_SQL} AS diagnostics_schema FROM signals")
def diagnostic_text_query(spark, sf):
    cells = diagnostics(4)
    return live(spark, sf).select(
        "market", diagnostic_text(cells).alias("diagnostics"), diagnostic_schema(cells).alias("diagnostics_schema")
    )


@query(
    "live_prices",
    f"""WITH {CANDLES}, tick AS (SELECT market, CASE market WHEN '1-URGENT' THEN 0.0 WHEN '2-HIGH' THEN NULL ELSE arg_max(close, ts) + 1 END AS p
    FROM candles GROUP BY market)
    SELECT b.market, round(CASE WHEN t.p > 0 THEN t.p WHEN b.close > 0 THEN b.close END, 6) + 0.0 AS live_price
    FROM bars b JOIN tick t USING (market) WHERE b.idx = b.n - 2""",
)
def live_prices(spark, sf):
    c = candles(spark, sf)
    tick = c.groupBy("market").agg(
        F.when(F.first("market") == "1-URGENT", 0.0)
        .when(F.first("market") != "2-HIGH", F.max_by("close", "ts") + 1)
        .alias("trade_price")
    )
    rows = signal_rows(c).join(tick, "market", "left")
    return rows.select("market", r(live_price(F.col("trade_price"), F.col("close"))).alias("live_price"))
