"""Plain bar-by-bar evaluation of the strategy rules, used only to check the window forms."""

from __future__ import annotations

import datetime as dt
import math
import random


def walk(seed: int, n: int, step: float = 0.03) -> list[dict]:
    rng = random.Random(seed)
    price, rows = 100.0, []
    for i in range(n):
        start = price
        price = max(1.0, price * math.exp(rng.gauss(0.0005, step) + 0.01 * math.sin(i / 17 + seed)))
        hi = max(start, price) * (1 + abs(rng.gauss(0, step / 3)))
        lo = min(start, price) * (1 - abs(rng.gauss(0, step / 3)))
        ts = dt.datetime(2020, 1, 1) + dt.timedelta(days=i)
        rows.append({"ts": ts, "open": start, "high": hi, "low": lo, "close": price, "volume": 1.0 + i})
    return rows


def smooth(xs, alpha, seed_len):
    """Seeded recurrence; None before it is defined."""
    out, state = [], None
    for i, x in enumerate(xs):
        if i == seed_len - 1:
            state = sum(xs[:seed_len]) / seed_len
        elif i >= seed_len:
            state = alpha * x + (1 - alpha) * state
        out.append(state)
    return out


def ranges(rows):
    out = []
    for i, r in enumerate(rows):
        spread = [r["high"] - r["low"]]
        if i:
            last = rows[i - 1]["close"]
            spread += [abs(r["high"] - last), abs(r["low"] - last)]
        out.append(max(spread))
    return out


def rsi14(closes):
    ups = [max(0.0, b - a) for a, b in zip(closes, closes[1:])]
    downs = [max(0.0, a - b) for a, b in zip(closes, closes[1:])]
    up, down = smooth(ups, 1 / 14, 14), smooth(downs, 1 / 14, 14)
    vals = [None if d in (None, 0.0) else 100 - 100 / (1 + u / d) for u, d in zip(up, down)]
    return [None] + vals


def regimes(closes, anchors, band):
    state, out = "UNKNOWN", []
    for c, a in zip(closes, anchors):
        if a is None:
            state = "UNKNOWN"
        elif c > a * (1.0 + band):
            state = "BULL"
        elif c < a * (1.0 - band):
            state = "BEAR"
        elif state == "UNKNOWN" and c != a:
            state = "BULL" if c > a else "BEAR"
        out.append(state)
    return out


def rank(ratios, lookback):
    out = []
    for i, x in enumerate(ratios):
        seen = [v for v in ratios[max(0, i - lookback + 1) : i + 1] if v is not None]
        out.append(None if x is None else sum(v <= x for v in seen) / len(seen))
    return out


def exposures(version, rows, p):
    """Exposure at each bar's open."""
    closes = [r["close"] for r in rows]
    if version == "v1":
        ma = [None if i < p["ma_len"] - 1 else sum(closes[i - p["ma_len"] + 1 : i + 1]) / p["ma_len"] for i in range(len(rows))]
        rs, at_open, now = rsi14(closes), [], 0.0
        for i, c in enumerate(closes):
            at_open.append(now)
            back = i - p["ma_slope_days"]
            up = back >= 0 and ma[i] is not None and ma[back] is not None and ma[i] > ma[back]
            if ma[i] is None or rs[i] is None or c < ma[i]:
                now = 0.0
            elif c > ma[i] and up and rs[i] < p["rsi_buy"]:
                now = 1.0
        return at_open
    anchor = smooth(closes, 2 / (p["regime_ema_len"] + 1), p["regime_ema_len"])
    reg = regimes(closes, anchor, p["regime_band"])
    atr = smooth(ranges(rows), 1 / p["atr_period"], p["atr_period"])
    ratio = [None if a is None else a / c for a, c in zip(atr, closes)]
    if version == "v5":
        rk = rank(ratio, p["vol_regime_lookback"])
        mult = [
            p["atr_mult_high_vol"] if r is not None and r >= p["vol_regime_threshold"] else p["atr_mult_low_vol"]
            for r in rk
        ]
    else:
        mult = [p["atr_trail_multiplier"]] * len(rows)
    allowed = [True] * len(rows)
    if version == "v4":
        weeks = [r["ts"].isocalendar()[:2] for r in rows]
        names = sorted(set(weeks))
        last = {w: c for w, c in zip(weeks, closes)}
        wk = smooth([last[w] for w in names], 2 / (p["weekly_ema_len"] + 1), p["weekly_ema_len"])
        good = {w: e is not None and last[w] >= e for w, e in zip(names, wk)}
        allowed = [good[w] for w in weeks]
    at_open, now, before, high = [], 0.0, 0.0, None
    for i, c in enumerate(closes):
        at_open.append(now)
        if now > before:
            high = c
        elif now > 0:
            high = max(high, c)
        stopped = now > 0 and mult[i] > 0 and atr[i] is not None and c <= high - mult[i] * atr[i]
        buy = i > 0 and reg[i - 1] == "BEAR" and reg[i] == "BULL" and allowed[i]
        sell = i > 0 and now > 0 and reg[i - 1] == "BULL" and reg[i] == "BEAR"
        before, held = now, now
        if version == "v3":
            floor = p["min_exposure"] or 0.0
            want = floor
            if ratio[i] is not None and ratio[i] > 0:
                want = max(floor, min(p["max_leverage"], p["vol_target"] / ratio[i]))
            now = want if reg[i] == "BULL" and not stopped and not sell and (buy or held > 0) else 0.0
        elif stopped or sell:
            now = 0.0
        elif buy:
            now = 1.0
    return at_open


def curve(version, rows, at_open, cost):
    opens = [r["open"] for r in rows]
    ret = [b / a - 1 for a, b in zip(opens, opens[1:])] + [0.0]
    eq, bh = [1.0], [1 - cost if version == "v1" else max(1e-12, 1 - cost)]
    for i in range(1, len(rows)):
        growth = 1 + at_open[i] * ret[i] - abs(at_open[i] - at_open[i - 1]) * cost
        eq.append(max(1e-12, eq[-1] * growth) if growth > 0 else 1e-12)
        hold = 1 + ret[i]
        bh.append(max(1e-12, bh[-1] * hold) if hold > 0 else 1e-12)
    return eq, bh


def summary(version, rows, p, cost=0.0007):
    at_open = exposures(version, rows, p)
    eq, bh = curve(version, rows, at_open, cost)
    peak, mdd = eq[0], 0.0
    for v in eq:
        peak = max(peak, v)
        mdd = min(mdd, v / peak - 1)
    moves = [abs(at_open[0])] + [abs(b - a) for a, b in zip(at_open, at_open[1:])]
    years = max(1 / 365.25, (rows[-1]["ts"] - rows[0]["ts"]).days / 365.25)
    return {
        "at_open": at_open,
        "equity": eq,
        "bh": bh,
        "mdd": mdd,
        "trades": round(sum(moves)) if version == "v1" else sum(m > 1e-12 for m in moves),
        "cagr": eq[-1] ** (1 / years) - 1,
    }
