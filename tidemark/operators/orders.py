"""Order requests: checks, amounts, paper fills, balances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import AMOUNT, WIDE, dec, div_down, div_half_up, mul12, mul_down, positive

# Enum texts of the ledger.
SIDES = ["BUY", "SELL"]
ORDER_TYPES = ["LIMIT", "MARKET_BUY", "MARKET_SELL"]
MODES = ["PAPER", "LIVE"]
STATUSES = ["CREATED", "SUBMITTED", "PARTIALLY_FILLED", "FILLED", "CANCELED", "REJECTED"]
ACTIVE_STATUSES = ["CREATED", "SUBMITTED", "PARTIALLY_FILLED"]


def _not_above_zero(x: Column) -> Column:
    return x.isNull() | (x <= 0)


def request_error() -> Column:
    """Code of the first rule an order request breaks, null for a valid one.

    Field rules come first: market, side, type and mode present, quantity and price above zero when given.
    """
    market, side, kind, mode = (F.col(c) for c in ("market", "side", "order_type", "mode"))
    qty, price = F.col("quantity"), F.col("price")
    paper, buy, sell = mode == "PAPER", kind == "MARKET_BUY", kind == "MARKET_SELL"
    rules = [
        (F.length(F.trim(F.coalesce(market, F.lit("")))) == 0, "market_blank"),
        (side.isNull(), "side_missing"),
        (kind.isNull(), "type_missing"),
        (mode.isNull(), "mode_missing"),
        (qty <= 0, "quantity_not_positive"),
        (price <= 0, "price_not_positive"),
        (~side.isin(SIDES) | ~mode.isin(MODES) | ~kind.isin(ORDER_TYPES), "unsupported_type"),
        ((side == "BUY") & sell, "buy_with_market_sell"),
        ((side == "SELL") & buy, "sell_with_market_buy"),
        ((kind == "LIMIT") & (qty.isNull() | price.isNull()), "limit_needs_quantity_and_price"),
        (buy & paper & _not_above_zero(qty), "paper_buy_needs_quantity"),
        (buy & paper & _not_above_zero(price), "paper_buy_needs_notional"),
        (sell & _not_above_zero(qty), "sell_needs_quantity"),
        (sell & paper & _not_above_zero(price), "paper_sell_needs_price"),
    ]
    return F.coalesce(*[F.when(bad, code) for bad, code in rules])


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid requests, and the refused ones with their rule code."""
    checked = requests.withColumn("error", request_error())
    return checked.where(F.col("error").isNull()).drop("error"), checked.where(F.col("error").isNotNull())


def requested_notional() -> Column:
    """Price field of a market buy, quantity times price otherwise."""
    product = mul12(F.coalesce("quantity", F.lit(0).cast(AMOUNT)), F.coalesce("price", F.lit(0).cast(AMOUNT)))
    return F.when(F.col("order_type") == "MARKET_BUY", F.col("price").try_cast(WIDE)).otherwise(product)


def build_orders(requests: DataFrame, key: Column) -> DataFrame:
    """Ledger rows in status CREATED for valid requests; ``key`` names each order."""
    return requests.select(
        key.alias("client_order_id"),
        F.col("market").alias("symbol"),
        "side",
        "order_type",
        "mode",
        "quantity",
        "price",
        F.lit("CREATED").alias("status"),
        requested_notional().alias("requested_notional"),
    )


def paper_price() -> Column:
    """Unit price of a paper order: notional over quantity for a market buy, else the given price."""
    unit = div_half_up(F.col("requested_notional"), F.col("quantity"))
    return F.when(F.col("order_type") == "MARKET_BUY", unit).otherwise(F.col("price").try_cast(WIDE))


def paper_fill(orders: DataFrame, fee_rate: float | str) -> DataFrame:
    """Fill paper orders at their price: executed volume, fee, status FILLED.

    ``amount_error`` names the orders whose amounts do not fit the ledger; these stay unfilled.
    """
    zero = F.lit(0).cast(WIDE)
    per_unit = F.col("requested_notional").isNull() | F.coalesce(F.col("quantity") == 0, F.lit(True))
    missing = F.when(F.col("order_type") == "MARKET_BUY", per_unit).otherwise(F.col("price").isNull())
    # Each amount is a column of its own before the next one names it, so that it is worked out once.
    rows = orders.withColumn("avg_executed_price", F.when(missing, zero).otherwise(paper_price()))
    price, notional = F.col("avg_executed_price"), F.col("requested_notional")
    bought = F.when((price > 0) & notional.isNotNull(), div_down(notional, price)).otherwise(zero)
    qty = F.when(F.col("quantity").isNotNull(), F.col("quantity").try_cast(WIDE)).otherwise(bought)
    rows = rows.withColumn("executed_volume", qty)
    rows = rows.withColumn("fee_amount", mul12(price, F.col("executed_volume")))
    rows = rows.withColumn("fee_amount", mul12(F.lit(str(fee_rate)).cast(AMOUNT), F.col("fee_amount")))
    short = F.col("avg_executed_price").isNull() | F.col("executed_volume").isNull() | F.col("fee_amount").isNull()
    error = F.when(short, "amount_out_of_range")
    return rows.withColumns({"amount_error": error, "status": F.when(short, F.col("status") if "status" in orders.columns else F.lit("CREATED")).otherwise("FILLED")})


def spendable(balance: Column, fee_rate: float | str) -> Column:
    """Whole quote units a market buy may use after the fee; a share outside (0, 1] counts as 1."""
    share = F.lit(1).cast("decimal(12,8)") - F.lit(str(fee_rate)).cast("decimal(12,8)")
    share = F.when((share > 0) & (share <= 1), share).otherwise(F.lit(1).cast("decimal(12,8)"))
    return F.floor(mul_down(F.coalesce(balance, F.lit(0)), share)).cast("decimal(38,0)")


def flatten_chance(df: DataFrame) -> DataFrame:
    """Fees and balances out of the nested order-chance record; missing branches are 0."""
    text = {
        "bid_fee": "bid_fee",
        "ask_fee": "ask_fee",
        "bid_balance": "bid_account.balance",
        "bid_locked": "bid_account.locked",
        "ask_balance": "ask_account.balance",
        "ask_locked": "ask_account.locked",
        "ask_avg_buy_price": "ask_account.avg_buy_price",
        "bid_min_total": "market.bid.min_total",
        "ask_min_total": "market.ask.min_total",
    }
    return df.select("symbol", *[dec(F.col(path)).alias(name) for name, path in text.items()])


def with_notional_estimate(orders: DataFrame, chances: DataFrame, tickers: DataFrame, fee_rate: float | str) -> DataFrame:
    """Add the estimated notional and why it is missing.

    The requested notional wins.  A market buy takes the spendable balance; a market sell multiplies its
    quantity by the first positive of order price, average buy price and last trade price.
    """
    # The budget is worked out per symbol, and the reference once per order: the exact product names it several times.
    chances = chances.withColumn("_budget", spendable(F.col("bid_balance"), fee_rate))
    rows = orders.join(chances, "symbol", "left").join(tickers, "symbol", "left")
    wanted = positive(F.col("requested_notional"))
    budget = positive(F.coalesce("_budget", F.lit(0).cast("decimal(38,0)"))).cast(WIDE)
    reference = F.coalesce(*[positive(F.col(c)).cast(WIDE) for c in ("price", "ask_avg_buy_price", "last_price")])
    rows = rows.withColumn("_reference", reference)
    sale = mul12(F.coalesce("quantity", F.lit(0).cast(AMOUNT)), F.col("_reference"))
    kind = F.col("order_type")
    amount = F.coalesce(
        wanted.cast(WIDE),
        F.when(kind == "MARKET_BUY", budget),
        F.when(kind == "MARKET_SELL", sale),
        F.when(kind == "LIMIT", F.coalesce(F.col("requested_notional").cast(WIDE), F.lit(0).cast(WIDE))),
    )
    error = F.when(
        F.col("estimated_notional").isNull(), F.when(kind == "MARKET_BUY", "insufficient_balance").otherwise("missing_reference_price")
    )
    rows = rows.withColumn("estimated_notional", amount)
    return rows.withColumn("estimate_error", error).drop("_budget", "_reference")


def balance_sufficient() -> Column:
    """Buys need the notional in quote currency, sells the quantity in the asset."""
    zero = F.lit(0).cast(AMOUNT)
    quote, asset = F.coalesce("bid_balance", zero), F.coalesce("ask_balance", zero)
    return F.when(F.col("side") == "BUY", quote >= F.col("estimated_notional")).otherwise(
        asset >= F.coalesce("quantity", zero)
    )


def balances(accounts: DataFrame, currency: str | None = None) -> DataFrame:
    """Typed balances, optionally of one currency in any letter case."""
    rows = accounts
    if currency and currency.strip():
        rows = rows.where(F.lower("currency") == currency.strip().lower())
    return rows.select(
        "currency", *[dec(F.col(c)).alias(c) for c in ("balance", "locked", "avg_buy_price")], "unit_currency"
    )


def exchange_request(orders: DataFrame) -> DataFrame:
    """Wire form of an order: side and type words and plain decimal text."""
    from tidemark.functions.scalar import plain_decimal

    kind = F.col("order_type")
    return orders.select(
        F.col("client_order_id").alias("identifier"),
        F.col("symbol").alias("market"),
        F.when(F.col("side") == "BUY", "bid").otherwise("ask").alias("side"),
        F.when(kind == "LIMIT", "limit").when(kind == "MARKET_BUY", "price").otherwise("market").alias("ord_type"),
        F.when(kind != "MARKET_BUY", plain_decimal(F.col("quantity"))).alias("volume"),
        F.when(kind != "MARKET_SELL", plain_decimal(F.col("price"))).alias("price"),
    )


def signal_requests(signals: DataFrame, mode: str, notional: float | str) -> DataFrame:
    """Order requests of buy and sell signals.

    A paper buy spends a fixed notional at the close (quantity cut to 12 places, dropped at zero); a live buy
    leaves both fields open.  A sell takes the held quantity, dropped when there is none.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    paper = F.lit(mode == "PAPER")
    close, spend = F.col("close").cast(AMOUNT), F.lit(str(notional)).cast(AMOUNT)
    buy = F.col("buy_signal")
    qty = F.when(buy, F.when(paper & (close > 0), div_down(spend, close))).otherwise(F.col("position_qty").cast(WIDE))
    rows = signals.where(F.col("buy_signal") | F.col("sell_signal")).select(
        "market",
        F.when(buy, "BUY").otherwise("SELL").alias("side"),
        F.when(buy, "MARKET_BUY").otherwise("MARKET_SELL").alias("order_type"),
        qty.alias("quantity"),
        F.when(paper, F.when(buy, spend).otherwise(close)).cast(WIDE).alias("price"),
        F.lit(mode).alias("mode"),
        F.col("signal_ts").alias("signal_ts"),
    )
    open_buy = (F.col("side") == "BUY") & ~paper
    return rows.where(open_buy | (F.col("quantity") > 0))


def slippage_pct(signal: Column, executed: Column) -> Column:
    """Executed price against signal price in percent; undefined unless both are above zero."""
    return F.when((signal > 0) & (executed > 0), (executed / signal - 1.0) * 100.0)


def unrealized_return_pct(has_position: Column, price: Column, avg_price: Column) -> Column:
    """Open profit in percent; undefined without a position or average price."""
    return F.when(has_position & (avg_price > 0) & price.isNotNull(), (price / avg_price - 1.0) * 100.0)


def live_price(ticker: Column, close: Column) -> Column:
    """Ticker price if finite and above zero, else the close if so, else undefined."""
    inf = float("inf")
    good = lambda x: F.when((x > 0) & (x < inf) & ~F.isnan(x), x)
    return F.coalesce(good(ticker), good(close))
