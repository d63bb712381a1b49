"""Column helpers for text, time and decimal values."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,12)"
AMOUNT = "decimal(37,12)"  # what is added up: sums and differences of WIDE values would lose their last digit


def normalize_market(market: Column) -> Column:
    """Upper-case, trimmed market code; null becomes the empty string."""
    return F.upper(F.trim(F.coalesce(market, F.lit(""))))


def asset_of(market: Column) -> Column:
    """Text after the first dash of the normalised market, empty if there is none."""
    code = normalize_market(market)
    dash = F.instr(code, "-")
    return F.when(dash > 0, F.substring(code, dash + 1, F.length(code))).otherwise(F.lit(""))


def parse_utc(text: Column) -> Column:
    """ISO text to timestamp; text without an offset is UTC (session zone must be UTC); null if unparsable."""
    clean = F.regexp_replace(F.trim(text), "z$", "Z")
    return F.when(F.length(clean) >= 10, clean.try_cast("timestamp"))


def safe_name(text: Column) -> Column:
    """Characters other than letters, digits, dot, underscore and dash become underscores."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}._-]", "_")


def partition_name(market: Column, start: Column, end: Column, interval: str) -> Column:
    """Name of a stored candle range: market, first day, last day, interval."""
    day = lambda c: F.date_format(c, "yyyyMMdd")
    return F.concat_ws("_", safe_name(market), day(start), day(end), F.lit(interval))


def finite(x: Column) -> Column:
    """Value if it is a finite number, else null."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def finite_or_zero(x: Column) -> Column:
    """Metric for a log row: non-finite and negative zero become 0.0."""
    value = F.coalesce(finite(x), F.lit(0.0))
    return F.when(value == 0.0, F.lit(0.0)).otherwise(value)


def escape_label(text: Column) -> Column:
    """Backslashes and double quotes get a backslash in front."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def plain_decimal(value: Column) -> Column:
    """Decimal text without exponent or trailing zeros."""
    text = value.cast(WIDE).cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def dec(value: Column) -> Column:
    """Ledger decimal; null and unparsable text become zero, a number beyond the ledger's range becomes null."""
    number = finite(value.try_cast("double"))
    return F.coalesce(value.try_cast(AMOUNT), F.when(number.isNull(), F.lit(0).cast(AMOUNT)))


def _e(digits: int) -> Column:
    return F.lit(Decimal(10) ** digits)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _parts(x: Column) -> tuple[Column, Column]:
    """Whole part and fraction (in units of 1e-12) of an amount without its sign.

    Signs are changed on the parts only: changing the sign of a decimal rounds it to 34 digits.
    """
    rest = x % F.lit(Decimal(1))
    return F.abs(F.try_subtract(x, rest).cast("decimal(25,0)")), F.abs((rest * _e(12)).cast("decimal(12,0)"))


def _whole(x: Column) -> Column:
    """An amount without its sign in units of 1e-12."""
    high, low = _parts(x)
    return F.try_add(F.try_multiply(high, _e(12)), low)


def _amount(units: Column, negative: Column) -> Column:
    """Units of 1e-12 as a ledger decimal."""

    def signed(u: Column) -> Column:
        rest = u % _e(12)
        high = F.try_divide(F.try_subtract(u, rest), _e(12)).try_cast("decimal(25,0)")
        low = rest.cast("decimal(12,0)") * F.lit(Decimal("0.000000000001"))
        return F.when(negative, (-high) + (-low)).otherwise(high + low).cast(WIDE)

    return let(units, signed)


def _split(x: Column) -> tuple[Column, Column]:
    """Whole part and fraction of an amount, both with its sign."""
    rest = (x % F.lit(Decimal(1))).cast("decimal(12,12)")
    return (x - rest).cast("decimal(25,0)"), rest


def _product(a: Column, b: Column, half_up: bool) -> Column:
    """The four products of the parts: three of them exact as they are, only the one of the fractions is rounded.

    All have the same sign, so a partial sum that does not fit means that the product does not fit. Amounts of usual
    size take one product, or two if only the second one is large. These are plain decimal columns, which Spark compiles;
    functions over arrays would be interpreted row by row.
    """

    def places12(x: Column) -> Column:
        return x if half_up else x - x % F.lit(Decimal("0.000000000001"))

    small = a.try_cast("decimal(19,12)")
    usual = places12(small * b.try_cast("decimal(17,12)")).cast(WIDE)
    (a_high, a_low), (b_high, b_low) = _split(a.try_cast(AMOUNT)), _split(b.try_cast(AMOUNT))
    large = (small * b_high.try_cast("decimal(18,0)")).try_cast(AMOUNT) + places12(small * b_low).cast("decimal(20,12)")
    tail = places12(a_low * b_low).cast("decimal(13,12)")
    total = F.try_multiply(a_high, b_high).try_cast("decimal(25,0)")
    for part in ((a_high * b_low).cast(AMOUNT), (a_low * b_high).cast(AMOUNT), tail):
        total = (total + part).try_cast(AMOUNT)
    return F.coalesce(usual, large.try_cast(AMOUNT).cast(WIDE), total.cast(WIDE))


def _quotient(a: Column, b: Column, half_up: bool) -> Column:
    """The whole part, then twelve digits of what it leaves, for divisors below 1e11; long division for larger ones.

    The first way is plain decimal columns, which Spark compiles.
    """
    a, b = a.try_cast(AMOUNT), b.try_cast(AMOUNT)
    by = F.when(b != 0, b.try_cast("decimal(23,12)"))
    left = F.try_mod(a, by).cast("decimal(23,12)")
    whole = F.try_divide(a - left, by).try_cast("decimal(25,0)")
    if half_up:
        half = F.abs(by)
        digits = F.call_function("div", left * F.lit(Decimal(2 * 10**12)) + F.when(a < 0, -half).otherwise(half), by * F.lit(Decimal(2)))
    else:
        digits = F.call_function("div", left * _e(12), by)
    short = (whole + digits.cast("decimal(13,0)") * F.lit(Decimal("0.000000000001"))).try_cast(AMOUNT).cast(WIDE)
    return F.coalesce(short, F.when(by.isNull(), _long_quotient(a, b, half_up)))


def _long_quotient(a: Column, b: Column, half_up: bool) -> Column:
    """Long division in whole numbers: the whole part, then six digits, then six more."""
    units = "decimal(38,0)"

    def step(s: Column, factor: Column) -> Column:
        n = F.try_multiply(s["rest"], factor)
        rest = n % s["by"]
        more = F.try_divide(F.try_subtract(n, rest), s["by"]).try_cast("decimal(25,0)")
        total = F.try_add(F.try_multiply(s["q"], factor), more)
        return F.struct(total.cast(units).alias("q"), rest.cast(units).alias("rest"), s["by"].alias("by"))

    def exact(x: Column) -> Column:
        by = F.nullif(_whole(x["b"]), F.lit(Decimal(0))).cast(units)
        begin = F.struct(F.lit(Decimal(0)).cast(units).alias("q"), _whole(x["a"]).cast(units).alias("rest"), by.alias("by"))
        up = lambda s: F.when(s["rest"] >= s["by"] - s["rest"], 1).otherwise(0) if half_up else F.lit(0)
        digits = F.array(_e(0), _e(6), _e(6))
        total = F.aggregate(digits, begin, step, lambda s: F.try_add(s["q"], up(s).cast("decimal(1,0)")).cast(units))
        return _amount(total, (x["a"] < 0) != (x["b"] < 0))

    return let(F.struct(a.alias("a"), b.alias("b")), exact)


def mul12(a: Column, b: Column) -> Column:
    """Exact decimal product rounded half up to 12 places once; null when it does not fit the ledger."""
    return _product(a, b, True)


def mul_down(a: Column, b: Column) -> Column:
    """Exact decimal product cut to 12 places; null when it does not fit the ledger."""
    return _product(a, b, False)


def div_half_up(a: Column, b: Column) -> Column:
    """Exact quotient rounded half up to 12 places once.

    Null when the divisor is zero, or when it is 1e20 or more or the result does not fit the ledger.
    """
    return _quotient(a, b, True)


def div_down(a: Column, b: Column) -> Column:
    """Exact quotient cut to 12 places; null as in ``div_half_up``."""
    return _quotient(a, b, False)


def positive(x: Column) -> Column:
    """Value if it is above zero, else null."""
    return F.when(x > 0, x)
