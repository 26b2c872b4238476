"""Prices as Column expressions: discount, coupon, tax, shipping, final price."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TAX_RATE = 0.18
FREE_SHIPPING_FROM = 500
SHIPPING_FEE = 40.0
COUPON_PERCENT = {"SAVE10": 10}
COUPON_AMOUNT = {"FLAT50": 50}


def cents(amount: Column) -> Column:
    """Round the exact binary value half-even to two places; ``round`` would round its decimal print."""
    return F.call_function("format_number", amount.cast("double"), F.lit("0.00")).cast("double")


def discount(amount: Column, percent: Column) -> Column:
    """Take ``percent`` off; percentages beyond 100 give negative amounts."""
    return amount - amount * percent / 100


def coupon_error(code: Column) -> Column:
    """The message of a code that isn't known; null for none or a known one. '' is a code."""
    known = [*COUPON_PERCENT, *COUPON_AMOUNT]
    return F.when(code.isNotNull() & ~code.isin(*known), F.format_string("unknown coupon code: '%s'", code))


def coupon(amount: Column, code: Column) -> Column:
    """The amount after ``code``; unchanged without one, null for an unknown one (see ``coupon_error``)."""
    out = F.when(code.isNull(), amount)
    for name, percent in COUPON_PERCENT.items():
        out = out.when(code == name, discount(amount, F.lit(percent)))
    for name, off in COUPON_AMOUNT.items():
        out = out.when(code == name, F.greatest(amount - off, F.lit(0.0)))
    return out


def tax(amount: Column) -> Column:
    return cents(amount * F.lit(TAX_RATE))


def shipping(amount: Column) -> Column:
    return F.when(amount >= FREE_SHIPPING_FROM, F.lit(0.0)).otherwise(F.lit(SHIPPING_FEE))


def price(subtotal: Column, percent: Column | None = None, code: Column | None = None) -> Column:
    """Discount, then coupon, then tax and shipping on what is left, to two places."""
    left = discount(subtotal, F.lit(0) if percent is None else percent)
    left = left if code is None else coupon(left, code)
    return cents(left + tax(left) + shipping(left))
