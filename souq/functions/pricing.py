"""Money rules (X-01 .. X-05).  Money stays decimal end to end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from souq.functions._col import as_col

MONEY = DecimalType(18, 2)

# Fixed values of the reference: the home page converts USD to INR with a
# factor of 75 and prints a rupee sign; the seller page prints the sign only.
INR_PER_USD = 75
RUPEE = "₹"


def _pct_fraction(pct: Column) -> Column:
    # pct * 0.01 keeps decimal arithmetic exact (pct / 100 would be too, but
    # this is the form both engines agree on).
    return pct * F.lit(0.01).cast(DecimalType(3, 2))


def discounted_price(price: Column | str, pct: Column | str) -> Column:
    """X-01: ``ROUND(price * (1 - pct/100), 2)`` as decimal(18,2)."""
    price, pct = as_col(price), as_col(pct)
    return F.round(price * (F.lit(1) - _pct_fraction(pct)), 2).cast(MONEY)


def discounted_price_exact(price: Column | str, pct: Column | str) -> Column:
    """X-02: unrounded ``price - price*pct/100`` (decimal, not PHP float)."""
    price, pct = as_col(price), as_col(pct)
    return price - price * _pct_fraction(pct)


def _money_text(amount: Column) -> Column:
    # number_format rounds half up; format_number alone would round half even,
    # so round first (T-05).
    return F.format_number(F.round(amount, 2), 2)


def home_price_label(price: Column | str) -> Column:
    """X-03 format_price: x75, rupee sign, two decimals, thousands commas."""
    return F.concat(F.lit(RUPEE), _money_text(as_col(price) * F.lit(INR_PER_USD)))


def seller_price_label(amount: Column | str) -> Column:
    """X-04: the seller page prints the rupee sign without converting (T-10)."""
    return F.concat(F.lit(RUPEE), _money_text(as_col(amount)))


def discount_label(pct: Column | str) -> Column:
    """X-05 format_discount: ``round(pct) . '% OFF'``."""
    return F.concat(F.round(as_col(pct), 0).cast("int").cast("string"), F.lit("% OFF"))


def discount_badge(pct: Column | str) -> Column:
    """Seller badge: the stored decimal text plus ``% OFF`` when positive, else ``-``."""
    pct = as_col(pct)
    return F.when(pct > 0, F.concat(pct.cast("string"), F.lit("% OFF"))).otherwise(F.lit("-"))


def seller_deal_label(price: Column | str, pct: Column | str) -> Column:
    """Seller page discounted price (X-02 then X-04); NULL when there is no discount."""
    pct = as_col(pct)
    return F.when(pct > 0, seller_price_label(discounted_price_exact(price, pct)))
