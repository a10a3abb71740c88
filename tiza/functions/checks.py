"""Predicates over requests, payments and groups. A null input fails its check."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Payment states that count as paid: fixed values.
PAID = ("paid", "success", "completed")
#: The largest amount that the first gateway takes by default.
MOST = 5000


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def positive_amount(amount: Column) -> Column:
    """A number above 0; fractions pass."""
    x = amount.try_cast("double")
    return _sure((x > 0) & (x < float("inf")))


def payable(amount: Column, most: int = MOST) -> Column:
    """A number from 0 to `most` after rounding to whole units, halves up; without a limit if most is 0."""
    x = F.floor(amount.try_cast("double") + 0.5)
    return _sure((x >= 0) & ((x <= most) if most else F.lit(True)))


def price_fits(price: Column, plan_price: Column) -> Column:
    """Whether a price is that of its plan; plans without a price or with price 0 can't be bought."""
    return _sure((plan_price > 0) & (price.try_cast("double") == plan_price))


def paid(status: Column) -> Column:
    """Whether a state means paid, in any case."""
    return _sure(F.lower(status).isin(*PAID))


def exactly_paid(status: Column) -> Column:
    return _sure(status == "paid")


def present(*fields: Column) -> Column:
    """Whether all required fields are there: neither null, an empty string, false, nor the number 0 or NaN. The string "0" is there."""
    all_of = F.lit(True)
    for f in fields:
        text = f.cast("string")
        number = text.try_cast("double")
        there = F.when(F.typeof(f) == "string", text != "").otherwise((text != "false") & F.coalesce((number != 0) & ~F.isnan(number), F.lit(True)))
        all_of = all_of & _sure(there)
    return all_of


def pending(files: Column, evaluated: Column, evaluating: Column) -> Column:
    """Groups to evaluate: with files, neither done nor under way."""
    return (F.coalesce(F.size(files), F.lit(0)) > 0) & ~_sure(evaluated) & ~_sure(evaluating)
