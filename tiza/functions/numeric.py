"""Numeric Column builders: lenient parsing, rounding, grades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[ \t\n\r\f\x0b]"


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Halves go up: floor(x * 10^digits + 0.5) / 10^digits. round() differs where doubles fall just short of a half."""
    scale = float(10**digits)
    y = F.floor(x * scale + 0.5)
    return y if digits == 0 else y / scale


def parse_int(text: Column) -> Column:
    """The integer that begins the text, as `12` in `12abc`; null if none does."""
    return F.regexp_extract(text, rf"^{BLANK}*([+-]?[0-9]+)", 1).try_cast("int")


def parse_number(text: Column) -> Column:
    """The whole text as a number, else 0."""
    return F.coalesce(F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "").try_cast("double"), F.lit(0.0))


def parse_leading_number(text: Column) -> Column:
    """The decimal number that begins the text, else 0."""
    return F.coalesce(F.regexp_extract(text, rf"^{BLANK}*([+-]?[0-9]+(?:\.[0-9]*)?|[+-]?\.[0-9]+)", 1).try_cast("double"), F.lit(0.0))


def pass_points(maximum: Column, pct: Column) -> Column:
    return F.ceil(maximum * (F.least(F.lit(100.0), pct) / 100))


def grade(score: Column, maximum: Column, pct: Column, low: float = 1.0, passing: float = 4.0, high: float = 7.0) -> Column:
    """Piecewise linear: low at 0, passing at the pass points, high at the maximum; to a tenth, halves up, never above high.

    Where the pass points equal the maximum, a score of just that much gets the passing grade."""
    ap, s = pass_points(maximum, pct).cast("double"), F.greatest(F.lit(0.0), score)
    below = F.least(F.lit(passing), low + (passing - low) * s / F.nullif(ap, F.lit(0.0)))
    above = F.when(maximum == ap, F.lit(high)).otherwise(passing + (high - passing) * (s - ap) / F.nullif(maximum - ap, F.lit(0.0)))
    raw = F.when(s == 0, F.lit(low)).when(s <= ap, below).otherwise(above)
    guard = (maximum <= 0) | (pct <= 0) | maximum.isNull() | pct.isNull() | score.isNull()
    return F.when(guard, F.lit(low)).otherwise(F.least(F.lit(high), round_half_up(raw, 1)))


def grade_unceiled(score: Column, maximum: Column, pct: Column) -> Column:
    """As grade, but with fractional pass points."""
    ap = maximum * pct / 100
    above = 4.0 + F.when(maximum - ap > 0, (score - ap) / F.nullif(maximum - ap, F.lit(0.0))).otherwise(0.0) * 3.0
    below = 1.0 + F.when(ap > 0, score / F.nullif(ap, F.lit(0.0))).otherwise(0.0) * 3.0
    return round_half_up(F.greatest(F.lit(1.0), F.least(F.lit(7.0), F.when(score >= ap, above).otherwise(below))), 1)


def final_grade(value: Column, tenths: Column) -> Column:
    """Grade plus extra tenths; neither capped nor rounded."""
    return F.coalesce(value, F.lit(0.0)) + F.coalesce(tenths, F.lit(0.0))


def clamp_grade(value: Column) -> Column:
    """A number from outside: what isn't one counts as 1, and all stay within 1 and 7."""
    x = value.try_cast("double")
    return F.least(F.lit(7.0), F.greatest(F.lit(1.0), F.coalesce(F.when(~F.isnan(x), x), F.lit(1.0))))


def percent(part: Column, whole: Column) -> Column:
    """100 part / whole, at most 100; null where whole is 0."""
    return F.when(whole != 0, F.least(F.lit(100.0), 100.0 * part / F.nullif(whole, F.lit(0).cast("double"))))


def confidence_percent(confidence: Column, digits: int = 1) -> Column:
    """A confidence from 0 to 1 as a percentage, halves up."""
    return round_half_up(100.0 * confidence, digits)


def progress(done: Column, total: Column) -> Column:
    return F.when(total > 0, round_half_up(100.0 * done / F.nullif(total, F.lit(0)))).otherwise(0)


def amount(x: Column) -> Column:
    """Amounts above 1000 as they are, others rounded."""
    return F.when(x > 1000, x).otherwise(round_half_up(x).cast("double"))


def random_code() -> Column:
    """Six digits; differs from row to row and run to run."""
    return F.floor(100000 + F.rand() * 900000).cast("string")
