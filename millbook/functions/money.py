"""Exact money arithmetic helpers (decimals in, decimals out)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millbook.sources.schemas import MONEY, WIDE_MONEY


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def wide(c: str | Column) -> Column:
    """Reported sums: decimal(18,2), half-up."""
    return _col(c).cast(WIDE_MONEY)


def money(c: str | Column) -> Column:
    return _col(c).cast(MONEY)


def sum_money(c: str | Column) -> Column:
    return F.sum(_col(c)).cast(WIDE_MONEY)


def zero() -> Column:
    return F.lit(0).cast(WIDE_MONEY)


def num_or(c: str | Column, default) -> Column:
    """JavaScript ``x || default`` on a number: NULL and 0 take the default."""
    col = _col(c)
    return F.coalesce(F.nullif(col, F.lit(0)), default if isinstance(default, Column) else F.lit(default))


def text_or(c: str | Column, default) -> Column:
    """JavaScript ``x || default`` on text: NULL and '' take the default."""
    col = _col(c)
    return F.coalesce(F.nullif(col, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def quotient(num: str | Column, den: str | Column, places: int) -> Column:
    """``num / den`` in decimal, half-up to ``places``; NULL when the denominator is 0 or NULL."""
    n, d = _col(num).cast(T.DecimalType(24, 2)), F.nullif(_col(den).cast(T.DecimalType(13, 2)), F.lit(0))
    return F.round(n / d, places).cast(T.DecimalType(20, places))


def parse_number(c: str | Column, default=0) -> Column:
    """JavaScript ``parseFloat(x) || default`` on text: the number the text begins with, NULL, 0 and no number give the default."""
    text = F.regexp_extract(_col(c), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return num_or(text.try_cast(T.DoubleType()).cast(T.DecimalType(18, 4)), F.lit(default).cast(T.DecimalType(18, 4)))


def cents(c: str | Column) -> Column:
    """Decimal(*,2) -> exact integer cents (for integer folds)."""
    return (_col(c) * F.lit(100)).cast(T.LongType())


def from_cents(c: str | Column, dtype: T.DataType = WIDE_MONEY) -> Column:
    return (_col(c).cast(T.DecimalType(20, 0)) / F.lit(100)).cast(dtype)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _exact_error(a: Column, b: float, p: Column) -> Column:
    """The exact error of the rounded product ``p`` of the doubles ``a`` and ``b`` (Dekker)."""
    half = float(2 ** 27 + 1)
    bh = half * b - (half * b - b)
    bl = b - bh
    ah = F.lit(half) * a - (F.lit(half) * a - a)
    return _let(ah, lambda h: ((h * F.lit(bh) - p) + h * F.lit(bl) + (a - h) * F.lit(bh)) + (a - h) * F.lit(bl))


def to_fixed(c: str | Column, places: int = 2) -> Column:
    """JavaScript ``x.toFixed(places)`` of a double: text, rounded half away from zero on the *binary* value.

    1.005 is a little less than its decimal spelling and gives "1.00"; 0.125 is
    exact and gives "0.13". A value splits exactly into millions of units, units and
    a fraction; the fraction times ``10^places`` is rounded by the product and, where
    that is a half, by the product's exact error. NaN, infinities and values from
    1e21 on are spelt as JavaScript spells them; NULL stays.
    """
    million, steps_of_one = 1048576.0, 10 ** places  # a power of two, so dividing by it is exact

    def written(number: Column, steps: Column) -> Column:
        carried = F.when(steps >= steps_of_one, 1).otherwise(0)
        digits = F.lpad((steps - carried * steps_of_one).cast("string"), places, "0") if places else F.lit("")
        return F.concat((number + carried).cast(T.DecimalType(38, 0)).cast("string"), F.lit("." if places else ""), digits)

    def rounded(fraction: Column, number: Column) -> Column:
        def of_product(p: Column) -> Column:
            rest = p - F.floor(p).cast("double")
            up = (rest > 0.5) | ((rest == 0.5) & (_exact_error(fraction, float(steps_of_one), p) >= 0))
            return _let(F.floor(p) + F.when(up, 1).otherwise(0), lambda steps: written(number, steps))
        return _let(fraction * F.lit(float(steps_of_one)), of_product)

    def of_size(size: Column) -> Column:
        def of_whole(whole: Column) -> Column:
            low = size - whole.cast("double") * million
            number = whole.cast(T.DecimalType(20, 0)) * F.lit(1048576) + F.floor(low)
            return _let(low, lambda v: _let(v - F.floor(v).cast("double"), lambda f: rounded(f, number)))
        return _let(F.floor(size / million), of_whole)

    def of_value(x: Column) -> Column:
        sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
        large = F.regexp_replace(F.regexp_replace(x.cast("string"), r"\.0E", "e+"), "E", "e+")
        odd = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        return F.when(odd, x.cast("string")).when(F.abs(x) >= 1e21, large).otherwise(F.concat(sign, of_size(F.abs(x))))

    return _let(_col(c).cast(T.DoubleType()), of_value)
