"""Numeric column expressions: coercion, guarded arithmetic, number text, normal quantile."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: text accepted as a number (no unit suffixes, thousands separators or NaN words).
NUMERIC_TEXT = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def to_number(df: DataFrame, name: str, dtype: str = "double") -> Column:
    """Coerce ``df[name]`` to a number; anything unreadable (and NaN) becomes NULL."""
    field = df.schema[name].dataType
    col = F.col(name)
    if isinstance(field, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col), col).try_cast(dtype)
    if isinstance(field, T.NumericType):
        return col.try_cast(dtype)
    text = col.cast("string")
    return F.when(text.rlike(NUMERIC_TEXT), text.try_cast(dtype))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division giving NULL for a zero divisor."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def total(col: Column | str) -> Column:
    """Sum kept in the input's own type (exact for decimals), shown as DOUBLE."""
    return F.sum(col).cast("double")


def half_even(col: Column, digits: int) -> Column:
    """Round to ``digits`` places by scaling, ties to even on the scaled binary value."""
    scale = F.lit(float(10**digits))
    return F.rint(col * scale) / scale


def fixed(col: Column, digits: int) -> Column:
    """Number text without separators, ties rounded to even."""
    return F.replace(F.format_number(col.cast("double"), digits), F.lit(","), F.lit(""))


def grouped(col: Column, digits: int = 0) -> Column:
    """Number text with thousands separators, ties rounded to even."""
    return F.format_number(col.cast("double"), digits)


def normal_quantile(level: float | Column) -> Column:
    """Inverse of the standard normal distribution function.

    A Python number is folded to a literal.  A column is evaluated with the
    published rational approximation of P. J. Acklam (relative error 1.2e-9).
    """
    if not isinstance(level, Column):
        return F.lit(NormalDist().inv_cdf(float(level)))
    # Coefficients of the published approximation.
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
         1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
         6.680131188771972e01, -1.328068155288572e01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
         -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
         3.754408661907416e00)
    low = 0.02425

    def horner(coefs: tuple[float, ...], x: Column) -> Column:
        acc = F.lit(coefs[0])
        for k in coefs[1:]:
            acc = acc * x + F.lit(k)
        return acc

    def tail(p: Column) -> Column:
        q = F.sqrt(F.lit(-2.0) * F.ln(p))
        return ratio(horner(c, q), horner(d, q) * q + F.lit(1.0))

    centre = level - F.lit(0.5)
    square = centre * centre
    middle = ratio(horner(a, square) * centre, horner(b, square) * square + F.lit(1.0))
    return (
        F.when((level <= 0) | (level >= 1), F.lit(None).cast("double"))
        .when(level < low, tail(level))
        .when(level > 1 - low, -tail(F.lit(1.0) - level))
        .otherwise(middle)
    )
