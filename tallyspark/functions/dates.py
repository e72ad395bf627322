"""Date column expressions and the ``as_of`` convention."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

AsOf = dt.date | dt.datetime | str | Column | None

# Accepted date shapes and their ISO rewriting; two-digit years from 69 on are of the 20th century.
ISO_TEXT = r"^\d{4}-\d{1,2}-\d{1,2}.*$"
_TIME = r"(?:,?[T ]+(.*))?$"
_SEP = "[-/. ]"
_HALF_DAY = r"(?i)[ap]\.?m\.?$"
YEAR_FIRST = {
    rf"^(\d{{4}})[/.](\d{{1,2}})[/.](\d{{1,2}}){_TIME}": "$1-$2-$3 $4",
    r"^(\d{4})(\d{2})(\d{2})$": "$1-$2-$3",
}
YEAR_LAST = {rf"^(\d{{1,2}}){_SEP}(\d{{1,2}}){_SEP}(\d{{4}}|\d{{2}}){_TIME}": "$3-{}-{} $4"}
YEAR_LAST_START = rf"^\d{{1,2}}{_SEP}\d"
NAMED_MONTH = {
    rf"^(\d{{1,2}})(?:st|nd|rd|th)?{_SEP}([A-Za-z]{{3,9}})\.?,?{_SEP}(\d{{4}}){_TIME}": "$3-$2-$1 $4",
    rf"^([A-Za-z]{{3,9}})\.?{_SEP}(\d{{1,2}})(?:st|nd|rd|th)?,?{_SEP}(\d{{4}}){_TIME}": "$3-$1-$2 $4",
}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def _rewritten(text: Column, shapes: dict[str, str]) -> Column:
    for shape, iso in shapes.items():
        text = F.regexp_replace(text, shape, iso)
    return text


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _numbered_month(iso: Column) -> Column:
    """The month's name after the year replaced by its number; 0 is no month."""
    names = F.array(*[F.lit(m) for m in MONTHS])
    number = F.array_position(names, F.lower(F.substring(iso, 6, 3))).cast("string")
    return F.regexp_replace(iso, F.lit("(?<=^.{5})[A-Za-z]+"), number)


def to_moment(df: DataFrame, name: str, day_first: bool | Column = False) -> Column:
    """Coerce ``df[name]`` to TIMESTAMP_NTZ; unreadable values become NULL.

    ISO text is cast at once. Other text is rewritten to ISO by its shape: compact dates, year first, year
    last (month before day for every separator, or with ``day_first`` the other way round), month names,
    two-digit years; times run on 12 or 24 hours. A bare number never reads as a year.
    """
    field = df.schema[name].dataType
    col = F.col(name)
    if isinstance(field, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return col.cast("timestamp_ntz")
    if isinstance(day_first, Column):
        return F.when(day_first, to_moment(df, name, True)).otherwise(to_moment(df, name, False))
    text = F.trim(col.cast("string"))
    places = ("$2", "$1") if day_first else ("$1", "$2")
    ordered = _rewritten(text, {k: v.format(*places) for k, v in YEAR_LAST.items()})
    # Two digits of a year get their century.
    full = _bound(ordered, lambda t: F.when(t.rlike(r"^\d{2}-"), F.concat(F.when(t < "69", "20").otherwise("19"), t)).otherwise(t))
    iso = F.trim(
        F.when(text.rlike(YEAR_LAST_START), full)
        .when(text.rlike("[A-Za-z]{3}"), _numbered_month(_rewritten(text, NAMED_MONTH)))
        .otherwise(_rewritten(text, YEAR_FIRST))
    )

    def read(whole: Column) -> Column:
        noon = F.try_to_timestamp(F.regexp_replace(F.upper(whole), r" *([AP])\.?M\.?$", " $1M"), F.lit("y-M-d h:m[:s] a")).cast("timestamp_ntz")
        return F.when(whole.rlike(_HALF_DAY), noon).otherwise(whole.try_cast("timestamp_ntz"))

    plain = text.rlike(ISO_TEXT) & ~text.rlike(_HALF_DAY)
    return F.when(plain, text.try_cast("timestamp_ntz")).otherwise(_bound(F.regexp_extract(iso, ISO_TEXT, 0), read))


def year_comes_last(df: DataFrame, name: str) -> Column:
    """Whether the text of a column starts with two short numbers, whose order is a matter of reading."""
    if not isinstance(df.schema[name].dataType, T.StringType):
        return F.lit(False)
    return F.coalesce(F.trim(F.col(name)).rlike(YEAR_LAST_START), F.lit(False))


def telling_order(df: DataFrame, name: str) -> tuple[Column, Column]:
    """Whether the text of a column can only read with the day first, and whether only with the month first.

    Only a number above 12 in one of the two places tells: with two small ones both orders read, with two large ones none.
    """
    if not isinstance(df.schema[name].dataType, T.StringType):
        return F.lit(False), F.lit(False)
    text = F.trim(F.col(name))
    return text.rlike(rf"^(1[3-9]|[2-9]\d){_SEP}(0?\d|1[0-2]){_SEP}"), text.rlike(rf"^(0?\d|1[0-2]){_SEP}(1[3-9]|[2-9]\d){_SEP}")


def reads_day_first(df: DataFrame, name: str) -> Column:
    """Whether more values of the column read as dates with the day first than with the month first.

    One scalar subquery over the column; typed columns need none.
    """
    if not isinstance(df.schema[name].dataType, T.StringType):
        return F.lit(False)
    day_leads, month_leads = telling_order(df, name)
    open_ = df.filter(year_comes_last(df, name))
    counts = F.count(F.when(day_leads, to_moment(df, name, True))) > F.count(F.when(month_leads, to_moment(df, name, False)))
    return open_.select(counts.alias("day_first")).scalar()


def day(name: str) -> Column:
    return F.to_date(F.col(name))


def as_of_moment(df: DataFrame, date: str, as_of: AsOf = None) -> Column:
    """The reference moment of an operator as TIMESTAMP_NTZ.

    Given values become literals that reach the Parquet scan as pushed filters.
    Otherwise the latest moment in the data is used, through a scalar subquery
    that Spark runs first, on the date column only.
    """
    if as_of is None:
        return df.select(F.max(F.col(date)).cast("timestamp_ntz").alias("as_of")).scalar()
    if isinstance(as_of, Column):
        return as_of.cast("timestamp_ntz")
    return F.lit(str(as_of)).cast("timestamp_ntz")


def cutoff(df: DataFrame, date: str, days: int, as_of: AsOf = None) -> Column:
    """``days`` before ``as_of``, in the type of the date column.

    The subtraction happens inside the subquery (or folds into the literal), so
    the scan compares its bare column with one value and can skip row groups.
    """
    kind, span = df.schema[date].dataType, F.make_dt_interval(F.lit(days))
    if as_of is None:
        return df.select((F.max(F.col(date)).cast("timestamp_ntz") - span).cast(kind).alias("cutoff")).scalar()
    return (as_of_moment(df, date, as_of) - span).cast(kind)


def weekday(col: Column) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(col)


def is_weekend(col: Column) -> Column:
    return F.weekday(col) >= 5


def time_features(df: DataFrame, date: str = "date") -> DataFrame:
    """Calendar inputs of the machine-learning table."""
    d = F.col(date)
    return df.withColumns({
        "day_of_week": F.weekday(d),
        "month": F.month(d),
        "quarter": F.quarter(d),
        "is_weekend": (F.weekday(d) >= 5).cast("int"),
        "is_month_end": (F.dayofmonth(d) >= 25).cast("int"),
    })


def calendar_features(df: DataFrame, date: str = "date") -> DataFrame:
    """Calendar columns used by the insight generators."""
    d = F.col(date)
    return df.withColumns({
        "day_of_week": F.date_format(d, "EEEE"),
        "hour": F.hour(d.cast("timestamp_ntz")),
        "month": F.month(d),
        "week_of_year": F.weekofyear(d),
        "year": F.year(d),
    })
