"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_FIRST = "dd-MM-yyyy"


def parse_day_first(text: Column) -> Column:
    """Day-first date text to DATE; text that is no date gives NULL."""
    return F.try_to_date(text, DAY_FIRST)


def iso_text(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def month_start(d: Column) -> Column:
    return F.trunc(d, "MM")


def month_end(d: Column) -> Column:
    return F.last_day(d)


def with_calendar(df: DataFrame, date_col: str) -> DataFrame:
    """Month and DayOfYear."""
    d = F.col(date_col)
    return df.withColumns({"Month": F.month(d), "DayOfYear": F.dayofyear(d)})


def with_date_parts(df: DataFrame, date_col: str) -> DataFrame:
    d = F.col(date_col)
    return df.withColumns(
        {
            f"{date_col}_year": F.year(d),
            f"{date_col}_month": F.month(d),
            f"{date_col}_day": F.dayofmonth(d),
        }
    )


def micros(ts: Column) -> Column:
    """Instant as whole microseconds; dates count from midnight (session in UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def time_distance(a: Column, b: Column) -> Column:
    """Absolute difference of two instants in microseconds."""
    return F.abs(micros(a) - micros(b))
