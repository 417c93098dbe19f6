"""Date and time expressions. The current day is always passed in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layouts tried when a date arrives as text.
LOOSE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "dd/MM/yyyy",
    "dd-MM-yyyy",
    "yyyyMMdd",
)


def fiscal_context(day: Column) -> dict[str, Column]:
    """Quarter of the day, last closed quarter with its year, last closed year."""
    year, quarter = F.year(day), F.quarter(day)
    closed = F.add_months(day, -3)
    # Yearly reports of the year before count as complete from April on.
    closed_year = F.year(F.add_months(day, -15))
    columns = {
        "year": year,
        "quarter": quarter,
        "last_quarter": F.quarter(closed),
        "last_quarter_year": F.year(closed),
        "last_full_year": closed_year,
    }
    return {name: column.cast("long") for name, column in columns.items()}


def from_epoch_ms(millis: Column) -> Column:
    return F.timestamp_millis(millis)


def to_epoch_ms(time: Column) -> Column:
    return F.unix_millis(time.cast("timestamp"))


def loose_timestamp(text: Column, formats: Sequence[str] = LOOSE_FORMATS) -> Column:
    """First layout that parses, else null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def age_bucket(day: Column, today: Column) -> Column:
    """Today / Yesterday / Last 7 days / Older; a missing day counts as today."""
    age = F.datediff(today, F.coalesce(day, today))
    return (
        F.when(age == 0, "Today").when(age == 1, "Yesterday").when(age <= 7, "Last 7 days").otherwise("Older")
    )


def month_key(time: Column) -> Column:
    """Year and month as one integer, the partition key of time tables."""
    return (F.year(time) * 100 + F.month(time)).cast("int")
