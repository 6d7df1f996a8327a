"""Values as people read them: numbers in German form, places on a colour scale."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def german_number(value: Column, places: int = 2) -> Column:
    """1234.5 as 1.234,50; null stays null."""
    return F.translate(F.format_number(value, places), ",.", ".,")


def intensity(value: Column, low: Column, high: Column) -> Column:
    """Place of a value between two bounds, 0 to 1; the middle where the bounds are equal, null without a value."""
    share = F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.5))
    return F.when(value.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)))


def run_id(now: datetime.datetime | None = None) -> str:
    """The UTC second as a name that sorts in time: 20260102T030405Z."""
    return (now or datetime.datetime.now(datetime.UTC)).astimezone(datetime.UTC).strftime("%Y%m%dT%H%M%SZ")
