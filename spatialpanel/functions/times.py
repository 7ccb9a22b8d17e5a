"""Zone-free time arithmetic: works alike on TIMESTAMP_NTZ and TIMESTAMP."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def day_number(ts: Column) -> Column:
    """Days since 1970-01-01 of the calendar day of ``ts``."""
    return F.unix_date(ts.cast("date"))


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 00:00 on the wall clock of ``ts``."""
    clock = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("bigint") * 1_000_000
    seconds = (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return day_number(ts).cast("bigint") * DAY_US + clock + seconds


def day_text(day: Column) -> Column:
    """YYYY-MM-DD of a day number."""
    return F.date_from_unix_date(day.cast("int")).cast("string")
