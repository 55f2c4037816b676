"""Date thresholds."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The query's base date and its day count.
BASE = date(1998, 12, 1)
DELTA_DAYS = 90


def cutoff(base: date = BASE, days: int = DELTA_DAYS) -> date:
    return base - timedelta(days=days)


def cutoff_column(base: date = BASE, days: int = DELTA_DAYS) -> Column:
    """The same inside a plan, folded to a literal by the optimizer."""
    return F.date_sub(F.lit(base), days)
