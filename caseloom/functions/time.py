"""Time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
# Fixed value: Monday to Friday, 7:00 to 17:00, in seconds from Monday's midnight.
WORK_SLOTS = tuple((d * DAY + 7 * 3600, d * DAY + 17 * 3600) for d in range(5))


def business_seconds(start_us: Column, end_us: Column, slots: tuple[tuple[int, int], ...] = WORK_SLOTS) -> Column:
    """Seconds of work slots between two times in microseconds, in closed form: slots in whole weeks and parts of the last."""
    week = 7 * DAY
    monday = 4 * DAY  # 1970-01-05 was a Monday

    def upto(us: Column) -> Column:
        s = us / 1e6 - monday
        weeks = F.floor(s / week)
        inside = s - weeks * week
        part = F.lit(0.0)
        for a, b in slots:
            part = part + F.least(F.greatest(inside - a, F.lit(0.0)), F.lit(float(b - a)))
        return weeks * float(sum(b - a for a, b in slots)) + part

    return F.greatest(upto(end_us) - upto(start_us), F.lit(0.0))
