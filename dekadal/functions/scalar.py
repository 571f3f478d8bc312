"""Column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Normal quantile of 0.975.
Z_95 = 1.959963984540054
# Classes of change by (current, worst, average, best).
CHANGE_CLASSES = {
    (0, 0, 0, 0): "no_change_dry",
    (1, 1, 1, 1): "no_change_flooded",
    (1, 0, 0, 0): "very_likely_decrease",
    (1, 1, 0, 0): "likely_decrease",
    (1, 1, 1, 0): "possible_decrease",
    (0, 1, 1, 1): "very_likely_increase",
    (0, 1, 1, 0): "likely_increase",
    (0, 1, 0, 0): "possible_increase",
}


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def round4(c: Column) -> Column:
    """Half to even, four places."""
    return F.bround(c, 4)


def clip_zero(c: Column) -> Column:
    """Negative values become 0; null stays null."""
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def binarise(c: Column) -> Column:
    return (c > 0).cast("int")


def change_class(current: Column, worst: Column, average: Column, best: Column) -> Column:
    """One of eight classes; other combinations are unclassified."""
    key = current * 8 + worst * 4 + average * 2 + best
    out = None
    for bits, name in CHANGE_CLASSES.items():
        code = int("".join(map(str, bits)), 2)
        out = F.when(key == code, name) if out is None else out.when(key == code, name)
    return out.otherwise("unclassified")


def alert_message(as_of: Column, peak: Column, peak_date: Column, rise: Column, low: Column) -> Column:
    """One sentence with percentages of one place, rounded half to even."""
    pct = lambda c: F.translate(F.format_number(F.bround(c * 100, 1), 1), ",", "")
    return F.concat(
        F.lit("Alert of "), as_of.cast("string"), F.lit(": extent expected to reach "), pct(peak), F.lit("% by "), peak_date.cast("string"), F.lit(", a rise of "), pct(rise), F.lit("% above the season's minimum of "), pct(low), F.lit("%.")
    )
