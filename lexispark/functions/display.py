"""How numbers are shown: counts, scores, durations, sizes, and the share of the best score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = ("B", "KB", "MB", "GB", "TB")


def grouped(value: Column) -> Column:
    """A count, with commas between its thousands."""
    return F.format_number(value, 0)


def shown_score(value: Column) -> Column:
    """A score, to four decimals."""
    return F.format_string("%.4f", value.cast("double"))


def shown_millis(value: Column) -> Column:
    """A duration: tenths of milliseconds below 10, whole ones below a second, else hundredths of seconds."""
    return (
        F.when(value < 10, F.format_string("%.1f ms", value.cast("double")))
        .when(value < 1000, F.format_string("%d ms", F.floor(value + F.lit(0.5)).cast("long")))
        .otherwise(F.format_string("%.2f s", value / 1000))
    )


def shown_bytes(value: Column) -> Column:
    """A size in the unit that leaves it below 1024; a tenth is shown below 10 of any unit but bytes.

    Halves go to the even digit, as in C and SQL; "%.1f" of Java would show 1.25 as 1.3.
    """
    out = F.format_string("%d B", value.cast("long"))
    for power, unit in enumerate(_UNITS[1:], 1):
        scaled = value.cast("double") / float(1 << 10 * power)
        text = F.when(scaled < 10, F.format_string(f"%.1f {unit}", F.bround(scaled, 1))).otherwise(F.format_string(f"%.0f {unit}", F.bround(scaled, 0)))
        out = F.when(value >= 1 << 10 * power, text).otherwise(out)
    return out


def score_share(value: Column, best: Column) -> Column:
    """A score's share of the best, from 0.02 to 1; 0 where there is no best."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite(value) & finite(best) & (best > 0), F.greatest(F.lit(0.02), F.least(F.lit(1.0), value.cast("double") / best.cast("double")))).otherwise(F.lit(0.0))
