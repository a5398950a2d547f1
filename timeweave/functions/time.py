"""Clock texts and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timeweave.functions.text import strip


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Seconds that two intervals share."""
    return F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))


def clock(seconds: Column, separator: str) -> Column:
    """``HH:MM:SS<sep>mmm``; null, negative and not-a-number read as 0, hours have no bound."""
    fine = F.when(seconds.isNull() | F.isnan(seconds) | (seconds < 0), F.lit(0.0)).otherwise(seconds)
    ms = F.round(fine * 1000).cast("long")
    return F.format_string(f"%02d:%02d:%02d{separator}%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def stamp(seconds: Column) -> Column:
    """``MM:SS``, from an hour on ``H:MM:SS``; ``--:--`` for null, negative or infinite."""
    whole = F.floor(seconds)
    bad = seconds.isNull() | F.isnan(seconds) | (seconds < 0) | (seconds == float("inf"))
    long_ = F.format_string("%d:%02d:%02d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60)
    short = F.format_string("%02d:%02d", F.floor(whole / 60), whole % 60)
    return F.when(bad, "--:--").when(whole >= 3600, long_).otherwise(short)


def parse_stamp(text: Column) -> Column:
    """Seconds of one to three numbers with colons between, else null."""
    parts = F.split(strip(text), ":")
    numbers = F.transform(parts, lambda p: F.when(p.rlike(r"^\s*\d+(\.\d+)?\s*$"), strip(p).try_cast("double")))
    total = F.aggregate(numbers, F.lit(0.0), lambda a, x: a * 60 + x)
    return F.when(F.size(parts) <= 3, total)


def in_window(start: Column, end: Column, low: float | None, high: float | None) -> Column:
    """Contact with a window counts; an open end has no bound."""
    if low is not None and high is not None and low > high:
        raise ValueError("the window ends before it starts")
    kept = F.lit(True)
    if low is not None:
        kept = kept & (end >= low)
    if high is not None:
        kept = kept & (start <= high)
    return kept
