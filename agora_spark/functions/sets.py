"""Verdicts on pairs of token sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agora_spark.functions.dates import local_day, micros


def band(a: Column, b: Column) -> Column:
    """auto if one set is within the other, suggest if they overlap, else refuse; empty sets refuse."""
    some = (F.size(a) > 0) & (F.size(b) > 0)
    within = (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)
    return F.when(some & within, "auto").when(some & F.arrays_overlap(a, b), "suggest").otherwise("refuse")


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def in_window(a: Column, b: Column, hours: int = 8) -> Column:
    """The same local day, or at most so many hours apart; a missing side is never in."""
    near = F.abs(micros(a) - micros(b)) <= hours * 3_600_000_000
    return F.coalesce((local_day(a) == local_day(b)) | near, F.lit(False))
