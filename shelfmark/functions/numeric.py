"""Scores, bonuses and retry delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Retry delay base and ceiling in seconds, doubling steps, popularity bonus ceiling.
BACKOFF_BASE = 30
BACKOFF_CEILING = 3600
BACKOFF_DOUBLINGS = 6
POPULARITY_CEILING = 0.025
SCORE_CEILING = 0.99


def backoff_seconds(attempts: Column) -> Column:
    """Delay before the next try after ``attempts`` counted failures."""
    step = F.least(F.greatest(attempts.cast("int") - 1, F.lit(0)), F.lit(BACKOFF_DOUBLINGS))
    return F.least(
        F.lit(BACKOFF_CEILING).cast("bigint"), (F.lit(BACKOFF_BASE) * F.pow(F.lit(2), step)).cast("bigint")
    )


def popularity_bonus(popularity: Column) -> Column:
    known = F.greatest(F.coalesce(popularity, F.lit(0.0)), F.lit(0.0))
    return F.least(F.log1p(known) / 100, F.lit(POPULARITY_CEILING))


def clamp_score(score: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(score, F.lit(SCORE_CEILING))), 4)


def ratio(part: Column, whole: Column, places: int = 4) -> Column:
    """``part/whole`` rounded, null when there is nothing to divide by."""
    return F.when(whole > 0, F.round(part / whole, places))


def count_where(condition: Column) -> Column:
    """Conditional count that is 0, not null, over an empty input."""
    return F.count(F.when(condition, F.lit(1)))
