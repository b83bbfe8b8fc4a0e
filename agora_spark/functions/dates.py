"""Local days, freshness and calendar arithmetic; the time is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/Recife"


def micros(ts: Column) -> Column:
    """Microseconds of the epoch; zoneless timestamps are UTC (the session's zone)."""
    return F.unix_micros(ts.cast("timestamp"))


def local_day(ts: Column) -> Column:
    """The calendar day in ZONE of a UTC timestamp."""
    return F.to_date(F.from_utc_timestamp(ts, ZONE))


def parse_gmttime(raw: Column) -> Column:
    """ISO 8601, or a display form with a weekday before the date; anything else is null."""
    text = F.trim(raw)
    shown = F.regexp_replace(text, r"^[A-Za-z]+,?\s+", "")
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(shown, F.lit("yyyy-MM-dd hh:mm a")), F.try_to_timestamp(shown, F.lit("yyyy-MM-dd HH:mm")))


def freshness(generated: Column, now: Column, max_minutes: int) -> Column:
    """fresh, stale (the boundary is stale) or unparseable."""
    age = micros(now) - micros(generated)
    return F.when(generated.isNull(), "unparseable").when(age < max_minutes * 60_000_000, "fresh").otherwise("stale")


def max_age_minutes(refresh_minutes: int | None, default: int = 5, factor: float = 2.0, least: int = 5) -> int:
    """The freshness window of a refresh interval; an interval outside 1..120 counts as the default."""
    interval = refresh_minutes if refresh_minutes is not None and 1 <= refresh_minutes <= 120 else default
    return max(least, round(factor * interval))


def hours_text(spans: Column, grid: Column) -> Column:
    """Opening hours of a day from its spans (opens, opens_minutes, closes, closes_minutes) and its 24 busyness values.

    Several spans are joined with commas. Without any, a day with some busyness is open at unknown times, else closed.
    """
    clock = lambda h, m: F.format_string("%02d:%02d", h, F.coalesce(m, F.lit(0)))
    said = F.transform(spans, lambda p: F.concat(clock(p["opens"], p["opens_minutes"]), F.lit("-"), clock(p["closes"], p["closes_minutes"])))
    busy = F.coalesce(F.exists(grid, lambda v: v > 0), F.lit(False))
    return F.when(F.coalesce(F.size(spans), F.lit(0)) > 0, F.array_join(said, ", ")).when(busy, "unavailable").otherwise("closed")


def weekday_on_or_after(day: Column, weekday: Column) -> Column:
    """The first day from `day` on with a weekday (0: Monday)."""
    return F.date_add(day, F.pmod(weekday - F.weekday(day), F.lit(7)).cast("int"))


def roll_forward(candidate: Column, anchor: Column, grace_days: int = 60) -> Column:
    """struct<day, inferred>: a day before the anchor by more than the grace moves to the next year, if it exists there."""
    moved = F.try_to_date(F.concat((F.year(candidate) + 1).cast("string"), F.date_format(candidate, "-MM-dd")), "yyyy-MM-dd")
    near = F.datediff(anchor, candidate) <= grace_days
    day = F.when((candidate >= anchor) | near, candidate).otherwise(moved)
    return F.struct(day.alias("day"), (day.isNotNull() & (candidate < anchor)).alias("inferred"))


#: Month and weekday names, unmarked, in calendar order.
MONTH_NAMES = ("janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")
WEEKDAY_NAMES = ("segunda", "terca", "quarta", "quinta", "sexta", "sabado", "domingo")


def _day(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where the calendar has none."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int")), "yyyy-MM-dd")


def stated_clock(text: Column) -> Column:
    """The first time of day with an h or a colon in a text, as HH:MM; null if there is none."""
    part = lambda k: F.nullif(F.regexp_extract(F.lower(F.coalesce(text, F.lit(""))), r"(?<![\d/.:])([01]?\d|2[0-3])(?:h([0-5]\d)?|:([0-5]\d))(?![\d/])", k), F.lit(""))
    return F.when(part(1).isNotNull(), F.format_string("%02d:%02d", part(1).cast("int"), F.coalesce(part(2), part(3), F.lit("0")).cast("int")))
