"""Recurring days, times and structured readings of dates, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora_spark.functions.dates import _day, roll_forward, weekday_on_or_after
from agora_spark.functions.told import endless, let, read, recurring_weekdays, told_day, weekday_in

# Fixed value: a time is hours, then minutes after a colon or an h, then am or pm.
CLOCK = r"(\d{1,2})(?::(\d{2})|h(\d{2})?)?\s*(am|pm)?"


def next_of(day: Column, weekdays: Column) -> Column:
    """The first day from `day` on whose weekday is one of these."""
    return F.array_min(F.transform(weekdays, lambda w: weekday_on_or_after(day, w)))


def clocks(text: Column) -> Column:
    """array<struct<hour, minute>> of the times in a text, in order; impossible ones are skipped."""
    part = lambda k: F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(CLOCK), F.lit(k))
    hours, colon, after_h, half = (part(k) for k in (1, 2, 3, 4))

    def one(h: Column, i: Column) -> Column:
        hour = h.cast("int")
        minute = F.coalesce(F.nullif(F.get(colon, i), F.lit("")), F.nullif(F.get(after_h, i), F.lit("")), F.lit("0")).cast("int")
        turned = F.when((F.get(half, i) == "pm") & (hour < 12), hour + 12).when((F.get(half, i) == "am") & (hour == 12), 0).otherwise(hour)
        return F.struct(turned.alias("hour"), minute.alias("minute"))

    return F.filter(F.transform(hours, one), lambda t: (t["hour"] <= 23) & (t["minute"] <= 59))


def read_interpretation(reading: Column, anchor: Column, grace_days: int = 60) -> Column:
    """struct<day, reason, inferred, ranged> of a structured reading (kind, relative, day, month, year, weekday), seen from the anchor.

    Kinds: relative, day_month, day_month_year, range (day is its first), weekday, weekday_day. What is
    malformed or not in the calendar gives a null day.
    """
    kind, day, month = reading["kind"], reading["day"], reading["month"]
    relative = F.when(reading["relative"] == "hoje", anchor).when(reading["relative"] == "amanha", F.date_add(anchor, 1))
    real = day.between(1, 31) & month.between(1, 12)
    stated = _day(reading["year"], month, day)
    this = _day(F.year(anchor), month, day)
    rolled = F.when(this.isNotNull(), roll_forward(this, anchor, grace_days))
    weekday = let(read(reading["weekday"]), lambda r: F.when(r["classes"].rlike("^w(?:Pq)?$"), weekday_in(F.get(r["tokens"], F.lit(0)))))
    # The day of a month: the first month from the anchor's on that has it at or after the anchor; four months always hold one.
    months = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.add_months(F.trunc(anchor, "month"), i))
    coming = F.array_min(F.filter(F.transform(months, lambda m: _day(F.year(m), F.month(m), day)), lambda d: d >= anchor))
    found = (
        F.when(kind == "relative", F.struct(relative.alias("day"), F.lit(False).alias("inferred")))
        .when((kind == "day_month_year") & reading["year"].isNotNull() & real, F.struct(stated.alias("day"), F.lit(False).alias("inferred")))
        .when(kind.isin("day_month", "day_month_year", "range") & real, F.struct(rolled["day"].alias("day"), F.coalesce(rolled["inferred"], F.lit(False)).alias("inferred")))
        .when((kind == "weekday") & weekday.isNotNull(), F.struct(weekday_on_or_after(anchor, weekday).alias("day"), F.lit(False).alias("inferred")))
        .when((kind == "weekday_day") & weekday.isNotNull() & day.between(1, 31), F.struct(coming.alias("day"), F.lit(False).alias("inferred")))
    )
    reason = F.when((kind == "weekday_day") & (F.weekday(found["day"]) != weekday), "weekday_mismatch")
    return F.struct(found["day"].alias("day"), reason.alias("reason"), F.coalesce(found["inferred"], F.lit(False)).alias("inferred"), (kind == "range").alias("ranged"))


def reusable(fresh_text: Column, fresh: Column, stored_text: Column, stored: Column) -> Column:
    """The stored reading if the text is the same to the letter, else the fresh one."""
    return F.when((fresh_text == stored_text) & stored.isNotNull(), stored).otherwise(fresh)


def resolve(rows: DataFrame, date_text: Column, time_text: Column, posted: Column, is_recurring: Column, recurrence_text: Column, reading: Column, grace_days: int = 60) -> DataFrame:
    """rows with starts_at, ends_at (local time), recurring, reason, year_inferred, date_range, time_known, needs_review and source, seen from the day of the post.

    A told date decides; for a recurring event without one the next of its weekdays; else the structured
    reading. A weekday beside a told date only confirms it, or is flagged; so is a year that had to be
    chosen, and a span of days of which the first counts. Without a time the clock is midnight; an end
    that is not after the start is on the next day. An endless cadence needs no date.
    """
    claimed = F.coalesce(is_recurring, F.lit(False))
    # In steps, each a column of its own, so that no expression is repeated inside another.
    out = rows.withColumns({"_weekdays": recurring_weekdays(date_text, is_recurring, recurrence_text), "_told": told_day(date_text, posted, grace_days), "_read": read_interpretation(reading, posted, grace_days), "_times": clocks(time_text), "_endless": claimed & (endless(date_text) | endless(recurrence_text)), "_posted": posted})
    recurs, told, said = F.col("_weekdays").isNotNull(), F.col("_told.day").isNotNull(), F.col("_read.day").isNotNull()
    none = lambda kind: F.lit(None).cast(kind)
    made = lambda day, reason, inferred, ranged, source: F.struct(day.alias("day"), reason.alias("reason"), inferred.alias("inferred"), ranged.alias("ranged"), source.alias("source"))
    no = F.lit(False)
    chosen = (
        F.when(told, made(F.col("_told.day"), F.col("_told.reason"), F.col("_told.inferred"), F.col("_told.ranged"), F.lit("deterministic")))
        .when(recurs, made(next_of(F.col("_posted"), F.col("_weekdays")), none("string"), no, no, F.lit("deterministic")))
        .when(said, made(F.col("_read.day"), F.col("_read.reason"), F.col("_read.inferred"), F.col("_read.ranged"), F.lit("structured_fallback")))
        .when(F.col("_endless"), made(none("date"), none("string"), no, no, F.lit("unresolved")))
        .otherwise(made(none("date"), F.lit("missing_date"), no, F.col("_told.ranged"), F.lit("unresolved")))
    )
    out = out.withColumn("_c", chosen)
    day, start, end = F.col("_c.day"), F.get("_times", F.lit(0)), F.get("_times", F.lit(1))
    at = lambda d, t: F.when(d.isNotNull(), F.make_timestamp_ntz(F.year(d), F.month(d), F.dayofmonth(d), F.coalesce(t["hour"], F.lit(0)), F.coalesce(t["minute"], F.lit(0)), F.lit(0)))
    later = (end["hour"] * 60 + end["minute"]) <= (start["hour"] * 60 + start["minute"])
    out = out.withColumns({
        "starts_at": at(day, start), "ends_at": F.when(end.isNotNull(), at(F.date_add(day, F.when(later, 1).otherwise(0)), end)), "recurring": recurs | (day.isNull() & F.col("_endless")), "reason": F.col("_c.reason"), "year_inferred": F.col("_c.inferred"), "date_range": F.col("_c.ranged"),
        "time_known": day.isNotNull() & start.isNotNull(), "needs_review": F.col("_c.reason").isNotNull() | F.col("_c.inferred"), "source": F.col("_c.source"),
    })
    return out.drop("_weekdays", "_told", "_read", "_times", "_endless", "_posted", "_c")
