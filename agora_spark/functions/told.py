"""Dates told in free text: one tokenizer, classes of tokens, and a grammar over the classes.

A text, unmarked and in lower case, becomes tokens: runs of digits, of letters, of blanks, and single
other characters. Each token has a class, one character, and the forms of dates are patterns over the
string of classes; where one fits, its numbers are looked up by place. The same classes tell recurring
weekdays and the form of a text. A form that fits has decided: if the calendar lacks its day there is
no day, and no other form is tried.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from agora_spark.functions.dates import MONTH_NAMES, WEEKDAY_NAMES, _day, roll_forward, weekday_on_or_after
from agora_spark.functions.text import unmark

# Abbreviated months, words that mark a recurrence, and phrases of a daily, a weekend and an endless cadence, unmarked.
SHORT_MONTHS = ("jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez")
EVERY = ("toda", "todo", "todas", "todos")
DAILY = r"\btodo\s+santo\s+dia\b|\btodos?\s+os\s+dias\b|\bdiariamente\b|\btodo\s+dia\b"
WEEKEND = r"\btodo\s+final\s+de\s+semana\b|\btodo\s+fim\s+de\s+semana\b|\bfins?\s+de\s+semana\b"
ENDLESS = r"\btoda\s+semana\b|\bsempre\b"

TOKEN = r"[0-9]+|[\p{L}_]+|\s+|[^0-9\p{L}_\s]"
#: Classes of tokens that are words. n, N: one, two digits; Y: three or four; X: more. b, f: short, full month. w: weekday, v: its
#: plural, u: a word with a weekday in it. r: today or tomorrow. t: every. d, a, e, q: de, a, e, feira. o: any other word.
#: Others: S: blanks, P: one of / . -, C: comma, Z: the rest.
WORD = "[nNYXbfwvurtdaeqo]"
BEFORE, AFTER, DAY = f"(?<!{WORD})", f"(?!{WORD})", "[nN]"
NUMERIC = f"{DAY}P{DAY}(?:P[NY]{AFTER})?{AFTER}"
NAMED = f"{DAY}(?:S?dS?|S?PS?|S)?[bf]{AFTER}"
TURNED = f"{BEFORE}b(?:S?PS?|S){DAY}{AFTER}"
SPAN = f"{BEFORE}dS{DAY}SaS{DAY}S?[dP]S?[bf]{AFTER}"
LISTED = f"{BEFORE}{DAY}(?:S?[Ce]S?{DAY})*S?[Ce]S?(?={DAY}(?:S?[dP]|S))"
WEEK_SPAN = f"{BEFORE}dSw(?:Pq)?SaSw{AFTER}"
LONE = f"{BEFORE}{DAY}{AFTER}"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _class(token: Column) -> Column:
    size, any_weekday = F.char_length(token), token.rlike("|".join(WEEKDAY_NAMES))
    number = F.when(size == 1, "n").when(size == 2, "N").when(size <= 4, "Y").otherwise("X")
    word = (
        F.when(token.isin(*SHORT_MONTHS), "b").when(token.isin(*MONTH_NAMES), "f").when(token.isin(*WEEKDAY_NAMES), "w").when(token.isin(*(f"{w}s" for w in WEEKDAY_NAMES)), "v").when(any_weekday, "u")
        .when(token.isin("hoje", "amanha"), "r").when(token.isin(*EVERY), "t").when(token.isin("de", "a", "e"), F.left(token, F.lit(1))).when(token == "feira", "q").otherwise("o")
    )
    return F.when(token.rlike("^[0-9]"), number).when(token.rlike(r"^[\p{L}_]"), word).when(token.rlike(r"^\s"), "S").when(token.isin("/", ".", "-"), "P").when(token == ",", "C").otherwise("Z")


def read(text: Column) -> Column:
    """struct<low, tokens, classes> of a text; null is empty."""
    low = unmark(F.trim(F.coalesce(text, F.lit(""))))
    tokens = let(low, lambda t: F.struct(t.alias("low"), F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0)).alias("tokens")))
    return let(tokens, lambda r: F.struct(r["low"].alias("low"), r["tokens"].alias("tokens"), F.array_join(F.transform(r["tokens"], _class), "").alias("classes")))


def _at(classes: Column, pattern: str) -> Column:
    """Place of the first fit, from 1; 0 if there is none."""
    return F.regexp_instr(classes, F.lit(pattern))


def _fit(classes: Column, pattern: str) -> Column:
    """Length of the first fit."""
    return F.char_length(F.regexp_extract(classes, pattern, 0))


def weekday_in(token: Column) -> Column:
    """0 (Monday) to 6 of the first weekday that a token holds; null if none."""
    return F.nullif(F.array_position(F.lit(list(WEEKDAY_NAMES)), F.regexp_extract(token, "(" + "|".join(WEEKDAY_NAMES) + ")", 1)), F.lit(0)).cast("int") - 1


def _month(token: Column) -> Column:
    at = F.greatest(F.array_position(F.lit(list(MONTH_NAMES)), token), F.array_position(F.lit(list(SHORT_MONTHS)), token))
    return F.nullif(at.cast("int"), F.lit(0))


def first_weekday(r: Column) -> Column:
    """The first weekday that a text names in any way; null if none."""
    return weekday_in(F.get(r["tokens"], _at(r["classes"], "[wvu]") - 1))


def explicit(r: Column) -> Column:
    """struct<day, month, year, ranged> (numbers) of the first form of a date in a text of read(); null if no form fits.

    Forms, in this order: a span of days, a list of days before a date (of both the first day counts), a
    numeric date (day first), a day and a month's name, a short month and a day.
    """
    number = lambda k: F.get(r["tokens"], k - 1).cast("int")
    name = lambda k: _month(F.get(r["tokens"], k - 1))
    none = F.lit(None).cast("int")
    made = lambda day, month, year, ranged: F.struct(day.alias("day"), month.alias("month"), year.alias("year"), F.lit(ranged).alias("ranged"))
    year = lambda y: F.when(y < 100, y + 2000).otherwise(y)
    whole = r["classes"]

    def listed(start: Column) -> Column:
        def last(at: Column) -> Column:
            rest = F.substring(whole, at, F.char_length(whole))
            numeric, named = _fit(rest, "^" + NUMERIC), _fit(rest, "^" + NAMED)
            return F.when(numeric > 0, made(number(start), number(at + 2), F.when(numeric == 5, year(number(at + 4))), True)).when(named > 0, made(number(start), name(at + named - 1), none, True))

        return F.when(start > 0, let(start + _fit(whole, LISTED), last))

    span = let(_at(whole, SPAN), lambda at: F.when(at > 0, made(number(at + 2), name(at + _fit(whole, SPAN) - 1), none, True)))
    numeric = let(_at(whole, BEFORE + NUMERIC), lambda at: F.when(at > 0, made(number(at), number(at + 2), F.when(_fit(whole, BEFORE + NUMERIC) == 5, year(number(at + 4))), False)))
    named = let(_at(whole, BEFORE + NAMED), lambda at: F.when(at > 0, made(number(at), name(at + _fit(whole, BEFORE + NAMED) - 1), none, False)))
    turned = let(_at(whole, TURNED), lambda at: F.when(at > 0, made(number(at + _fit(whole, TURNED) - 1), name(at), none, False)))
    return F.coalesce(span, let(_at(whole, LISTED), listed), numeric, named, turned)


def told_day(text: Column, posted: Column, grace_days: int = 60) -> Column:
    """struct<day, reason, inferred, ranged, found> of a text, seen from the day it was posted.

    found: explicit, weekday, relative or none. Today and tomorrow decide if no digit and no weekday
    stands beside them. Then explicit dates decide, without a year by roll_forward(); a weekday beside
    one confirms it or is a weekday_mismatch. Then the next such weekday, but not beside a lone number
    of one or two digits, which might be a day. Then today and tomorrow beside other things.
    """

    def resolve(r: Column) -> Column:
        found = lambda day, kind: F.struct(day.alias("day"), F.lit(None).cast("string").alias("reason"), F.lit(False).alias("inferred"), F.lit(False).alias("ranged"), F.lit(kind).alias("found"))
        whole, weekday = r["classes"], first_weekday(r)
        relative = F.when(r["low"].rlike(r"\bhoje\b"), posted).when(r["low"].rlike(r"\bamanha\b"), F.date_add(posted, 1))
        alone = ~whole.rlike("[nNYXwvu]")

        def dated(x: Column) -> Column:
            this = _day(F.year(posted), x["month"], x["day"])
            rolled = F.when(x["year"].isNotNull(), F.struct(_day(x["year"], x["month"], x["day"]).alias("day"), F.lit(False).alias("inferred"))).when(this.isNotNull(), roll_forward(this, posted, grace_days))

            def flagged(d: Column) -> Column:
                reason = F.when(d["day"].isNotNull() & (F.weekday(d["day"]) != weekday), "weekday_mismatch")
                return F.struct(d["day"].alias("day"), reason.alias("reason"), F.coalesce(d["inferred"], F.lit(False)).alias("inferred"), x["ranged"].alias("ranged"), F.lit("explicit").alias("found"))

            return F.when(x.isNotNull(), let(rolled, flagged))

        guess = F.when(weekday.isNotNull(), F.when(whole.rlike(LONE), found(F.lit(None).cast("date"), "none")).otherwise(found(weekday_on_or_after(posted, weekday), "weekday")))
        return F.coalesce(F.when(alone & relative.isNotNull(), found(relative, "relative")), let(explicit(r), dated), guess, F.when(relative.isNotNull(), found(relative, "relative")), found(F.lit(None).cast("date"), "none"))

    return let(read(text), resolve)


def recurring_weekdays(date_text: Column, is_recurring: Column, recurrence_text: Column) -> Column:
    """array<int> of the weekdays (0: Monday) on which an event recurs, in order; null if it does not.

    'toda' or 'todo' and a weekday in the date's text always count. Daily and weekend cadences, ranges
    ('de sexta a domingo', over the week's end too) and lists count only if the event is said to recur,
    in the recurrence's text first.
    """
    week = F.sequence(F.lit(0), F.lit(6))

    def named(r: Column) -> Column:
        whole = r["classes"]

        def within(at: Column) -> Column:
            a, b = weekday_in(F.get(r["tokens"], at + 1)), weekday_in(F.get(r["tokens"], at + _fit(whole, WEEK_SPAN) - 2))
            return F.when(at > 0, F.filter(week, lambda d: F.when(b >= a, (d >= a) & (d <= b)).otherwise((d >= a) | (d <= b))))

        # A weekday or its plural, with no digit against it.
        alone = lambda i: F.substring(F.concat(F.lit("S"), whole, F.lit("S")), i + 1, F.lit(3)).rlike("^[^nNYX][wv][^nNYX]$")
        places = F.filter(F.transform(r["tokens"], lambda t, i: F.when(alone(i), weekday_in(t))), lambda d: d.isNotNull())
        days = F.array_sort(F.array_distinct(places))
        return F.when(r["low"].rlike(DAILY), week).when(r["low"].rlike(WEEKEND), F.array(F.lit(5), F.lit(6))).otherwise(F.coalesce(let(_at(whole, WEEK_SPAN), within), F.when(F.size(days) > 0, days)))

    def both(r: Column) -> Column:
        marked = F.when(r["classes"].rlike(f"{BEFORE}t{AFTER}") & first_weekday(r).isNotNull(), F.array(first_weekday(r)))
        return F.coalesce(marked, F.when(F.coalesce(is_recurring, F.lit(False)), F.coalesce(let(read(recurrence_text), named), named(r))))

    return let(read(date_text), both)


def endless(text: Column) -> Column:
    """Whether a text tells a cadence that has no day."""
    return unmark(F.coalesce(text, F.lit(""))).rlike(ENDLESS)


# The names of the forms of a date's text.
SHAPES = ("empty", "relative_hoje_amanha", "cadence_toda_semana_or_sempre", "cadence_daily_or_weekend", "cadence_todo_plus_weekday", "weekday_range_or_list", "range_de_x_a_y_de_mes", "range_comma_or_e_list", "numeric_dmy", "textual_month_name", "bare_weekday", "unrecognized")


def date_shape(text: Column) -> Column:
    """Which of twelve forms a date's text has; the first that fits counts."""

    def shape(r: Column) -> Column:
        whole = r["classes"]
        fits = (
            r["low"] == "", r["low"].rlike(r"\b(?:hoje|amanha)\b"), r["low"].rlike(ENDLESS), r["low"].rlike(DAILY + "|" + WEEKEND), whole.rlike(f"{BEFORE}t{AFTER}") & whole.rlike("[wvu]"), whole.rlike(WEEK_SPAN),
            whole.rlike(SPAN), whole.rlike(LISTED), whole.rlike(BEFORE + NUMERIC), whole.rlike(f"{BEFORE}{NAMED}|{TURNED}"), whole.rlike("[wvu]"), F.lit(True),
        )
        return F.coalesce(*(F.when(fit, F.lit(name)) for fit, name in zip(fits, SHAPES)))

    return let(read(text), shape)
