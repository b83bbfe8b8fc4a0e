"""Dates told in texts: forms by hand, and random mixtures against the rule in plain Python."""

import datetime as dt
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from agora_spark.functions import recurrence, told

POSTED = dt.date(2026, 9, 1)  # a Tuesday
D = lambda m, d, y=2026: dt.date(y, m, d)
#: A text; its day; mismatch, year inferred, several days.
CASES = [
    ("25-12", D(12, 25), "..."), ("5 set", D(9, 5), "..."), ("SET 05", D(9, 5), "..."), ("sexta 15", None, "..."), ("01, 02 e 03 de outubro", D(10, 1), "..r"), ("hoje, sexta", D(9, 4), "..."), ("Sábado 12/SET", D(9, 12), "..."), ("sábado • 08.Ago", D(8, 8), ".i."),
    ("É HOJE 🔥", D(9, 1), "..."), ("Amanhã", D(9, 2), "..."), ("amanha às 22h", D(9, 2), "..."), ("hoje às 22h", D(9, 1), "..."), ("hoje, 15/09", D(9, 15), "..."), ("este sábado", D(9, 5), "..."), ("terça", D(9, 1), "..."), ("segunda-feira", D(9, 7), "..."), ("sextas", D(9, 4), "..."),
    ("05/08", D(8, 5), ".i."), ("03/07", D(7, 3), ".i."), ("02/07", D(7, 2, 2027), ".i."), ("31/02", None, "..."), ("31/02 sexta", None, "..."), ("15/08/2027", D(8, 15, 2027), "..."), ("15.08.27", D(8, 15, 2027), "..."), ("1/10/3", D(10, 1), "..."), ("12/05/20245", D(5, 12, 2027), ".i."),
    ("25 de dezembro", D(12, 25), "..."), ("3outubro", D(10, 3), "..."), ("10 marco", D(3, 10, 2027), ".i."), ("quinta, 25 de dezembro", D(12, 25), "m.."), ("De 06 a 09 de outubro", D(10, 6), "..r"), ("de 06 a 09/out", D(10, 6), "..r"), ("05 e 06/10", D(10, 5), "..r"), ("30, 31 e 32/09", D(9, 30), "..r"), ("31, 1 e 2/02", None, "..r"),
    ("10, 11 pessoas", None, "..."), ("10 e 11", None, "..."), ("22h", None, "..."), ("em março", None, "..."), ("set", None, "..."), ("29/02", None, "..."), ("", None, "..."), (None, None, "..."), ("sábado 22h", D(9, 5), "..."), ("99/99", None, "..."), ("10e11/10", D(10, 10), "..r"), ("12/05h 13/10", D(10, 13), "..."),
]


def days(spark, texts, posted=POSTED):
    rows = spark.createDataFrame([(k, t, posted) for k, t in enumerate(texts)], "k long, t string, posted date")
    return [tuple(r)[1:] for r in sorted(rows.select("k", told.told_day(F.col("t"), F.col("posted")).alias("d")).select("k", "d.day", "d.reason", "d.inferred", "d.ranged").collect())]


def test_forms(spark):
    got = days(spark, [c[0] for c in CASES])
    for (text, day, flags), (g, reason, inferred, ranged) in zip(CASES, got):
        assert (text, g, reason, inferred, ranged) == (text, day, "weekday_mismatch" if "m" in flags else None, "i" in flags, "r" in flags)


WEEK = ["segunda", "terca", "quarta", "quinta", "sexta", "sabado", "domingo"]
FULL = ["janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"]
SHORT = [m[:3] for m in FULL]
MONTH = "(" + "|".join(FULL + SHORT) + r")\b"
LINK = r"(?:\s*de\s*|\s*[/.\-]\s*|\s+)?"


def plain(text, posted):
    """The rule over characters: (day, reason, inferred, ranged)."""
    t = "".join(c for c in unicodedata.normalize("NFD", (text or "").strip().lower()) if not unicodedata.combining(c))
    week = re.search("|".join(WEEK), t)
    weekday = WEEK.index(week[0]) if week else None
    relative = posted if re.search(r"\bhoje\b", t) else posted + dt.timedelta(1) if re.search(r"\bamanha\b", t) else None
    if relative and not week and not re.search(r"\d", t):
        return relative, None, False, False
    month = lambda w: SHORT.index(w[:3]) + 1
    found = None
    if m := re.search(r"\bde\s+(\d{1,2})\s+a\s+\d{1,2}\s*(?:de\s*|[/.\-]\s*)" + MONTH, t):
        found = int(m[1]), month(m[2]), None, True
    elif (m := re.search(r"\b(\d{1,2})(?:\s*[,e]\s*\d{1,2})*\s*[,e]\s*(?=\d{1,2}\s*(?:de|[/.\-]|\s))", t)) and (n := re.match(r"(\d{1,2})[/.\-](\d{1,2})(?:[/.\-](\d{2,4}))?\b", t[m.end() :]) or re.match(r"(\d{1,2})" + LINK + MONTH, t[m.end() :])):
        found = int(m[1]), int(n[2]) if n[2].isdigit() else month(n[2]), n[3] if n[2].isdigit() else None, True
    elif m := re.search(r"\b(\d{1,2})[/.\-](\d{1,2})(?:[/.\-](\d{2,4}))?\b", t):
        found = int(m[1]), int(m[2]), m[3], False
    elif m := re.search(r"\b(\d{1,2})" + LINK + MONTH, t):
        found = int(m[1]), month(m[2]), None, False
    elif m := re.search(r"\b(" + "|".join(SHORT) + r")(?:\s*[/.\-]\s*|\s+)(\d{1,2})\b", t):
        found = int(m[2]), month(m[1]), None, False
    if found:
        day, mon, year, ranged = found
        inferred = False
        try:
            if year:
                date = dt.date(int(year) + 2000 * (int(year) < 100), mon, day)
            else:
                date = dt.date(posted.year, mon, day)
                if date < posted:
                    inferred = True
                    if (posted - date).days > 60:
                        date = dt.date(posted.year + 1, mon, day)
        except ValueError:
            return None, None, False, ranged
        return date, "weekday_mismatch" if week and date.weekday() != weekday else None, inferred, ranged
    if week:
        return (None if re.search(r"\b\d{1,2}\b", t) else posted + dt.timedelta((weekday - posted.weekday()) % 7)), None, False, False
    return relative, None, False, False


def test_random_mixtures_equal_the_rule(spark):
    rng = random.Random(7)
    bits = ["1", "05", "12", "31", "2027", "26", "123", "/", ".", "-", ",", " e ", "e", " de ", "de ", " a ", "set", "SET ", "março", "Outubro", "maio", "sexta", "Sábados", "terça-feira", "hoje", "Amanhã", "h", " ", "  ", "às", "•", "x_1", "!"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(1, 9))) for _ in range(3000)]
    texts += [rng.choice(["", "sexta ", "de "]) + "".join(x + rng.choice([" ", "", " e ", ", ", "/", " de "]) for x in rng.choices(["5", "06", "10", "set", "maio", "a"], k=rng.randrange(2, 6))) for _ in range(3000)]
    for posted in (POSTED, dt.date(2028, 2, 29)):
        for text, got in zip(texts, days(spark, texts, posted)):
            assert (text, *got) == (text, *plain(text, posted))


@pytest.mark.parametrize(("date_text", "claimed", "recurrence_text", "want"), [("toda sexta", False, None, [4]), ("todas as terças-feiras", None, None, [1]), ("sextas e sábados", True, None, [4, 5]), ("sextas e sábados", False, None, None), ("de segunda a sexta-feira", True, None, [0, 1, 2, 3, 4]), ("12/05", True, "de sexta-feira a domingo", [4, 5, 6]), ("de sábado a segunda", True, None, [0, 5, 6]), ("todo dia", True, None, list(range(7))), ("x", True, "Todo fim de semana", [5, 6]), ("toda semana", True, None, None), (None, True, "quartas", [2]), ("toda", False, "domingo", None), ("sexta22", True, None, None), (None, None, None, None)])
def test_recurrence(spark, date_text, claimed, recurrence_text, want):
    text = lambda x: F.lit(x).cast("string")
    assert spark.range(1).select(told.recurring_weekdays(text(date_text), F.lit(claimed).cast("boolean"), text(recurrence_text)).alias("w")).first().w == want


def test_shapes(spark):
    cases = [("", "empty"), ("hoje às 22h", "relative_hoje_amanha"), ("Amanhã, 12/05", "relative_hoje_amanha"), ("toda semana", "cadence_toda_semana_or_sempre"), ("todo fim de semana", "cadence_daily_or_weekend"), ("todas as sextas", "cadence_todo_plus_weekday"), ("de segunda a sexta", "weekday_range_or_list"), ("de 10 a 12 de maio", "range_de_x_a_y_de_mes"), ("10, 11 e 12/05", "range_comma_or_e_list"), ("12.05.2024", "numeric_dmy"), ("12 de março", "textual_month_name"), ("mai 12", "textual_month_name"), ("sábado", "bare_weekday"), ("em breve", "unrecognized"), (None, "empty")]
    rows = spark.createDataFrame([(c[0],) for c in cases], "t string")
    assert [r.s for r in rows.coalesce(1).select(told.date_shape(F.col("t")).alias("s")).collect()] == [c[1] for c in cases]


def test_resolve_carries_all_flags(spark):
    rows = spark.createDataFrame([(1, "05/08", None, None), (2, "05 e 06/10", "22h", None), (3, "toda semana", None, True), (4, "nada", None, True), (5, "15/10", "00h", True)], "k long, d string, t string, r boolean").withColumn("posted", F.lit(POSTED))
    none = F.lit(None).cast("struct<kind: string, relative: string, day: int, month: int, year: int, weekday: string>")
    got = {r.k: r for r in recurrence.resolve(rows, F.col("d"), F.col("t"), F.col("posted"), F.col("r"), F.when(F.col("k") == 5, "todo dia"), none).collect()}
    assert (got[1].year_inferred, got[1].needs_review, got[1].reason, got[1].time_known) == (True, True, None, False)
    assert (got[2].date_range, got[2].needs_review, got[2].starts_at) == (True, False, dt.datetime(2026, 10, 5, 22))
    assert (got[3].recurring, got[3].reason, got[3].needs_review) == (True, None, False)
    assert (got[4].recurring, got[4].reason, got[4].needs_review) == (False, "missing_date", True)
    assert (got[5].recurring, got[5].starts_at, got[5].time_known) == (True, dt.datetime(2026, 10, 15), True)
