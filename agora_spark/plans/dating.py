"""Named queries on dates: recurrence, times, structured readings, and all of them together. Texts are made of many parts; the SQL states the rules over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agora_spark.functions import recurrence as R
from agora_spark.functions import rules
from agora_spark.functions import told as T
from agora_spark.plans.catalog import query
from agora_spark.sources import standins as S

def _sql(x: object) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def _pick(values: tuple, at: Column, kind: str) -> Column:
    return F.get(F.array(*(F.lit(v).cast(kind) for v in values)), at.cast("int"))


def _cases(values: tuple, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {_sql(v)}" for i, v in enumerate(values)) + " END"


# Texts of dates, made of a beginning, a date in one of thirteen forms, and an end, by the keys of orders.
DAYS = ("segunda", "terça", "quarta", "quinta", "sexta", "sábado", "domingo")
MONTHS = ("janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")
SHORT = tuple(m[:3].upper().replace("Ç", "C") for m in MONTHS)
BEGINS, ENDS = ("", "Sexta, ", "SÁBADO • ", "este domingo ", "É hoje! "), ("", " às 22h", " no Pina")
_ARRAY = lambda values: "[" + ", ".join(_sql(v) for v in values) + "]"
NOTICE = f"""notice AS (SELECT event_id, posted, {_ARRAY(BEGINS)}[k % 5 + 1] || CASE k // 5 % 13 WHEN 0 THEN printf('%02d/%02d', d, m) WHEN 1 THEN d || '-' || m WHEN 2 THEN printf('%02d.%02d.2025', d, m) WHEN 3 THEN d || '/' || m || '/26' WHEN 4 THEN d || ' de ' || full_m WHEN 5 THEN printf('%02d', d) || '/' || short_m WHEN 6 THEN short_m || ' ' || d
  WHEN 7 THEN d || ', ' || (d + 1) || ' e ' || (d + 2) || ' de ' || full_m WHEN 8 THEN d || ' e ' || (d + 1) || '/' || m WHEN 9 THEN 'De ' || d || ' a ' || (d + 3) || ' de ' || full_m WHEN 10 THEN '' WHEN 11 THEN 'amanhã' ELSE d::VARCHAR END || {_ARRAY(ENDS)}[k // 65 % 3 + 1] AS date_text
  FROM (SELECT o_orderkey AS event_id, o_orderdate::DATE AS posted, o_orderkey AS k, o_orderkey // 7 % 31 + 1 AS d, o_orderkey // 11 % 12 + 1 AS m, {_ARRAY(MONTHS)}[o_orderkey // 11 % 12 + 1] AS full_m, {_ARRAY(SHORT)}[o_orderkey // 11 % 12 + 1] AS short_m FROM orders))"""
_WEEK, _MONTH = "segunda|terca|quarta|quinta|sexta|sabado|domingo", "janeiro|fevereiro|marco|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro|jan|fev|mar|abr|mai|jun|jul|ago|set|out|nov|dez"
_M = lambda x: f"list_position({_ARRAY(tuple(_MONTH.split('|'))[12:])}, left({x}, 3))"
_SPAN, _NUMERIC = rf"\bde\s+(\d{{1,2}})\s+a\s+\d{{1,2}}\s*(?:de\s*|[/.\-]\s*)({_MONTH})\b", r"\b(\d{1,2})[/.\-](\d{1,2})(?:[/.\-](\d{2,4}))?\b"
_LIST = r"\b(\d{1,2})(?:\s*(?:,|e)\s*\d{1,2})*\s*(?:,|e)\s*\d{1,2}(?:[/.\-](\d{1,2})\b|(?:\s*de\s*|\s*[/.\-]\s*|\s+)" + f"({_MONTH})\\b)"
_NAMED, _TURNED = rf"\b(\d{{1,2}})(?:\s*de\s*|\s*[/.\-]\s*|\s+)?({_MONTH})\b", r"\b(jan|fev|mar|abr|mai|jun|jul|ago|set|out|nov|dez)(?:\s*[/.\-]\s*|\s+)(\d{1,2})\b"
_ROLL = "CASE WHEN this >= posted OR date_diff('day', this, posted) <= 60 THEN this ELSE try_strptime(printf('%04d-', year(posted) + 1) || strftime(this, '%m-%d'), '%Y-%m-%d')::DATE END"
_DATE = lambda y, m, d: f"try_strptime(printf('%04d-%02d-%02d', ({y})::INT, ({m})::INT, ({d})::INT), '%Y-%m-%d')::DATE"
#: What the rule makes of notices, written with regular expressions over the texts.
TOLD = rf"""{NOTICE}, low AS (SELECT *, strip_accents(lower(trim(date_text))) AS t FROM notice),
form AS (SELECT *, CASE WHEN regexp_matches(t, '\bhoje\b') THEN posted WHEN regexp_matches(t, '\bamanha\b') THEN posted + 1 END AS relative, list_position({_ARRAY(tuple(_WEEK.split('|')))}, nullif(regexp_extract(t, '{_WEEK}'), '')) - 1 AS weekday, regexp_matches(t, '\d') AS digits,
  CASE WHEN regexp_matches(t, '{_SPAN}') THEN 1 WHEN regexp_matches(t, '{_LIST}') THEN 2 WHEN regexp_matches(t, '{_NUMERIC}') THEN 3 WHEN regexp_matches(t, '{_NAMED}') THEN 4 WHEN regexp_matches(t, '{_TURNED}') THEN 5 ELSE 0 END AS form FROM low),
parts AS (SELECT *, nullif(CASE form WHEN 1 THEN regexp_extract(t, '{_SPAN}', 1) WHEN 2 THEN regexp_extract(t, '{_LIST}', 1) WHEN 3 THEN regexp_extract(t, '{_NUMERIC}', 1) WHEN 4 THEN regexp_extract(t, '{_NAMED}', 1) WHEN 5 THEN regexp_extract(t, '{_TURNED}', 2) END, '')::INT AS d,
  CASE form WHEN 1 THEN {_M(f"regexp_extract(t, '{_SPAN}', 2)")} WHEN 2 THEN coalesce(nullif(regexp_extract(t, '{_LIST}', 2), '')::INT, {_M(f"regexp_extract(t, '{_LIST}', 3)")}) WHEN 3 THEN regexp_extract(t, '{_NUMERIC}', 2)::INT WHEN 4 THEN {_M(f"regexp_extract(t, '{_NAMED}', 2)")} WHEN 5 THEN {_M(f"regexp_extract(t, '{_TURNED}', 1)")} END AS m,
  CASE WHEN form = 3 THEN nullif(regexp_extract(t, '{_NUMERIC}', 3), '')::INT END AS y FROM form),
dated AS (SELECT *, {_DATE('year(posted)', 'm', 'd')} AS this FROM parts),
told AS (SELECT *, CASE WHEN relative IS NOT NULL AND NOT digits AND weekday IS NULL THEN relative WHEN form > 0 THEN CASE WHEN y IS NOT NULL THEN {_DATE('CASE WHEN y < 100 THEN y + 2000 ELSE y END', 'm', 'd')} WHEN this IS NOT NULL THEN {_ROLL} END
  WHEN weekday IS NOT NULL THEN CASE WHEN NOT regexp_matches(t, '\b\d{{1,2}}\b') THEN posted + ((weekday - (isodow(posted) - 1) + 7) % 7)::INT END ELSE relative END AS day,
  form > 0 AND NOT (relative IS NOT NULL AND NOT digits AND weekday IS NULL) AS explicit FROM dated),
judged AS (SELECT *, CASE WHEN explicit AND isodow(day) - 1 <> weekday THEN 'weekday_mismatch' END AS told_reason, explicit AND y IS NULL AND day IS NOT NULL AND this < posted AS inferred, explicit AND form <= 2 AS ranged FROM told)"""


def _notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    d, m = F.floor(k / 7) % 31 + 1, F.floor(k / 11) % 12
    of = lambda values, at: _pick(values, at, "string")
    two = lambda x: F.format_string("%02d", x.cast("int"))
    full, short, n = of(MONTHS, m), of(SHORT, m), m + 1
    said = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    forms = (
        said(two(d), "/", two(n)), said(d, "-", n), said(two(d), ".", two(n), ".2025"), said(d, "/", n, "/26"), said(d, " de ", full), said(two(d), "/", short), said(short, " ", d), said(d, ", ", d + 1, " e ", d + 2, " de ", full),
        said(d, " e ", d + 1, "/", n), said("De ", d, " a ", d + 3, " de ", full), F.lit(""), F.lit("amanhã"), said(d),
    )
    text = F.concat(of(BEGINS, k % 5), F.get(F.array(*forms), (F.floor(k / 5) % 13).cast("int")), of(ENDS, F.floor(k / 65) % 3))
    return S.read(spark, sf_dir, "orders").select(k.alias("event_id"), F.to_date("o_orderdate").alias("posted"), text.alias("date_text"))


@query(f"WITH {TOLD} SELECT event_id, day, told_reason AS reason, inferred, ranged FROM judged")
def told_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days that texts tell, seen from the day of their post."""
    return _notices(spark, sf_dir).withColumn("t", T.told_day(F.col("date_text"), F.col("posted"))).select("event_id", "t.day", "t.reason", "t.inferred", "t.ranged")


@query(rf"WITH {NOTICE}, low AS (SELECT strip_accents(lower(trim(date_text))) AS t FROM notice) SELECT CASE WHEN t = '' THEN 'empty' WHEN regexp_matches(t, '\bhoje\b|\bamanha\b') THEN 'relative_hoje_amanha' WHEN regexp_matches(t, '{_SPAN}') THEN 'range_de_x_a_y_de_mes' WHEN regexp_matches(t, '{_LIST}') THEN 'range_comma_or_e_list' WHEN regexp_matches(t, '{_NUMERIC}') THEN 'numeric_dmy' WHEN regexp_matches(t, '{_NAMED}|{_TURNED}') THEN 'textual_month_name' WHEN regexp_matches(t, '{_WEEK}') THEN 'bare_weekday' ELSE 'unrecognized' END AS shape, count(*) AS events FROM low GROUP BY 1")
def date_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts of dates have which form."""
    return _notices(spark, sf_dir).groupBy(T.date_shape(F.col("date_text")).alias("shape")).agg(F.count("*").alias("events"))


@query(f"""WITH c AS (SELECT o_orderkey AS event_id, o_orderkey % 6 AS form, o_orderkey // 6 % 7 AS a, o_orderkey // 42 % 7 AS b, o_orderkey % 4 <> 0 AS recurs FROM orders)
SELECT event_id, array_to_string(CASE WHEN form = 0 THEN [a] WHEN NOT recurs THEN NULL WHEN form = 1 THEN list_sort(list_distinct([a, b])) WHEN form = 2 THEN CASE WHEN a <= b THEN range(a, b + 1) ELSE list_concat(range(0, b + 1), range(a, 7)) END WHEN form = 3 THEN range(0, 7) WHEN form = 4 THEN [5, 6] END, ',') AS weekdays FROM c""")
def recurring_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekdays that texts make events recur on: a marked one, a list, a span, all days, weekends, or none that can be told."""
    k = F.col("o_orderkey")
    a, b = (_pick(DAYS, F.floor(k / n) % 7, "string") for n in (6, 42))
    text = F.get(F.array(F.concat(F.lit("TODA "), a), F.concat(a, F.lit("s e "), b, F.lit("s")), F.concat(F.lit("de "), F.upper(a), F.lit(" a "), b), F.lit("todo  dia"), F.lit("Todo fim de semana"), F.lit("toda semana")), (k % 6).cast("int"))
    own = k % 2 == 0  # else it is the recurrence's text
    days = T.recurring_weekdays(F.when(own | (k % 6 == 0), text).otherwise("12/05"), k % 4 != 0, F.when(~own, text))
    return S.read(spark, sf_dir, "orders").select(k.alias("event_id"), F.array_join(days, ",").alias("weekdays"))


CLOCKS = """clock AS (SELECT o_orderkey AS event_id, o_orderkey % 6 AS form, o_orderkey // 6 % 27 AS h, o_orderkey // 13 % 60 AS m, o_orderkey // 5 % 24 AS h2 FROM orders),
times AS (SELECT event_id, list_filter(CASE form WHEN 0 THEN [[h, 0]] WHEN 1 THEN [[h, m], [h2, 0]] WHEN 2 THEN [[h, m], [h2, m]] WHEN 3 THEN [[CASE WHEN h < 12 THEN h + 12 ELSE h END, 0]] WHEN 4 THEN [[CASE WHEN h = 12 THEN 0 ELSE h END, m]] ELSE [] END, lambda x: x[1] <= 23) AS c FROM clock)"""


def _times(key: Column) -> Column:
    """Texts of times, by keys."""
    h, m, h2 = F.floor(key / 6) % 27, F.floor(key / 13) % 60, F.floor(key / 5) % 24
    two = lambda x: F.format_string("%02d", x.cast("int"))
    return F.get(F.array(F.concat(h, F.lit("h")), F.concat(h, F.lit("h"), two(m), F.lit(" às "), h2, F.lit("H")), F.concat(F.lit("das "), two(h), F.lit(":"), two(m), F.lit(" até "), h2, F.lit("h"), two(m)), F.concat(h, F.lit(" PM")), F.concat(h, F.lit(":"), two(m), F.lit("am")), F.lit("em breve")), (key % 6).cast("int"))


@query(f"WITH {CLOCKS} SELECT event_id, printf('%02d:%02d', c[1][1], c[1][2]) AS starts, printf('%02d:%02d', c[2][1], c[2][2]) AS ends FROM times".replace("printf('%02d:%02d', c[1][1], c[1][2])", "CASE WHEN len(c) > 0 THEN printf('%02d:%02d', c[1][1], c[1][2]) END").replace("printf('%02d:%02d', c[2][1], c[2][2])", "CASE WHEN len(c) > 1 THEN printf('%02d:%02d', c[2][1], c[2][2]) END"))
def told_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the second time that a text tells."""
    times = R.clocks(_times(F.col("o_orderkey")))
    say = lambda t: F.when(t.isNotNull(), F.format_string("%02d:%02d", t["hour"], t["minute"]))
    return S.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), say(F.get(times, F.lit(0))).alias("starts"), say(F.get(times, F.lit(1))).alias("ends"))


NEXT = "(d + ((4 - (isodow(d) - 1) + 7) % 7)::INT)"
READINGS = f"""reading AS (SELECT o_orderkey AS event_id, o_orderdate::DATE AS d, o_orderkey % 7 AS kind, (o_orderkey % 31 + 1)::INT AS day, (o_orderkey // 7 % 12 + 1)::INT AS month FROM orders),
told AS (SELECT *, try_strptime(printf('%04d-%02d-%02d', year(d), month, day), '%Y-%m-%d')::DATE AS this, try_strptime(printf('%04d-%02d-%02d', year(d) + 1, month, day), '%Y-%m-%d')::DATE AS following FROM reading),
rolled AS (SELECT *, CASE WHEN this IS NULL THEN NULL WHEN this >= d OR date_diff('day', this, d) <= 60 THEN this ELSE following END AS roll FROM told),
meant AS (SELECT *, CASE kind WHEN 0 THEN d WHEN 1 THEN d + 1 WHEN 2 THEN roll WHEN 3 THEN try_strptime(printf('%04d-%02d-%02d', 2031, month, day), '%Y-%m-%d')::DATE WHEN 4 THEN roll WHEN 5 THEN {NEXT}
  WHEN 6 THEN (SELECT min(x) FROM (SELECT try_strptime(strftime(date_trunc('month', d) + to_months(i::INT), '%Y-%m-') || printf('%02d', day), '%Y-%m-%d')::DATE AS x FROM range(5) r(i)) WHERE x >= d) END AS meant FROM rolled)"""


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    kinds = ("relative", "relative", "day_month", "day_month_year", "range", "weekday", "weekday_day")
    reading = F.struct(_pick(kinds, k % 7, "string").alias("kind"), F.when(k % 7 == 0, "hoje").otherwise("amanha").alias("relative"), (k % 31 + 1).cast("int").alias("day"), (F.floor(k / 7) % 12 + 1).cast("int").alias("month"), F.lit(2031).alias("year"), F.lit("Sexta-feira").alias("weekday"))
    return S.read(spark, sf_dir, "orders").select(k.alias("event_id"), F.to_date("o_orderdate").alias("posted"), reading.alias("reading"))


@query(f"WITH {READINGS} SELECT event_id, meant AS day, CASE WHEN kind = 6 AND isodow(meant) <> 5 THEN 'weekday_mismatch' END AS reason, kind IN (2, 4) AND meant IS NOT NULL AND this < d AS inferred FROM meant")
def structured_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of readings that a model has put into fields."""
    rows = _readings(spark, sf_dir).withColumn("r", R.read_interpretation(F.col("reading"), F.col("posted")))
    return rows.select("event_id", "r.day", "r.reason", "r.inferred")


@query(f"""WITH {TOLD}, {READINGS.replace('told AS', 'told_r AS').replace('FROM told)', 'FROM told_r)')}, {CLOCKS}, x AS (SELECT j.event_id, j.posted, CASE WHEN j.event_id % 8 <> 0 THEN j.day END AS told, CASE WHEN j.event_id % 8 <> 0 THEN j.told_reason END AS told_reason, j.event_id % 8 <> 0 AND j.inferred AS told_inferred, j.event_id % 8 <> 0 AND j.ranged AS told_ranged, j.event_id % 3 = 0 AND j.event_id % 5 = 0 AS weekends, CASE WHEN j.event_id % 3 = 0 AND j.event_id % 5 <> 0 AND j.event_id % 8 <> 0 THEN j.weekday END AS named,
  j.event_id % 3 = 0 AND j.event_id % 5 = 1 AS endless, CASE WHEN j.event_id % 2 = 0 THEN r.meant END AS meant, CASE WHEN r.kind = 6 AND isodow(r.meant) <> 5 THEN 'weekday_mismatch' END AS read_reason, r.kind IN (2, 4) AND r.this < r.d AS read_inferred, r.kind = 4 AS read_ranged, c FROM judged j JOIN meant r USING (event_id) JOIN times USING (event_id)),
n AS (SELECT *, CASE WHEN told IS NOT NULL THEN 1 WHEN weekends OR named IS NOT NULL THEN 2 WHEN meant IS NOT NULL THEN 3 WHEN endless THEN 4 ELSE 5 END AS way FROM x),
w AS (SELECT *, CASE way WHEN 1 THEN told WHEN 2 THEN posted + CASE WHEN NOT weekends THEN (named - (isodow(posted) - 1) + 7) % 7 WHEN isodow(posted) >= 6 THEN 0 ELSE 6 - isodow(posted) END::INT WHEN 3 THEN meant END AS day FROM n)
SELECT event_id, day + coalesce(to_minutes((c[1][1] * 60 + c[1][2])::INT), INTERVAL 0 MINUTE) AS starts_at, CASE WHEN len(c) > 1 THEN day + to_minutes((c[2][1] * 60 + c[2][2] + CASE WHEN c[2][1] * 60 + c[2][2] <= c[1][1] * 60 + c[1][2] THEN 1440 ELSE 0 END)::INT) END AS ends_at, weekends OR named IS NOT NULL OR way = 4 AS recurring,
  CASE way WHEN 1 THEN told_reason WHEN 3 THEN read_reason WHEN 5 THEN 'missing_date' END AS reason, CASE way WHEN 1 THEN told_inferred WHEN 3 THEN read_inferred ELSE false END AS year_inferred, CASE way WHEN 1 THEN told_ranged WHEN 3 THEN read_ranged WHEN 5 THEN told_ranged ELSE false END AS date_range, day IS NOT NULL AND len(c) > 0 AS time_known, ['deterministic', 'deterministic', 'structured_fallback', 'unresolved', 'unresolved'][way] AS source FROM w""")
def resolved_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, end and flags of events: told dates, cadences, readings of a model, and times, in all mixtures."""
    k = F.col("event_id")
    rows = _notices(spark, sf_dir).join(_readings(spark, sf_dir).select("event_id", "reading"), "event_id")
    cadence = F.when(k % 5 == 0, "aos fins de semana").when(k % 5 == 1, "sempre")
    out = R.resolve(rows, F.when(k % 8 != 0, F.col("date_text")), _times(k), F.col("posted"), k % 3 == 0, F.when(k % 3 == 0, cadence), F.when(k % 2 == 0, F.col("reading")))
    return out.select("event_id", "starts_at", "ends_at", "recurring", "reason", "year_inferred", "date_range", "time_known", "source")


@query("SELECT c_custkey, round(0.3 * n + 0.2 * a + 0.1 * t + 0.1 * b + 0.1 * c + 0.1 * u + 0.1 * f, 4) AS confidence, n AS name, a AS address, u AS url, f AS followers FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE 0.0 END AS n, CASE c_custkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.0 END AS a, CASE WHEN c_custkey % 2 = 0 THEN 0.5 ELSE 0.0 END AS t, CASE WHEN c_custkey % 5 = 0 THEN 1.0 ELSE 0.0 END AS b, 0.0 AS c, CASE c_custkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END AS u, CASE c_custkey % 6 WHEN 0 THEN 0.2 WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 WHEN 3 THEN 0.7 WHEN 4 THEN 0.3 ELSE 0.5 END AS f FROM customer)")
def profile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How surely profiles belong to the venue 'Bar Conchittas'."""
    k = F.col("c_custkey")
    user = _pick(("barconchittas", "bar.conchittas", "conchittas", "other"), k % 4, "string")
    bio = _pick(("Aurora, Recife", "na Aurora", "só aqui"), k % 3, "string")
    url = _pick(("https://barconchittas.com", "https://conchittas.example", None), k % 3, "string")
    followers = _pick((10, 100, 5_000, 200_000, 900_000, None), k % 6, "int")
    address = F.when(k % 3 == 1, "Rua Aurora, Bloco").otherwise("Rua Aurora, 5")
    s = rules.profile_score(F.lit("Bar Conchittas"), address, user, F.lit(None).cast("string"), bio, k % 5 == 0, F.when(k % 2 == 0, 0.5).otherwise(0.0), F.lit(0.0), url, followers, ["recife", "na aurora"])
    return S.read(spark, sf_dir, "customer").withColumn("s", s).select("c_custkey", "s.confidence", "s.signals.name", "s.signals.address", "s.signals.url", "s.signals.followers")


WORDS = ("gay", "diverse", "pride", "bar", "rain", "late", "queer friendly", "crowd")


@query(f"SELECT k AS c_custkey, len(list_filter({_ARRAY(rules.INCLUSIVE)}, lambda w: contains(lower(a || ' ' || b || ', ' || c), w))) > 0 AS inclusive, replace(replace(handle, '.', ' '), '_', ' ') AS words FROM (SELECT c_custkey AS k, {_ARRAY(WORDS)}[c_custkey % 8 + 1] AS a, {_ARRAY(WORDS)}[c_custkey // 8 % 8 + 1] AS b, c_name AS c, lower(replace(c_name, '#', '.')) || '_' || c_nationkey AS handle FROM customer)")
def keyword_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags by words of summaries, and handles as words."""
    k = F.col("c_custkey")
    summary = F.concat(_pick(WORDS, k % 8, "string"), F.lit(" "), _pick(WORDS, F.floor(k / 8) % 8, "string"), F.lit(", "), "c_name")
    handle = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("_"), "c_nationkey")
    return S.read(spark, sf_dir, "customer").select(k, rules.inclusive(summary).alias("inclusive"), rules.handle_as_words(handle).alias("words"))
