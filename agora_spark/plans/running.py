"""Named queries on runs: profiles and measurements in one pass, archive runs under a budget, repairs in chunks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agora_spark.functions import told
from agora_spark.operators import happenings
from agora_spark.operators import runs as R
from agora_spark.operators.graph import root
from agora_spark.plans.catalog import GENERIC, JUDGED, PRICED, STOP, WORDS, _priced, query
from agora_spark.plans.dating import TOLD, _notices
from agora_spark.sources import standins as S

COVERED = {"venues": "*", "placed": "lat", "typed": "gtype", "labelled": "price_label", "priced": "price_min", "rated": "rating", "live": "gmttime"}
_COUNTS = ", ".join(f"count({'l.venue_id' if c == 'gmttime' else c}) AS {n}" for n, c in COVERED.items())


@query(S.sql("venue", "rating", "live") + PRICED + f""", rows AS (SELECT coalesce(p.gtype, 'unknown') AS by_type, coalesce(p.level::VARCHAR, 'unknown') AS by_level, coalesce(p.src, 'unknown') AS by_source, {_COUNTS}, round(avg(rating), 6) AS mean_rating, grouping(coalesce(p.gtype, 'unknown'), coalesce(p.level::VARCHAR, 'unknown'), coalesce(p.src, 'unknown')) AS g
  FROM priced p LEFT JOIN rating r USING (venue_id) LEFT JOIN live l USING (venue_id) WHERE lifecycle = 'active' GROUP BY GROUPING SETS ((coalesce(p.gtype, 'unknown')), (coalesce(p.level::VARCHAR, 'unknown')), (coalesce(p.src, 'unknown')), ()))
SELECT CASE g WHEN 3 THEN 'type' WHEN 5 THEN 'level' WHEN 6 THEN 'source' ELSE 'all' END AS dimension, CASE g WHEN 3 THEN by_type WHEN 5 THEN by_level WHEN 6 THEN by_source END AS value, {', '.join(COVERED)}, mean_rating FROM rows""")
def quality_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How complete the catalog is: as a whole, by type, by price level, by where the level comes from."""
    rows = _priced(spark, sf_dir).where("lifecycle = 'active'").join(S.rating(spark, sf_dir), "venue_id", "left").join(S.live(spark, sf_dir).select("venue_id", F.lit(1).alias("gmttime")), "venue_id", "left")
    rows = rows.withColumns({"type": F.col("gtype"), "level": F.col("p.level"), "source": F.col("p.source")})
    measures = {n: F.count(F.lit(1) if c == "*" else F.col(c)) for n, c in COVERED.items()} | {"mean_rating": F.round(F.avg("rating"), 6)}
    return R.profile_cube(rows, ["type", "level", "source"], measures)


@query(S.sql("item", "source") + WORDS + JUDGED + """, alone AS (SELECT event_id FROM source GROUP BY 1 HAVING bool_and(kind = 'promoter')), spread AS MATERIALIZED (SELECT venue, local::DATE AS day, local, len(w) AS k FROM words),
pairs AS (SELECT count(*) AS n, count(*) FILTER (a.k > 0 AND b.k > 0) AS worded FROM (SELECT *, row_number() OVER () AS r FROM spread) a JOIN (SELECT *, row_number() OVER () AS r FROM spread) b ON a.venue = b.venue AND b.day BETWEEN a.day - 1 AND a.day + 1 AND a.r < b.r AND (a.day = b.day OR abs(epoch(a.local) - epoch(b.local)) <= 8 * 3600))
SELECT band, event_id IN (FROM alone) AND other_event_id IN (FROM alone) AS promoter, count(*) AS pairs FROM judged GROUP BY ALL UNION ALL SELECT 'no_words', NULL, n - worded FROM pairs UNION ALL SELECT 'disjoint', NULL, worded - (SELECT count(*) FROM judged) FROM pairs""")
def dedup_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of events by band and by who told of them; refused ones are counted without being made."""
    words = R.cut(happenings.worded(S.post_item(spark, sf_dir), GENERIC, STOP))
    return R.measured(words, R.token_pairs(words), happenings.hidden(S.post_source(spark, sf_dir)))


ARCHIVE = "eligible AS (SELECT venue_id, k, priority, (k * 7 % 9)::INT AS photos FROM venue WHERE lifecycle = 'active' AND gtype IS NOT NULL), waiting AS (SELECT * FROM eligible WHERE k % 4 <> 0), summed AS (SELECT venue_id, row_number() OVER w AS place, photos + 1 AS units, sum(photos + 1) OVER w AS so_far FROM waiting WINDOW w AS (ORDER BY priority, venue_id ROWS UNBOUNDED PRECEDING)), budget AS (SELECT count(*) * 0.01 AS most FROM part)"


def _archive(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Column]:
    venues = S.venue(spark, sf_dir).where("lifecycle = 'active' AND gtype IS NOT NULL").select("venue_id", "k", "priority", (F.col("k") * 7 % 9).cast("int").alias("photos"))
    budget = S.read(spark, sf_dir, "part").agg((F.count("*") * 0.01).alias("budget"))  # it grows with the catalog
    return venues.drop("k").crossJoin(F.broadcast(budget)), venues.where("k % 4 = 0"), F.col("budget")


@query(S.sql("venue") + f", {ARCHIVE} SELECT venue_id, place, units, round(units * 0.007, 6) AS cost, round(so_far * 0.007, 6) AS spent, units * 300000 AS bytes, round(so_far / 5, 3) AS ends_after FROM summed, budget WHERE round(so_far * 0.007, 6) <= most")
def archive_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-11: the venues whose photos a run archives before its budget is used up."""
    return R.archive_run(*_archive(spark, sf_dir), 0.007, 5.0)


@query(S.sql("venue") + f", {ARCHIVE} SELECT (SELECT count(*) FROM eligible) AS eligible, (SELECT count(*) FROM waiting) AS waiting, count(*) AS taken, coalesce(sum(units), 0)::BIGINT AS units, coalesce(max(round(so_far * 0.007, 6)), 0) AS cost, coalesce(sum(units * 300000), 0)::BIGINT AS bytes, coalesce(max(round(so_far / 5, 3)), 0) AS seconds FROM summed, budget WHERE round(so_far * 0.007, 6) <= most")
def archive_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the same run would take, before it is made."""
    venues, done, budget = _archive(spark, sf_dir)
    return R.estimate(R.archive_run(venues, done, budget, 0.007, 5.0), venues, done)


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to become of stored days once texts are read by the rule of today; a thousand rows a chunk."""
    rows = _notices(spark, sf_dir).withColumn("stored", F.when(F.col("event_id") % 3 != 0, F.date_add("posted", (F.col("event_id") % 40).cast("int")))).withColumn("day", told.told_day(F.col("date_text"), F.col("posted"))["day"])
    action = F.when(F.col("day").isNull(), F.when(F.col("stored").isNull(), "still_open").otherwise("kept")).when(F.col("stored").isNull(), "filled").when(F.col("stored") == F.col("day"), "same").otherwise("moved")
    return rows.select(F.floor(F.col("event_id") / 1000).cast("long").alias("chunk"), "event_id", "stored", F.coalesce("day", "stored").alias("day"), action.alias("action"))


@query(f"WITH {TOLD}, d AS (SELECT event_id, event_id // 1000 AS chunk, CASE WHEN event_id % 3 <> 0 THEN posted + (event_id % 40)::INT END AS stored, day FROM judged), a AS (SELECT *, CASE WHEN day IS NULL THEN CASE WHEN stored IS NULL THEN 'still_open' ELSE 'kept' END WHEN stored IS NULL THEN 'filled' WHEN stored = day THEN 'same' ELSE 'moved' END AS action FROM d) SELECT chunk, action, count(*) AS written, CASE WHEN chunk IN (SELECT DISTINCT chunk FROM d ORDER BY chunk LIMIT 2) THEN 0 ELSE 1 END::BIGINT AS run FROM a GROUP BY ALL")
def repair_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-19: days repaired in chunks; a first run does two, a second one the rest; counted from what they wrote."""
    path = f"{root(spark)}/repair-{uuid.uuid4().hex}"
    decided = R.cut(_decided(spark, sf_dir))
    R.repair(path, decided, 2)
    R.repair(path, decided)
    rows = None
    for run in (0, 1):
        there = spark.read.schema(decided.schema).parquet(f"{path}/rows/{run}").withColumn("run", F.lit(run).cast("long"))
        rows = there if rows is None else rows.unionByName(there)
    return rows.join(R.ledger(spark, path).select("chunk", "run"), ["chunk", "run"], "left_semi").groupBy("chunk", "action", "run").agg(F.count("*").alias("written"))
