"""Runs over many rows: budgets by running sums, repairs that can be resumed, profiles and measurements in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agora_spark.functions.dates import local_day, micros
from agora_spark.functions.sets import band
from agora_spark.operators.graph import cut
from agora_spark.streaming import snapshots

HOUR = 3_600_000_000


def running_sum(df: DataFrame, value: str, *order: Column) -> DataFrame:
    """df with place (1, 2, ...) and so_far, the sum of value up to and with each row, in an order without ties.

    Rows are sorted over range partitions, each of which sums up its own rows; the sums of the
    partitions before are added. Of those there are as many as partitions, so no task sees all rows.
    """
    dealt = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumns({"_sum": F.sum(F.coalesce(value, F.lit(0))).over(inside), "_place": F.row_number().over(inside)})
    totals = dealt.groupBy("_part").agg(F.sum(F.coalesce(value, F.lit(0))).alias("_all"), F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = totals.select("_part", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_before"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows"))
    return own.join(before, "_part").withColumns({"place": F.col("_place") + F.col("_rows"), "so_far": F.col("_sum") + F.col("_before")}).select(*df.columns, "place", "so_far")


def archive_run(venues: DataFrame, done: DataFrame, budget: Column | float, unit_price: float, rate: float, bytes_each: int = 300_000) -> DataFrame:
    """(venue_id, place, units, cost, spent, bytes, ends_after) of the venues that a run takes before its budget (a number or a column of venues) is used up.

    venues: (venue_id, priority, photos), of which those in done (venue_id) need none. They come by
    priority, then id. A venue costs a request and one for each photo; the first that the budget does
    not cover ends the run, whatever comes after it. ends_after: seconds at so many requests a second.
    """
    left = venues.join(done.select("venue_id").distinct(), "venue_id", "left_anti").withColumn("units", F.coalesce("photos", F.lit(0)).cast("long") + 1)
    summed = running_sum(left, "units", F.col("priority"), F.col("venue_id"))
    spent = F.round(F.col("so_far") * unit_price, 6)
    return summed.where(spent <= budget).select("venue_id", "place", "units", F.round(F.col("units") * unit_price, 6).alias("cost"), spent.alias("spent"), (F.col("units") * bytes_each).alias("bytes"), F.round(F.col("so_far") / rate, 3).alias("ends_after"))


def estimate(run: DataFrame, venues: DataFrame, done: DataFrame) -> DataFrame:
    """One row of what a run would do, without doing it: (eligible, waiting, taken, units, cost, bytes, seconds)."""
    waiting = venues.join(done.select("venue_id").distinct(), "venue_id", "left_anti").agg(F.count("*").alias("waiting"))
    taken = run.agg(F.count("*").alias("taken"), F.coalesce(F.sum("units"), F.lit(0)).alias("units"), F.coalesce(F.max("spent"), F.lit(0.0)).alias("cost"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.max("ends_after"), F.lit(0.0)).alias("seconds"))
    return venues.agg(F.count("*").alias("eligible")).crossJoin(waiting).crossJoin(taken)  # one row each


def profile_cube(rows: DataFrame, dimensions: list[str], measures: dict[str, Column]) -> DataFrame:
    """(dimension, value, measures) of all rows (dimension 'all') and by each dimension, in one pass over rows; a missing value is 'unknown'."""
    known = rows.withColumns({d: F.coalesce(F.col(d).cast("string"), F.lit("unknown")) for d in dimensions})
    sets = [[F.col(d)] for d in dimensions] + [[]]
    grouped = known.groupingSets(sets, *(F.col(d) for d in dimensions)).agg(*(c.alias(n) for n, c in measures.items()), F.grouping_id().alias("_set"))
    which = F.lit("all")
    value = F.lit(None).cast("string")
    whole = (1 << len(dimensions)) - 1
    for k, d in enumerate(dimensions):
        hit = F.col("_set") == whole - (1 << (len(dimensions) - 1 - k))
        which, value = F.when(hit, d).otherwise(which), F.when(hit, F.col(d)).otherwise(value)
    return grouped.select(which.alias("dimension"), value.alias("value"), *measures)


def window_pairs(events: DataFrame, hours: int = 8) -> DataFrame:
    """(venue, pairs): how many pairs of a venue's events are of one local day or within hours, counted, not made.

    Times with how many events have them are in order; a frame over the hours to come counts the later
    ones near, a frame over the rest of the day those of the day that are farther.
    """
    times = events.where("starts_at IS NOT NULL").withColumns({"_us": micros(F.col("starts_at")), "_day": local_day(F.col("starts_at"))}).groupBy("venue", "_day", "_us").agg(F.count("*").alias("n"))
    reach = hours * HOUR
    near = F.coalesce(F.sum("n").over(Window.partitionBy("venue").orderBy("_us").rangeBetween(1, reach)), F.lit(0))
    day = F.coalesce(F.sum("n").over(Window.partitionBy("venue", "_day").orderBy("_us").rangeBetween(reach + 1, Window.unboundedFollowing)), F.lit(0))
    counted = times.withColumn("later", near + day)
    return counted.groupBy("venue").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2 + F.col("n") * F.col("later")).cast("long").alias("pairs"))


def measured(tokens: DataFrame, judged: DataFrame, promoted: DataFrame, hours: int = 8) -> DataFrame:
    """(band, promoter, pairs) over events (event_id, venue, starts_at, words) and their judged pairs: auto and suggest, by whether promoters alone (event_id) have told of both; and the refused pairs, with and without distinctive words."""
    hidden = promoted.select("event_id").distinct()
    both = judged.join(hidden.withColumn("_a", F.lit(True)), "event_id", "left").join(hidden.select(F.col("event_id").alias("other_event_id"), F.lit(True).alias("_b")), "other_event_id", "left")
    made = both.groupBy("band", (F.coalesce("_a", F.lit(False)) & F.coalesce("_b", F.lit(False))).alias("promoter")).agg(F.count("*").alias("pairs"))
    total = lambda rows: window_pairs(rows, hours).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("n"))
    every, worded, kept = total(tokens), total(tokens.where(F.size("words") > 0)), judged.agg(F.count("*").alias("n"))
    sums = every.select(F.col("n").alias("every")).crossJoin(worded.select(F.col("n").alias("worded"))).crossJoin(kept.select(F.col("n").alias("kept")))  # one row each
    none = F.lit(None).cast("boolean")
    refused = sums.select(F.lit("no_words").alias("band"), none.alias("promoter"), (F.col("every") - F.col("worded")).alias("pairs")).unionByName(sums.select(F.lit("disjoint").alias("band"), none.alias("promoter"), (F.col("worded") - F.col("kept")).alias("pairs")))
    return made.unionByName(refused)


def _earlier(rows: DataFrame, keys: list[str], hours: int) -> tuple[DataFrame, DataFrame]:
    """rows, and the same rows (other_*, but for keys) in the half days in which those before them may be that are near; both with _bucket."""
    a = rows.withColumn("_bucket", F.floor(micros(F.col("starts_at")) / (12 * HOUR)))
    reach = -(-max(hours, 24) // 12)
    b = a.select(*(F.col(c) if c in keys else F.col(c).alias(f"other_{c}") for c in rows.columns), F.explode(F.sequence(F.col("_bucket") - reach, F.col("_bucket"))).alias("_bucket"))
    return a, b.hint("merge")


def _near(hours: int) -> Column:
    apart = F.abs(micros(F.col("starts_at")) - micros(F.col("other_starts_at"))) <= hours * HOUR
    return apart | (local_day(F.col("starts_at")) == local_day(F.col("other_starts_at")))


def token_pairs(tokens: DataFrame, hours: int = 8) -> DataFrame:
    """(venue, event_id, other_event_id, band) of a venue's pairs in the window that share a word (tokens: event_id, venue, starts_at, words).

    Events of one venue, time and set of words are one node; nodes are judged, then their events are
    paired. Nodes meet by venue, half day and word, the later one with those before it; of the words
    that two share only the first one makes the pair, so nothing is made twice.
    """
    keys = ["venue", "_word"]
    nodes = tokens.where("venue IS NOT NULL AND starts_at IS NOT NULL").where(F.size("words") > 0).groupBy("venue", "starts_at", "words").agg(F.collect_list("event_id").alias("ids"))
    a, b = _earlier(nodes.withColumn("_word", F.explode("words")), keys, hours)
    order = F.struct("starts_at", "words") < F.struct(F.col("other_starts_at"), F.col("other_words"))
    met = a.join(b, [*keys, "_bucket"]).where(order).where(_near(hours)).where(F.col("_word") == F.array_min(F.array_intersect("words", "other_words")))
    judged = met.select("venue", "ids", "other_ids", band(F.col("words"), F.col("other_words")).alias("band")).where("band <> 'refuse'")
    alike = nodes.where(F.size("ids") > 1).select("venue", "ids", F.lit("auto").alias("band"))
    both = lambda rows, other: rows.select("venue", "band", other, F.explode("ids").alias("_a")).select("venue", "band", "_a", F.explode(other).alias("_b"))
    pairs = both(judged, "other_ids").where("_a <> _b").unionByName(both(alike, "ids").where("_a < _b"))
    return pairs.select("venue", F.least("_a", "_b").alias("event_id"), F.greatest("_a", "_b").alias("other_event_id"), "band")


def raised_pairs(tokens: DataFrame, lineups: DataFrame, threshold: int = 2, hours: int = 8) -> DataFrame:
    """(venue, event_id, other_event_id, band, reasons, shared): token_pairs(), and pairs that share a line-up.

    lineups: (event_id, name). At least `threshold` shared names make a pair auto, whatever its titles;
    an event without a line-up says nothing. reasons: lineup, title, or both, comma-joined.
    """
    keys = ["venue", "name"]
    at = tokens.where("starts_at IS NOT NULL").select("event_id", "venue", "starts_at")
    a, b = _earlier(at.join(lineups.where("name <> ''").select("event_id", "name").distinct(), "event_id"), keys, hours)
    order = F.struct("starts_at", "event_id") < F.struct(F.col("other_starts_at"), F.col("other_event_id"))
    near = a.join(b, [*keys, "_bucket"]).where(order & (F.col("event_id") != F.col("other_event_id"))).where(_near(hours))
    shared = near.groupBy("venue", F.least("event_id", "other_event_id").alias("event_id"), F.greatest("event_id", "other_event_id").alias("other_event_id")).agg(F.count("*").alias("shared")).where(F.col("shared") >= threshold)
    both = token_pairs(tokens, hours).join(shared, ["venue", "event_id", "other_event_id"], "full")
    lineup, title = F.col("shared").isNotNull(), F.coalesce(F.col("band") == "auto", F.lit(False))
    reasons = F.concat_ws(",", F.when(lineup, "lineup"), F.when(title | ~lineup, "title"))
    return both.select("venue", "event_id", "other_event_id", F.when(lineup | title, "auto").otherwise("suggest").alias("band"), reasons.alias("reasons"), F.coalesce("shared", F.lit(0)).alias("shared"))


LEDGER = "chunk long, selected long, written long, run long"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The chunks that repairs under a path have finished: (chunk, selected, written, run)."""
    found = snapshots(spark, f"{path}/ledger")
    return spark.read.schema(LEDGER).parquet(*(f"{path}/ledger/{n}" for n in found)) if found else spark.createDataFrame([], LEDGER)


def todo(decided: DataFrame, finished: DataFrame) -> DataFrame:
    """The rows of decided (chunk, ...) whose chunk is not finished: what a dry run shows, and what a run writes."""
    return decided.join(finished.select("chunk"), "chunk", "left_anti")


def repair(path: str, decided: DataFrame, most: int | None = None) -> DataFrame:
    """Write the next `most` chunks of decided (chunk, ...) that no earlier run has finished, or all; returns this run's ledger.

    A run writes its rows, counts what is there now, and only then enters its chunks in the ledger. One
    that breaks off leaves none, and the next one does its chunks again under its own number. A chunk
    whose rows do not add up to what was selected fails the run.
    """
    spark = decided.sparkSession
    runs = snapshots(spark, f"{path}/ledger")
    run = runs[-1] + 1 if runs else 0
    left = todo(decided, ledger(spark, path))
    if most is not None:
        left = left.join(left.select("chunk").distinct().orderBy("chunk").limit(most), "chunk", "left_semi")
    left.write.mode("overwrite").parquet(f"{path}/rows/{run}")
    there = spark.read.schema(decided.schema).parquet(f"{path}/rows/{run}").groupBy("chunk").agg(F.count("*").alias("written"))
    wanted = left.groupBy("chunk").agg(F.count("*").alias("selected"))
    balance = wanted.join(there, "chunk", "full").select("chunk", F.coalesce("selected", F.lit(0)).alias("selected"), F.coalesce("written", F.lit(0)).alias("written"), F.lit(run).cast("long").alias("run"))
    sound = F.when(F.col("selected") == F.col("written"), F.col("written")).otherwise(F.raise_error(F.concat(F.lit("a chunk does not add up: "), F.col("chunk"))).cast("long"))
    balance.select("chunk", "selected", sound.alias("written"), "run").write.mode("overwrite").parquet(f"{path}/ledger/{run}")
    return spark.read.schema(LEDGER).parquet(f"{path}/ledger/{run}")
