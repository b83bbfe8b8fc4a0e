"""Which venues may be served: rules, categories, fences and closures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora_spark.functions.dates import micros
from agora_spark.functions.geo import haversine_km


def _any_within(text: Column, words: list[str]) -> Column:
    """Whether any of the configured words occurs in the text."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words), F.lit(False))


def category(google: Column, crowd: Column, google_map: dict[str, str], crowd_map: dict[str, str]) -> Column:
    """The display category: the map source's, but a restaurant that the crowd service calls a bar is a bar."""
    look = lambda m, key: F.get(F.from_json(F.lit("{}"), "map<string,string>"), key) if not m else F.create_map(*(F.lit(x) for kv in m.items() for x in kv))[key]
    g, c = look(google_map, F.lower(google)), look(crowd_map, F.upper(crowd))
    return F.when((g == "RESTAURANT") & c.isin("BAR", "PUB"), c).otherwise(F.coalesce(g, c, F.lit("OTHER")))


def decide(name: Column, crowd: Column, google: Column, rules: dict[str, list[str]], good: Column) -> Column:
    """struct<eligible, reason, confidence>; the first rule that fits decides.

    rules has lists under google, crowd, hard and ambiguous. good: whether the category is a wanted one.
    """
    low, g = F.lower(F.trim(F.coalesce(name, F.lit("")))), F.nullif(F.lower(F.trim(google)), F.lit(""))
    c = F.nullif(F.upper(F.trim(crowd)), F.lit(""))
    verdict = lambda ok, reason, sure: F.struct(F.lit(ok).alias("eligible"), F.lit(reason).cast("string").alias("reason"), F.lit(sure).alias("confidence"))
    keyword = F.when(g.isNotNull(), verdict(False, "name_keyword", "high")).otherwise(verdict(False, "name_keyword", "low"))
    return (
        F.when(low == "", verdict(False, "empty_name", "high"))
        .when(g.isin(rules["google"]), verdict(False, "google_type", "high"))
        .when(c.isin(rules["crowd"]), verdict(False, "besttime_type", "high"))
        .when(_any_within(low, rules["hard"]) & ~good, verdict(False, "name_keyword", "high"))
        .when(_any_within(low, rules["ambiguous"]) & ~_any_within(low, rules["hard"]) & ~good, keyword)
        .otherwise(verdict(True, None, "high"))
    )


def inside_fence(lat: Column, lng: Column, circles: list[tuple[float, float, float]], enabled: bool = True) -> Column:
    """Within any circle (lat, lng, km); open where the fence is off or empty, or a place has no coordinates."""
    if not enabled or not circles:
        return F.lit(True)
    near = reduce(lambda a, b: a | b, (haversine_km(F.lit(a), F.lit(o), lat, lng) <= km for a, o, km in circles))
    return lat.isNull() | lng.isNull() | near


def servable(venues: DataFrame, rules: dict[str, list[str]], good: Column, circles: list[tuple[float, float, float]], closures: DataFrame | None = None) -> DataFrame:
    """Active venues that no confident rule, fence or closure takes out. Uncertain keyword hits stay."""
    v = F.col("verdict")
    out = venues.where("lifecycle = 'active'").withColumn("verdict", decide(F.col("name"), F.col("btype"), F.col("gtype"), rules, good))
    out = out.where((v["eligible"] | (v["confidence"] == "low")) & inside_fence(F.col("lat"), F.col("lng"), circles)).drop("verdict")
    if closures is not None:
        out = out.join(closures.where("closed AND confidence = 'high'"), "venue_id", "left_anti")
    return out


def closure_signals(reviews: DataFrame, phrases: list[str], negations: list[str], days: int = 90, reach: int = 40) -> DataFrame:
    """(venue_id, closed, confidence, evidence, phrase) of each venue with a dated review.

    The newest review decides (ties: the larger id). A phrase counts where no negation stands within
    `reach` characters of it. Another review of the last `days` days that says nothing of the kind
    makes the claim uncertain.
    """
    text = F.lower(F.coalesce("text", F.lit("")))

    def said(phrase: str) -> Column:
        pieces = F.split(text, "\\Q" + phrase + "\\E", -1)
        # Around the i-th hit: the end of what stands before it and the start of what follows. So many pieces reach far enough.
        near = reach // len(phrase) + 2
        before = lambda i: F.right(F.concat_ws(phrase, F.slice(pieces, F.greatest(i - near + 1, F.lit(1)), F.least(i, F.lit(near)))), F.lit(reach))
        after = lambda i: F.left(F.concat_ws(phrase, F.slice(pieces, i + 1, F.lit(near))), F.lit(reach))
        hits = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: F.concat(before(i), F.lit(phrase), after(i)))
        return (F.size(pieces) > 1) & F.exists(F.when(F.size(pieces) > 1, hits).otherwise(F.array().cast("array<string>")), lambda w: ~_any_within(w, negations))

    phrase = F.coalesce(*(F.when(said(p), p) for p in phrases))
    dated = reviews.where("published IS NOT NULL").select("venue_id", "review_id", "published", phrase.alias("phrase"))
    newest = dated.groupBy("venue_id").agg(F.max(F.struct("published", "review_id", "phrase")).alias("n"))
    ordinary = dated.where("phrase IS NULL").groupBy("venue_id").agg(F.max("published").alias("ordinary"))
    closed = F.col("n.phrase").isNotNull()
    doubt = F.coalesce(micros(F.col("n.published")) - micros(F.col("ordinary")) <= days * 86_400_000_000, F.lit(False))
    return newest.join(ordinary, "venue_id", "left").select("venue_id", closed.alias("closed"), F.when(closed & doubt, "low").otherwise("high").alias("confidence"), F.when(closed, F.col("n.published")).alias("evidence"), F.col("n.phrase").alias("phrase"))
