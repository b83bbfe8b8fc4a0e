"""Deterministic stand-ins for place, event and engagement tables over the star schema.

Each function gives a DataFrame; SQL has the same tables as DuckDB common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"
HERE = (-8.0476, -34.877)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with the number of parts as n_parts: one more row to join, not a job while the plan is made."""
    return read(spark, sf_dir, name).crossJoin(F.broadcast(read(spark, sf_dir, "part").agg(F.count("*").alias("n_parts"))))


def venue(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    hidden = k % 17 == 0
    return read(spark, sf_dir, "part").select(
        k.alias("k"), F.concat(F.lit("v"), k).alias("venue_id"), F.when(k % 97 == 0, "  ").otherwise(F.col("p_name")).alias("name"), F.upper("p_type").alias("btype"),
        F.when(k % 7 != 0, F.lower("p_brand")).alias("gtype"), F.when(~hidden, F.lit(HERE[0]) + ((k * 37) % 1000 - 500) / 2000.0).alias("lat"), F.when(~hidden, F.lit(HERE[1]) + ((k * 91) % 1000 - 500) / 2000.0).alias("lng"),
        (F.col("p_size") % 6).alias("priority"), F.when(k % 19 == 0, "deprecated").otherwise("active").alias("lifecycle"), F.when(k % 19 == 0, F.element_at(F.array(*map(F.lit, ("eligibility", "closed", "manual"))), (k % 3 + 1).cast("int"))).alias("reason"),
        F.when(k % 23 == 0, "google_only").otherwise("besttime").alias("venue_source"), F.when(k % 11 == 0, "USD").otherwise("BRL").alias("currency"), F.when(k % 5 != 1, F.col("p_retailprice") / 20).alias("price_min"), F.when(k % 5 != 0, F.col("p_retailprice") / 10).alias("price_max"),
        F.when(k % 7 == 1, "PRICE_LEVEL_INEXPENSIVE").when(k % 7 == 2, "PRICE_LEVEL_EXPENSIVE").when(k % 7 == 3, "PRICE_LEVEL_FREE").alias("price_label"), (k % 6).cast("int").alias("crowd_price"),
    )


def rating(spark: SparkSession, sf_dir: str, among: DataFrame | None = None) -> DataFrame:
    """Ratings of all venues, or of those among (k)."""
    lines = read(spark, sf_dir, "lineitem")
    if among is not None:
        lines = lines.join(among, F.col("l_partkey") == F.col("k"), "left_semi")
    rated = lines.groupBy("l_partkey").agg(F.round(F.avg("l_quantity"), 4).alias("rating"), F.count("*").alias("reviews"))
    return rated.select(F.concat(F.lit("v"), "l_partkey").alias("venue_id"), "rating", "reviews")


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    stamp = F.date_format(F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(mins=(k % 30).cast("int")), "yyyy-MM-dd HH:mm:ss")
    return read(spark, sf_dir, "part").where(k % 3 != 0).select(F.concat(F.lit("v"), k).alias("venue_id"), ((k * 31) % 101).cast("int").alias("busyness"), F.when(k % 29 == 0, "soon").otherwise(stamp).alias("gmttime"))


def post_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    orders = _numbered(spark, sf_dir, "orders").withColumn("p_partkey", F.col("o_orderkey") % F.col("n_parts"))
    k = F.col("o_orderkey")
    many = F.greatest(F.lit(40), F.floor(F.col("n_parts") / 50))  # venues
    title = F.concat("p_name", F.when(k % 5 == 0, " Show").otherwise(""), F.when(k % 7 == 0, " Live Band").otherwise(""))
    return orders.join(part, "p_partkey").select(
        k.alias("event_id"), (F.col("o_custkey") % many).alias("venue"), F.when(k % 13 != 0, F.col("o_orderdate") + F.make_dt_interval(hours=(k % 24).cast("int"))).alias("starts_at"), title.alias("title"), "p_name",
        F.concat(F.lit("h"), F.col("o_custkey") % 20).alias("handle"), F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "O", "pending").otherwise("rejected").alias("status"), F.when(k % 9 != 0, F.col("o_custkey") % many).alias("linked_venue"),
    )


def post_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("event_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("source_id"), F.col("l_shipdate").alias("seen_at"), F.when(F.col("l_returnflag") == "R", "promoter").otherwise("venue").alias("kind"), F.concat(F.lit("h"), F.col("l_suppkey")).alias("handle"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("line"),
        F.col("l_quantity").cast("int").alias("n_images"),
    )


def caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = post_item(spark, sf_dir)
    k = F.col("event_id")
    day = F.date_format("starts_at", "dd/MM")
    text = F.concat(F.lit("Hoje "), "title", F.coalesce(F.concat(F.lit(" dia "), day), F.lit("")), F.when(k % 4 == 0, " sexta 22h").otherwise(""), F.when(k % 6 == 0, " ingressos na porta, open bar").otherwise(""), F.lit(" com @"), F.replace("p_name", F.lit(" "), F.lit("_")), F.when(k % 3 == 0, F.concat(F.lit(" e @"), "handle", F.lit("."))).otherwise(""))
    return items.select("event_id", "venue", "handle", "starts_at", text.alias("caption"))


def review(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return _numbered(spark, sf_dir, "documents").select(F.concat(F.lit("v"), d % F.floor(F.col("n_parts") / 10)).alias("venue_id"), d.alias("review_id"), "text", F.when(d % 31 != 0, F.lit("2023-01-01").cast("timestamp") + F.make_dt_interval(days=((d * 7) % 365).cast("int"))).alias("published"))


def engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props", F.concat(F.lit("v"), (F.col("user_id") * 7 + F.col("event_id") % 5) % F.col("n_parts")).alias("venue_id"))


def announcement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as posts announce them: several of one night, in other spellings, by other accounts, or without a venue."""
    k = F.col("o_orderkey")
    word = F.when(k % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    rows = _numbered(spark, sf_dir, "orders").withColumn("p_partkey", k % F.col("n_parts")).join(part, "p_partkey")
    account = F.col("o_custkey") % F.greatest(F.lit(4), F.floor(F.col("n_parts") / 200))
    strings = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    return rows.select(
        k.alias("event_id"), F.floor(k / 20).cast("long").alias("post"), F.when(k % 9 != 0, account).alias("venue"), F.when(k % 17 != 0, F.concat(F.lit("h"), account)).alias("handle"),
        F.when(k % 13 != 0, F.lit("2024-03-01").cast("timestamp_ntz") + F.make_dt_interval(days=(k % 7).cast("int"), hours=(k % 3 * 7).cast("int"))).alias("starts_at"), word.alias("title"),
        F.when((F.col("o_orderstatus") == "F") & (k % 4 == 0), "confirmed").otherwise("pending").alias("status"), F.when(k % 3 == 1, F.concat(F.lit("R$ "), k % 5)).when(k % 3 == 2, "R$ 20").alias("price"),
        F.when(k % 4 == 0, "").when(k % 4 > 1, F.concat(F.lit("Sala "), k % 2)).alias("place"), F.col("o_orderdate").alias("last_seen"),
        F.element_at(F.array(F.lit("unresolved_venue"), F.lit("date_range; unresolved_venue"), F.lit(None), F.lit("low_confidence"), F.lit("date_range; low_confidence")), (k % 5 + 1).cast("int")).alias("reason"),
        F.when(k % 6 == 0, strings("price")).when(k % 6 == 2, strings("title", "place")).when(k % 6 == 3, strings("venue")).when(k % 6 == 4, strings()).alias("edited"), F.when(k % 10 == 0, "menu").otherwise("event").alias("kind"),
    )


#: The same tables for DuckDB.
SQL = {
    "announcement": """announcement AS (SELECT o_orderkey AS event_id, o_orderkey // 20 AS post, CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey % accounts END AS venue, CASE WHEN o_orderkey % 17 <> 0 THEN 'h' || (o_custkey % accounts) END AS handle,
  CASE WHEN o_orderkey % 13 <> 0 THEN TIMESTAMP '2024-03-01' + to_days((o_orderkey % 7)::INT) + to_hours((o_orderkey % 3 * 7)::INT) END AS starts_at, CASE WHEN o_orderkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS title,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 0 THEN 'confirmed' ELSE 'pending' END AS status, CASE o_orderkey % 3 WHEN 1 THEN 'R$ ' || (o_orderkey % 5) WHEN 2 THEN 'R$ 20' END AS price,
  CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'Sala ' || (o_orderkey % 2) END AS place, o_orderdate AS last_seen,
  ['unresolved_venue', 'date_range; unresolved_venue', NULL, 'low_confidence', 'date_range; low_confidence'][o_orderkey % 5 + 1] AS reason,
  CASE o_orderkey % 6 WHEN 0 THEN ['price'] WHEN 2 THEN ['title', 'place'] WHEN 3 THEN ['venue'] WHEN 4 THEN []::VARCHAR[] END AS edited, CASE WHEN o_orderkey % 10 = 0 THEN 'menu' ELSE 'event' END AS kind
  FROM orders, (SELECT count(*) AS parts, greatest(4, count(*) // 200) AS accounts FROM part) JOIN part ON p_partkey = o_orderkey % parts)""",
    "venue": f"""venue AS (SELECT p_partkey AS k, 'v' || p_partkey AS venue_id, CASE WHEN p_partkey % 97 = 0 THEN '  ' ELSE p_name END AS name, upper(p_type) AS btype,
  CASE WHEN p_partkey % 7 <> 0 THEN lower(p_brand) END AS gtype, CASE WHEN p_partkey % 17 <> 0 THEN {HERE[0]}::DOUBLE + ((p_partkey * 37) % 1000 - 500) / 2000.0::DOUBLE END AS lat,
  CASE WHEN p_partkey % 17 <> 0 THEN {HERE[1]}::DOUBLE + ((p_partkey * 91) % 1000 - 500) / 2000.0::DOUBLE END AS lng, p_size % 6 AS priority, CASE WHEN p_partkey % 19 = 0 THEN 'deprecated' ELSE 'active' END AS lifecycle,
  CASE WHEN p_partkey % 19 = 0 THEN ['eligibility', 'closed', 'manual'][p_partkey % 3 + 1] END AS reason, CASE WHEN p_partkey % 23 = 0 THEN 'google_only' ELSE 'besttime' END AS venue_source,
  CASE WHEN p_partkey % 11 = 0 THEN 'USD' ELSE 'BRL' END AS currency, CASE WHEN p_partkey % 5 <> 1 THEN p_retailprice / 20 END AS price_min, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice / 10 END AS price_max,
  CASE p_partkey % 7 WHEN 1 THEN 'PRICE_LEVEL_INEXPENSIVE' WHEN 2 THEN 'PRICE_LEVEL_EXPENSIVE' WHEN 3 THEN 'PRICE_LEVEL_FREE' END AS price_label, (p_partkey % 6)::INT AS crowd_price FROM part)""",
    "rating": "rating AS (SELECT 'v' || l_partkey AS venue_id, round(avg(l_quantity), 4) AS rating, count(*) AS reviews FROM lineitem GROUP BY 1)",
    "live": f"live AS (SELECT 'v' || p_partkey AS venue_id, ((p_partkey * 31) % 101)::INT AS busyness, CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE TIMESTAMP '{AS_OF}' - to_minutes((p_partkey % 30)::INT) END AS made FROM part WHERE p_partkey % 3 <> 0)",
    "item": """item AS (SELECT o_orderkey AS event_id, o_custkey % (SELECT greatest(40, count(*) // 50) FROM part) AS venue, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate + to_hours((o_orderkey % 24)::INT) END AS starts_at,
  p_name || CASE WHEN o_orderkey % 5 = 0 THEN ' Show' ELSE '' END || CASE WHEN o_orderkey % 7 = 0 THEN ' Live Band' ELSE '' END AS title, p_name, 'h' || (o_custkey % 20) AS handle,
  CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS status, CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey % (SELECT greatest(40, count(*) // 50) FROM part) END AS linked_venue
  FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part))""",
    "source": "source AS (SELECT l_orderkey AS event_id, l_orderkey * 100 + l_linenumber AS source_id, l_shipdate AS seen_at, CASE WHEN l_returnflag = 'R' THEN 'promoter' ELSE 'venue' END AS kind, 'h' || l_suppkey AS handle, l_partkey AS part, l_linenumber AS line, l_quantity::INT AS n_images FROM lineitem)",
    "caption": """caption AS (SELECT event_id, venue, handle, starts_at, 'Hoje ' || title || coalesce(' dia ' || strftime(starts_at, '%d/%m'), '') || CASE WHEN event_id % 4 = 0 THEN ' sexta 22h' ELSE '' END
  || CASE WHEN event_id % 6 = 0 THEN ' ingressos na porta, open bar' ELSE '' END || ' com @' || replace(p_name, ' ', '_') || CASE WHEN event_id % 3 = 0 THEN ' e @' || handle || '.' ELSE '' END AS caption FROM item)""",
    "review": "review AS (SELECT 'v' || (doc_id % ((SELECT count(*) FROM part) // 10)) AS venue_id, doc_id AS review_id, text, CASE WHEN doc_id % 31 <> 0 THEN TIMESTAMP '2023-01-01' + to_days(((doc_id * 7) % 365)::INT) END AS published FROM documents)",
    "engagement": "engagement AS (SELECT event_id, ts, user_id, event_type, value, props, 'v' || ((user_id * 7 + event_id % 5) % (SELECT count(*) FROM part)) AS venue_id FROM events)",
}


def sql(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
