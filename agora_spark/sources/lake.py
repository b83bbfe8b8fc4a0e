"""The event lake: envelopes of verbatim payloads, partitioned by source, dataset, UTC day and hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agora_spark.functions.text import redact


def envelope(df: DataFrame, dataset: str, source: str, payload: Column, ts: str = "ts", params: Column | None = None) -> DataFrame:
    """Envelopes: when in UTC and locally, where from, request parameters without secrets, payload."""
    local = F.from_utc_timestamp(ts, "America/Recife")
    return df.select(
        F.lit(source).alias("source"), F.lit(dataset).alias("dataset"), F.date_format(ts, "yyyy-MM-dd").alias("dt"), F.date_format(ts, "HH").alias("hour"), F.col(ts).alias("ingested_at"),
        F.date_format(local, "yyyy-MM-dd").alias("local_date"), F.hour(local).alias("local_hour"), (redact(params) if params is not None else F.lit(None).cast("map<string,string>")).alias("request_params"), payload.alias("payload"),
    )


#: The fields of a record, in order.
RECORD = ("record_id", "schema_version", "ingested_at_utc", "recife_date", "recife_hour", "source", "dataset", "endpoint", "http_status", "latency_ms", "outcome", "run_id", "job", "venue_id", "request", "payload", "error")


def record(df: DataFrame, dataset: str, source: str, payload: Column, ts: Column, params: Column | None = None, record_id: Column | None = None, version: int = 2, **more: Column) -> DataFrame:
    """The 17 fields of a record, and dt and hour for its partition.

    more: endpoint, http_status, latency_ms, outcome (success unless given), run_id, job, venue_id, error.
    The id is a hash of dataset, time and payload unless it is given, so that a task that runs again
    gives the same record. Parameters lose their secrets.
    """
    local = F.from_utc_timestamp(ts, "America/Recife")
    body = F.to_json(F.struct(payload.alias("p")))
    made = {
        "record_id": record_id if record_id is not None else F.left(F.sha2(F.concat_ws("|", F.lit(dataset), ts.cast("string"), body), 256), F.lit(32)), "schema_version": F.lit(version), "ingested_at_utc": F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), "recife_date": F.date_format(local, "yyyy-MM-dd"), "recife_hour": F.hour(local),
        "source": F.lit(source), "dataset": F.lit(dataset), "outcome": F.lit("success"), "request": redact(params) if params is not None else F.create_map().cast("map<string,string>"), "payload": payload,
    }
    none = {"http_status": "int", "latency_ms": "int"}
    fields = {f: more.get(f, made.get(f, F.lit(None).cast(none.get(f, "string")))) for f in RECORD}
    return df.select(*(c.alias(f) for f, c in fields.items()), F.date_format(ts, "yyyy-MM-dd").alias("dt"), F.date_format(ts, "HH").alias("hour"))


def promoted(lines: DataFrame, columns: dict[str, str], old_names: dict[str, str] | None = None) -> DataFrame:
    """Lines of JSON (value) of all versions as one table: typed columns, what is left of the payload, and what is bad.

    columns: promoted columns and their types. A newer record has them beside its payload, an older one
    within it, maybe under another name (old_names). rest is a map of the payload's other keys. bad is
    null in a good row; else it names what does not parse: the whole line (then it is kept in raw), or
    the columns whose values have another type (which are then null, with all else kept).
    """
    old = old_names or {}
    read = F.from_json("value", "schema_version int, payload map<string,string>, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    rows = lines.withColumn("_r", read).withColumn("_top", F.from_json("value", "map<string,string>"))
    broken = F.col("_r._broken").isNotNull() | F.col("_r.schema_version").isNull()
    inner = F.coalesce(F.col("_r.payload"), F.create_map().cast("map<string,string>"))
    said = {c: F.coalesce(F.col("_top")[c], inner[c], *([inner[old[c]]] if c in old else [])) for c in columns}
    typed = {c: said[c].try_cast(kind) for c, kind in columns.items()}
    wrong = F.array_compact(F.array(*(F.when(said[c].isNotNull() & typed[c].isNull(), F.lit(c)) for c in columns)))
    names = [*columns, *old.values()]
    bad = F.when(broken, F.array(F.lit("line"))).when(F.size(wrong) > 0, wrong)
    out = rows.select(F.when(~broken, F.col("_r.schema_version")).alias("schema_version"), *(F.when(~broken, v).alias(c) for c, v in typed.items()), F.when(~broken, F.map_filter(inner, lambda k, v: ~k.isin(names))).alias("rest"), bad.alias("bad"), F.when(broken, F.col("value")).alias("raw"), *(c for c in lines.columns if c != "value"))
    return out


def write(envelopes: DataFrame, path: str) -> None:
    envelopes.write.mode("append").option("compression", "gzip").partitionBy("source", "dataset", "dt", "hour").json(path)


def read(spark: SparkSession, path: str, schema: str, dataset: str, since: str) -> DataFrame:
    """One dataset from a day on; only its partitions are listed. Rows that do not parse are left out."""
    places = ["source", "dataset", "dt", "hour"]
    lines = spark.read.schema("value string, source string, dataset string, dt string, hour string").text(path)
    lines = lines.where((F.col("dataset") == dataset) & (F.col("dt") >= since))
    rows = lines.select(F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"), *places)
    return rows.where("r._corrupt_record IS NULL").select("r.*", *places).drop("_corrupt_record")
