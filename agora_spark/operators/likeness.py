"""The names that are most like a text: bounds first, exact likeness only where a name may still be among the best.

Names are packed in shards of a bounded size, which are broadcast one after another. A task holds one
shard as counts of letters; for each text, one pass over them bounds all names' likeness from above
(twice the letters in common, over all letters). Names are then compared exactly in the order of their
bounds, until the bound falls below the second best found. No table of pairs is made at any place.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora_spark.functions.geo import haversine_km
from agora_spark.functions.text import MARKED, PLAIN, fold_ascii
from agora_spark.operators.graph import cut, drop
from agora_spark.operators.places import first_n_by

# What venue names hold besides the name itself, and what a handle looks like.
LOCALITIES = ("boa viagem", "marco zero", "rio mar", "santo antonio", "casa forte", "jardim paulista", "zona sul", "zona norte")
GENERIC_NAME_WORDS = (
    "restaurante restaurant pizzaria bar cafe cafeteria boteco botequim lounge pub club clube churrascaria trattoria bistro bistr gastrobar burguer burger lanches sushi self service oficial academia shopping teatro "
    "recife boaviagem riomar marcozero gracas pina olinda pernambuco pe brasil brazil do da de e o a"
).split()
HANDLE = r"(?U)(?<![\w.])@[A-Za-z0-9_.]{1,30}"
# A core of so many letters that stands within the text, or the text in it, and covers half of it, is so much alike.
CORE_LETTERS, COVERED, HELD = 5, 0.5, 0.95
#: Bounds of a shard: names, and characters of names.
SHARD_NAMES, SHARD_CHARS = 1 << 15, 1 << 21
#: Letters are counted in so many classes; classes only raise a bound.
CLASSES = 64


def core(name: Column) -> Column:
    """The letters and digits of a venue's name without localities and generic words; all of them if no others are there."""
    low = F.lower(F.coalesce(name, F.lit("")))
    for place in LOCALITIES:
        low = F.replace(low, F.lit(place), F.lit(" "))
    words = F.transform(F.split(low, r"[\s\-|,/]+"), lambda w: F.regexp_replace(F.translate(F.regexp_replace(w, r"\p{Mn}+", ""), MARKED, PLAIN), "[^a-z0-9]", ""))
    own = F.array_join(F.filter(words, lambda w: (w != "") & ~F.array_contains(F.lit(GENERIC_NAME_WORDS), w)), "")
    return F.when(own == "", fold_ascii(name)).otherwise(own)


def _plain(text: Column) -> Column:
    return F.lower(F.trim(text))


def _counts(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), CLASSES), np.int16)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    np.add.at(out, (np.repeat(np.arange(len(texts)), [len(t) for t in texts]), points % CLASSES), 1)
    return out


def ratio(a: str, b: str) -> float:
    """Twice the characters in matching blocks over all characters (Ratcliff and Obershelp)."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def held(own: str, whole: str) -> bool:
    """Whether a core stands in a text, or the text in it, and is not much shorter or longer."""
    return len(own) >= CORE_LETTERS and (own in whole or whole in own) and min(len(own), len(whole)) >= COVERED * max(len(own), len(whole))


def likeness(name: tuple[str, str, str], text: tuple[str, str]) -> float:
    """Of a name (plain, letters, core) and a text (plain, letters)."""
    best = ratio(name[0], text[0])
    if name[1] and text[1]:
        best = max(best, HELD if held(name[2], text[1]) else max(ratio(name[1], text[1]), ratio(name[2], text[1])))
    return best


class Shard:
    """Names with their forms and counts of letters."""

    def __init__(self, names: list[str], forms: list[tuple[str, str, str]]):
        self.names, self.forms = names, forms
        self.counts = [_counts([f[k] for f in forms]) for k in range(3)]
        self.sizes = [np.array([len(f[k]) for f in forms]) for k in range(3)]

    def bounds(self, text: tuple[str, str]) -> np.ndarray:
        """At least each name's likeness to a text."""
        best = np.zeros(len(self.names))
        for k, against in enumerate((text[0], text[1], text[1])):
            common = np.minimum(self.counts[k], _counts([against])[0]).sum(axis=1)
            best = np.maximum(best, 2 * common / np.maximum(self.sizes[k] + len(against), 1))
            if k == 2:  # within each other: all letters of the shorter are common
                size = self.sizes[2]
                may = (size >= CORE_LETTERS) & (common >= np.minimum(size, len(against))) & (np.minimum(size, len(against)) >= COVERED * np.maximum(size, len(against)))
                best = np.where(may, np.maximum(best, HELD), best)
        return best

    def improve(self, text: tuple[str, str], found: list[tuple[float, str]], keep: int) -> tuple[list[tuple[float, str]], int]:
        """The best of found and this shard's names, all that tie with the last one included; and how many were compared."""
        bounds, compared = self.bounds(text), 0
        bar = sorted((x for x, _ in found), reverse=True)[keep - 1] if len(found) >= keep else 0.0
        for k in np.argsort(-bounds, kind="stable").tolist():
            if bounds[k] < bar - 1e-12 or bounds[k] <= 0:
                break
            compared += 1
            exact = likeness(self.forms[k], text)
            if exact > 0 and exact >= bar:
                found.append((exact, self.names[k]))
                if len(found) >= keep:
                    bar = max(bar, sorted((x for x, _ in found), reverse=True)[keep - 1])
        return [x for x in found if x[0] >= bar], compared


_FOUND = pa.list_(pa.struct([("exact", pa.float64()), ("name", pa.string())]))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0

    def pack() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        table = pa.table([pa.array(x, pa.string()) for x in zip(*rows)], names=["name", "plain", "whole", "core"])
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["names"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and (len(rows) >= SHARD_NAMES or size + len(row[0]) > SHARD_CHARS):
                yield pack()
                rows, size = [], 0
            rows.append(row)
            size += len(row[0])
    if rows:
        yield pack()


def _search(packed, keep: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard = None
    for batch in batches:
        if shard is None:
            name, *forms = pa.ipc.open_stream(packed.value).read_all().columns
            shard = Shard(name.to_pylist(), list(zip(*(c.to_pylist() for c in forms))))
        text, plain, whole, found, n = (c.to_pylist() for c in batch.columns)
        out = [shard.improve((p, w), [(x["exact"], x["name"]) for x in f], keep) for p, w, f in zip(plain, whole, found)]
        lists = pa.array([[{"exact": x, "name": y} for x, y in f] for f, _ in out], _FOUND)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists, pa.array([a + b for a, (_, b) in zip(n, out)], pa.int64())], names=["text", "plain", "whole", "found", "compared"])


def best_names(texts: DataFrame, names: DataFrame, keep: int = 2) -> DataFrame:
    """(text, name, exact) of the names most like each different text: the best `keep`, and all that tie with the last of them.

    Names without any likeness are left out. texts has a column text, names a column name.
    """
    spark = texts.sparkSession
    known = names.where("name IS NOT NULL").select("name").distinct()
    known = known.select("name", _plain(F.col("name")).alias("plain"), fold_ascii(F.col("name")).alias("whole"), core(F.col("name")).alias("core"))
    packed = cut(known.sort(F.char_length("name"), "name").mapInArrow(_packed, "names binary").withColumn("shard", F.monotonically_increasing_id()))
    schema = "text string, plain string, whole string, found array<struct<exact: double, name: string>>, compared long"
    state = texts.where("text IS NOT NULL").select("text").distinct().select("text", _plain(F.col("text")).alias("plain"), fold_ascii(F.col("text")).alias("whole"), F.expr("CAST(array() AS array<struct<exact: double, name: string>>)").alias("found"), F.lit(0).cast("long").alias("compared"))
    state = cut(state)
    for shard in sorted(r.shard for r in packed.select("shard").collect()):  # a number for each 32768 names
        sent = spark.sparkContext.broadcast(bytes(packed.where(F.col("shard") == shard).first().names))
        now = cut(state.repartition(spark.sparkContext.defaultParallelism).mapInArrow(partial(_search, sent, keep), schema))
        sent.destroy()
        drop(state)
        state = now
    drop(packed)
    out = state.select("text", "compared", F.explode("found").alias("f")).select("text", F.col("f.name").alias("name"), F.col("f.exact").alias("exact"), "compared")
    out._agora_path = state._agora_path
    return out


def ranked_links(mentions: DataFrame, places: DataFrame, floor: float = 0.55, margin: float = 0.08) -> DataFrame:
    """(event_id, place, score, rank, linked): the two places whose names are most like a mention's text.

    mentions: (event_id, text, lat, lng); places: (place, name, lat, lng). Of equally good places the
    one nearer to the mention's point comes first, those without a distance last, then the smaller id.
    linked: the first is at least `floor` good, and ahead of the second by `margin` or alone; no more
    than two matter to that. Texts with an @handle have no candidates.

    Each text is ranked once, or once for each of its points; each event then takes over the two places
    of its text and point. Without a point, two places of a name are enough; with one, the two nearest
    of the name, for which places of one name at one point are two at most.
    """
    heard = mentions.where("text IS NOT NULL").where(~(F.contains("text", F.lit("@")) & F.col("text").rlike(HANDLE)))
    best = best_names(heard, places).select("text", "name", "exact")
    first = first_n_by(places.select("place", "name").distinct(), ["name"], 2, F.col("place")).withColumn("km", F.lit(None).cast("double"))
    pointed = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    heard = heard.select("event_id", "text", *(F.when(pointed, F.col(c)).alias(c) for c in ("lat", "lng")))
    asked = heard.select("text", "lat", "lng").distinct().join(best.hint("merge"), "text")
    plain = asked.where("lat IS NULL").join(first, "name")
    away = haversine_km(F.col("lat"), F.col("lng"), F.col("place_lat"), F.col("place_lng"))
    there = places.select("place", "name", F.col("lat").alias("place_lat"), F.col("lng").alias("place_lng")).distinct()
    there = first_n_by(there, ["name", "place_lat", "place_lng"], 2, F.col("place"))
    wanted = asked.where("lat IS NOT NULL").select("name", "lat", "lng").distinct()
    near = wanted.join(there.hint("merge"), "name").select("name", "lat", "lng", "place", F.round(away, 9).alias("km"))
    nearest = first_n_by(near, ["name", "lat", "lng"], 2, F.asc_nulls_last("km"), F.asc("place"))
    tagged = asked.join(nearest.hint("merge"), ["name", "lat", "lng"])
    key, columns = ["text", "lat", "lng"], ["text", "lat", "lng", "place", "exact", "km"]
    both = plain.select(*columns).unionByName(tagged.select(*columns))
    order = [F.desc("exact"), F.asc_nulls_last("km"), F.asc("place")]
    top = first_n_by(both, key, 2, *order).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct((-F.col("exact")).alias("minus"), F.col("km").isNull().alias("far"), "km", "place"))).alias("p"))
    score = lambda k: F.round(-F.get("p", F.lit(k))["minus"], 4)
    sure = (score(0) >= floor) & (score(1).isNull() | (score(0) - score(1) >= margin))
    top = top.select("p", *(F.col(c).alias(f"_{c}") for c in key)).hint("merge")
    top = heard.join(top, (F.col("text") == F.col("_text")) & F.col("lat").eqNullSafe(F.col("_lat")) & F.col("lng").eqNullSafe(F.col("_lng")))
    out = top.select("event_id", sure.alias("sure"), F.posexplode("p").alias("at", "c"))
    return out.select("event_id", F.col("c.place").alias("place"), F.round(-F.col("c.minus"), 4).alias("score"), (F.col("at") + 1).alias("rank"), (F.col("sure") & (F.col("at") == 0)).alias("linked"))
