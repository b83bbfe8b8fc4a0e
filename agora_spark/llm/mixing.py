"""Mixing sources to target weights by iterative proportional fitting, in built-in functions only.

Documents are summed up in cells of source, language and topic levels. The levels are those that the
targets name, and "other" for the rest, so there are no more cells than the targets allow, whatever
the corpus. Raking multiplies the cells' weights until the tokens of each source, language and topic
have their target shares. Each document then gets a number of copies whose expectation is its weight
times the wanted fraction of all tokens, so that the copies have the target shares at any fraction.

Beside them stands the draw without repeats: kept with probability min(1, scale * weight), where the
scale makes the expected number of kept tokens the wanted fraction. No cell can give more than it has,
so the kept rows reach the targets only where no scaled weight is over 1; else they stay nearer the input.

Defined results: null and empty texts have no tokens; they count in no cell but are drawn with their
cell's probability, once at most. Null sources and languages are "other". Targets of levels that no token has go
to the others in proportion; a level with target 0 gets weight 0. Whether a document is kept depends
on its id alone (and the seed), so repeated rows share their fate; null ids count as empty ids.
Empty tables give empty tables. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOPICS = ("contact", "legal", "short", "long", "prose")


@dataclass(frozen=True)
class Targets:
    """Shares of tokens by level; what a dimension leaves of 1 is for its other levels."""

    source: dict[str, float] = field(default_factory=lambda: {"src0": 0.15, "src1": 0.05, "src2": 0.05, "src3": 0.05})
    lang: dict[str, float] = field(default_factory=lambda: {"en": 0.5, "de": 0.17, "fr": 0.17, "es": 0.15})
    topic: dict[str, float] = field(default_factory=lambda: {"contact": 0.05, "legal": 0.05, "short": 0.05, "long": 0.45, "prose": 0.4})

    def dimensions(self) -> list[tuple[str, list[str], list[float]]]:
        out = []
        for name in ("source", "lang", "topic"):
            shares = getattr(self, name)
            out.append((name, [*shares, "other"], [*shares.values(), round(max(0.0, 1 - sum(shares.values())), 12)]))
        return out


def topic_of(text: Column) -> Column:
    """A coarse topic by what a text holds, else by its length."""
    n = F.char_length(text)
    return F.when(F.contains(text, F.lit("@")), "contact").when(F.contains(text, F.lit("icense")) | F.contains(text, F.lit("opyright")), "legal").when(n < 400, "short").when(n >= 5000, "long").otherwise("prose")


def _level(value: Column, levels: list[str]) -> Column:
    """The place of a value among the levels, the last for any other."""
    at = F.lit(len(levels) - 1)
    for k, level in reversed(list(enumerate(levels[:-1]))):
        at = F.when(value.eqNullSafe(level), k).otherwise(at)
    return at


def _rake(cells: Column, shares: Column, dim: str) -> Column:
    """Cells with weights that give the levels of one dimension their shares."""
    n = F.size(shares)
    zeros = F.transform(F.sequence(F.lit(1), n), lambda i: F.lit(0.0))
    sums = F.aggregate(cells, zeros, lambda a, c: F.transform(a, lambda x, i: x + F.when(i == c[dim], c["n"] * c["f"]).otherwise(0.0)))
    ratio = F.zip_with(shares, sums, lambda s, m: F.when(m > 0, s / m).otherwise(1.0))
    apply = lambda r: F.transform(cells, lambda c: c.withField("f", c["f"] * F.get(r, c[dim])))
    return F.get(F.transform(F.array(ratio), apply), F.lit(0))  # the ratios are made once


def mix(docs: DataFrame, targets: Targets | None = None, fraction: float = 0.5, seed: int = 7, rounds: int = 12, id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """(id, n_tokens, source_level, lang_level, topic, weight, probability, kept, copies) of each document, and the columns of keep."""
    dims = (targets or Targets()).dimensions()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tokens = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    value = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(text)}
    rows = docs.select(F.struct(*(keep or [id_col])).alias("_kept"), F.col(id_col).alias("_id"), tokens.alias("n_tokens"), *(_level(value[name], levels).alias(f"_{name}") for name, levels, _ in dims))
    cells = rows.where("n_tokens > 0").groupBy("_source", "_lang", "_topic").agg(F.sum("n_tokens").cast("double").alias("n"))
    one = cells.agg(F.sort_array(F.collect_list(F.struct(F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), "n", F.lit(1.0).alias("f")))).alias("cells"), F.sum("n").alias("total"))
    for name, levels, shares in dims:
        there = F.transform(F.lit(shares).cast("array<double>"), lambda s, i: F.when(F.exists("cells", lambda c: c[name] == i), s).otherwise(0.0))
        one = one.withColumn(f"_{name}", there)
    for name, _, _ in dims:
        held = F.aggregate(f"_{name}", F.lit(0.0), lambda a, s: a + s)
        one = one.withColumn(f"_{name}", F.when(held > 0, F.transform(f"_{name}", lambda s: s * F.col("total") / held)).otherwise(F.col(f"_{name}")))

    def rake(a: Column, _: Column) -> Column:
        for name, _levels, _shares in dims:
            a = F.get(F.transform(F.array(a), lambda c: _rake(c, F.col(f"_{name}"), name)), F.lit(0))
        return a

    one = one.select("total", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.col("cells"), rake).alias("cells"))
    # The scale: from the largest weight on, cells are certain until the rest's probabilities are not over 1.
    ordered = F.sort_array(F.transform("cells", lambda c: F.struct((-c["f"]).alias("minus"), c["n"].alias("n"))))
    start = F.struct(F.lit(0.0).alias("sure"), F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["n"] * c["f"]).alias("rest"), F.lit(1e18).alias("scale"), F.lit(False).alias("found"))

    def descend(a: Column, c: Column) -> Column:
        scale = (F.col("total") * fraction - a["sure"]) / a["rest"]
        fits = a["found"] | ((a["rest"] > 0) & (-c["minus"] * scale <= 1))
        return F.struct((a["sure"] + F.when(fits, 0.0).otherwise(c["n"])).alias("sure"), (a["rest"] + F.when(fits, 0.0).otherwise(c["n"] * c["minus"])).alias("rest"), F.when(a["found"], a["scale"]).when(fits, scale).otherwise(a["scale"]).alias("scale"), fits.alias("found"))

    raked = F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["n"] * c["f"])
    one = one.select("cells", F.aggregate(ordered, start, descend, lambda a: a["scale"]).alias("scale"), F.when(raked > 0, F.col("total") * fraction / raked).otherwise(0.0).alias("share"))
    weights = one.select(F.explode("cells").alias("c"), "scale", "share").select(F.col("c.source").alias("_source"), F.col("c.lang").alias("_lang"), F.col("c.topic").alias("_topic"), F.col("c.f").alias("weight"), F.round(F.least(F.lit(1.0), F.col("c.f") * F.greatest(F.col("scale"), F.lit(0.0))), 9).alias("probability"), F.round(F.col("c.f") * F.col("share"), 9).alias("_expected"))
    drawn = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("double") / 2.0**32
    # One row a cell, so at most the product of the numbers of levels.
    out = rows.join(F.broadcast(weights), ["_source", "_lang", "_topic"], "left")
    names = [F.get(F.lit(levels), F.col(f"_{name}")).alias(f"{name}_level" if name != "topic" else "topic") for name, levels, _ in dims]
    out = out.select("_kept.*", "n_tokens", *names, F.coalesce(F.col("weight"), F.lit(1.0)).alias("weight"), F.coalesce(F.col("probability"), F.lit(1.0)).alias("probability"), "_expected", drawn.alias("_drawn"))
    out = out.withColumn("kept", F.col("_drawn") < F.col("probability"))
    whole = F.floor("_expected")
    copies = F.when(F.col("n_tokens") > 0, whole + (F.col("_drawn") < F.col("_expected") - whole).cast("long")).otherwise(F.col("kept").cast("long"))
    return out.withColumn("copies", copies).drop("_expected", "_drawn")


def oracle(targets: Targets | None = None, fraction: float = 0.5, seed: int = 7, rounds: int = 12) -> str:
    """DuckDB SQL for mix() over documents."""
    dims = (targets or Targets()).dimensions()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    level = {name: "CASE " + " ".join(f"WHEN {value} = {quote(x)} THEN {quote(x)}" for x in levels[:-1]) + " ELSE 'other' END" for (name, levels, _), value in zip(dims, ("source", "lang", "topic_value"))}
    parts = [
        "d0 AS (SELECT *, coalesce(text, '') AS t FROM documents)",
        "d1 AS (SELECT doc_id, source, lang, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS n_tokens, CASE WHEN contains(t, '@') THEN 'contact' WHEN contains(t, 'icense') OR contains(t, 'opyright') THEN 'legal' WHEN length(t) < 400 THEN 'short' WHEN length(t) >= 5000 THEN 'long' ELSE 'prose' END AS topic_value FROM d0)",
        f"d AS (SELECT doc_id, n_tokens, {level['source']} AS source, {level['lang']} AS lang, {level['topic']} AS topic FROM d1)",
        "w0 AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS n, 1.0::DOUBLE AS f FROM d WHERE n_tokens > 0 GROUP BY ALL)",
    ]
    for name, levels, shares in dims:
        rows = ", ".join(f"({quote(x)}, {s}::DOUBLE)" for x, s in zip(levels, shares))
        parts.append(f"t_{name} AS (SELECT {name}, share * (SELECT sum(n) FROM w0) / sum(share) OVER () AS share FROM (VALUES {rows}) AS v({name}, share) WHERE {name} IN (SELECT {name} FROM w0))")
    k = 0
    for _ in range(rounds):
        for name, _levels, _shares in dims:
            k += 1
            parts.append(f"w{k} AS MATERIALIZED (SELECT w.source, w.lang, w.topic, n, CASE WHEN m > 0 THEN f * (share / m) ELSE f END AS f FROM (SELECT *, sum(n * f) OVER (PARTITION BY {name}) AS m FROM w{k - 1}) w JOIN t_{name} USING ({name}))")
    parts += [
        f"o AS (SELECT *, row_number() OVER (ORDER BY f DESC, n) AS k, coalesce(sum(n) OVER (ORDER BY f DESC, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sure, sum(n * f) OVER (ORDER BY f DESC, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w{k})",
        f"z AS (SELECT coalesce((SELECT ((SELECT sum(n) FROM w0) * {fraction} - sure) / rest FROM o WHERE rest > 0 AND f * ((SELECT sum(n) FROM w0) * {fraction} - sure) / rest <= 1 ORDER BY k LIMIT 1), 1e18) AS scale, (SELECT CASE WHEN sum(n * f) > 0 THEN sum(n) * {fraction} / sum(n * f) ELSE 0 END FROM w{k}) AS share)",
    ]
    return f"""WITH {', '.join(parts)},
r AS (SELECT doc_id, n_tokens, d.source AS source_level, d.lang AS lang_level, d.topic, coalesce(f, 1.0) AS weight, coalesce(round(least(1.0, f * greatest((SELECT scale FROM z), 0.0)), 9), 1.0) AS probability, round(f * (SELECT share FROM z), 9) AS expected,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{seed}'), 1, 8))::BIGINT / 4294967296.0 AS drawn
  FROM d LEFT JOIN w{k} w ON d.source = w.source AND d.lang = w.lang AND d.topic = w.topic)
SELECT doc_id, n_tokens, source_level, lang_level, topic, round(weight, 6) AS weight, round(probability, 6) AS probability,
  drawn < probability AS kept, CASE WHEN n_tokens > 0 THEN floor(expected)::BIGINT + (drawn < expected - floor(expected))::BIGINT ELSE (drawn < probability)::BIGINT END AS copies FROM r"""
