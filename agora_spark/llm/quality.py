"""Quality rules that vote: weak supervision in place of a filter that all rules must pass.

Each rule looks at a few counts of a text and says good, bad or nothing. Expectation-maximisation
over the votes of all documents estimates how often each rule says what of good and of bad documents;
the probability of being good that follows from a document's votes decides. DataFrame functions only.

The texts are read once: their counts (a few numbers a document) are written to the shared folder,
read for the fit and again for the result. The fit runs over one row that holds one entry per
different set of votes, at most 3 ** len(RULES) = 19683 whatever the input; it stays within Spark.

Defined results: null texts are empty and have no words. Words are runs of what is not a blank
(space, \\t, \\n, \\v, \\f, \\r). Repeated rows and ids are scored each for itself, with equal
results for equal texts. An empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora_spark.llm.common import materialize

BLANK = r"[\x20\x09-\x0D]"
#: Fixed bounds of the base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Rules: a share, and where it is good and where it is bad; between those a rule says nothing.
RULES: dict[str, tuple[str, str, str]] = {
    "symbols": ("n_symbols / n_words", "x < 0.02", "x > 0.1"),
    "plain": ("n_plain / n_words", "x >= 0.85", "x < 0.7"),
    "capitals": ("n_capitals / word_chars", "x < 0.15", "x > 0.3"),
    "runs": ("n_runs / n_words", "x < 0.02", "x > 0.1"),
    "sentences": ("n_ends / n_words", "x BETWEEN 0.02 AND 0.34", "x < 0.005 OR x > 0.5"),
    "repeats": ("n_repeat_words / n_words", "x < 0.1", "x > 0.3"),
    "variety": ("n_distinct / n_words", "x > 0.35", "x < 0.15"),
    "lines": ("n_dup_lines / n_lines", "x < 0.1", "x > 0.3"),
    "word_length": ("word_chars / n_words", "x BETWEEN 3 AND 10", "x < 2 OR x > 15"),
}
#: A word of letters and digits with what stands beside it in prose, and the end of a sentence.
PLAIN = r"""(?<![^\x20\x09-\x0D])["'(]*+[\p{L}\p{N}][\p{L}\p{N}'’-]*+[.,;:!?]?["')]*+(?![^\x20\x09-\x0D])"""
ENDS = r"[\p{L}\p{N})\"'][.!?](?=[\x20\x09-\x0D]|\z)"
BAD, NOTHING, GOOD = 0, 1, 2


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What the rules look at, by document: counts (longs) over the whole text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).alias("_id"), text.alias("text"))
    df = df.withColumn("w", F.array_remove(F.split("text", BLANK + "+"), "")).withColumn("n", F.size("w"))
    # Three-word windows with their places, sorted by hash: equal ones are neighbours, and their words are compared.
    n = F.greatest(F.col("n") - 2, F.lit(0))
    words = F.arrays_zip(*(F.slice("w", F.lit(k + 1), n).alias(f"w{k}") for k in range(3)))
    df = df.withColumn("s", F.sort_array(F.transform(words, lambda x, i: F.struct(F.xxhash64(x["w0"], x["w1"], x["w2"]).alias("h"), i.alias("i")))))
    same = lambda a, b: (a["h"] == b["h"]) & (F.slice("w", a["i"] + 1, F.lit(3)) == F.slice("w", b["i"] + 1, F.lit(3)))
    pairs = F.filter(F.zip_with("s", F.slice("s", F.lit(2), F.size("s")), lambda a, b: F.when(same(a, b), F.array(a["i"], b["i"]))), lambda p: p.isNotNull())
    df = df.withColumn("p", F.sort_array(F.array_distinct(F.flatten(pairs))))
    # A window found again covers its three words, but for those that the next such window covers.
    covered = F.aggregate(F.zip_with("p", F.slice("p", F.lit(2), F.size("p")), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))), F.lit(0), lambda x, y: x + y)
    df = df.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    long = lambda c, name: c.cast("long").alias(name)
    return df.select(
        F.col("_id").alias(id_col), long(F.col("n"), "n_words"), long(F.char_length(F.array_join("w", "")), "word_chars"), long(F.regexp_count("text", F.lit("[#*$%&|<>]")), "n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines")), "n_dup_lines"), long(covered, "n_repeat_words"),
        long(F.size("lines"), "n_lines"), long(F.size(F.array_distinct("w")), "n_distinct"), long(F.regexp_count("text", F.lit(r"\p{Lu}")), "n_capitals"),
        long(F.regexp_count("text", F.lit(r"([^\p{L}\p{N}\x20\x09-\x0D_=-])\1")), "n_runs"), long(F.regexp_count("text", F.lit(ENDS)), "n_ends"), long(F.regexp_count("text", F.lit(PLAIN)), "n_plain"),
    )


def votes() -> Column:
    """One number for all votes: base three, the first rule's vote counting most. A share of nothing is no vote."""
    code = F.lit(0)
    for share, good, bad in RULES.values():
        above, below = share.split(" / ")
        x = f"({above} / {below})"
        vote = F.when(F.expr(f"{below} = 0"), NOTHING).when(F.expr(good.replace("x", x)), GOOD).when(F.expr(bad.replace("x", x)), BAD).otherwise(NOTHING)
        code = code * 3 + vote
    return code.cast("int")


def _digit(code: Column, j: int) -> Column:
    return F.pmod(F.floor(code / 3 ** (len(RULES) - 1 - j)).cast("int"), F.lit(3))


#: What a rule is taken to say before any document is seen: of bad documents, and of good ones, by vote. Most rules see only one kind of bad document.
BEFORE = ((0.4, 0.1, 0.5), (0.01, 0.09, 0.9))
#: Share of good documents before any is seen.
SHARE = 0.8


def fit(voted: DataFrame, rounds: int = 30, trust: float = 0.3) -> DataFrame:
    """(code, n, quality) of each different set of votes in voted's column code: the probability of being good.

    trust: how much BEFORE weighs against the documents seen, as a share of their number. It ties good
    votes to good documents; without it the two classes could stand for anything that splits the votes.
    """
    k = len(RULES)
    one_hot = F.array(*(F.when(_digit(F.col("code"), j) == v, 1.0).otherwise(0.0) for j in range(k) for v in range(3)))
    seen = voted.groupBy("code").agg(F.count("*").cast("double").alias("n")).select(F.struct("code", "n", one_hot.alias("x")).alias("p"))
    one = seen.agg(F.sort_array(F.collect_list("p")).alias("ps")).where("size(ps) > 0").withColumn("all", F.aggregate("ps", F.lit(0.0), lambda a, p: a + p["n"]))
    before = [F.lit([x for _ in range(k) for x in BEFORE[y]]).cast("array<double>") for y in (0, 1)]

    def expect(acc: Column) -> Column:
        """The probability of good of each set of votes."""
        log = [F.transform(acc[name], lambda t: F.ln(t)) for name in ("bad", "good")]

        def r(p: Column) -> Column:
            by = [F.aggregate(F.zip_with(p["x"], log[y], lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) for y in (0, 1)]
            return 1 / (1 + (1 - acc["share"]) / acc["share"] * F.exp(by[0] - by[1]))

        return F.struct(acc["bad"].alias("bad"), acc["good"].alias("good"), acc["share"].alias("share"), F.transform("ps", r).alias("r"))

    def maximise(acc: Column) -> Column:
        """What the rules say of bad and of good documents, and how many are good."""
        pairs = F.arrays_zip(F.col("ps").alias("p"), acc["r"].alias("r"))
        zero = F.lit([0.0] * (3 * k)).cast("array<double>")
        good_n = F.aggregate(pairs, F.lit(0.0), lambda a, q: a + q["p"]["n"] * q["r"])
        add = lambda w: F.aggregate(pairs, zero, lambda a, q: F.zip_with(a, q["p"]["x"], lambda s, x: s + x * q["p"]["n"] * w(q["r"])))
        weight = F.col("all") * trust
        theta = lambda sums, n, y: F.zip_with(sums, before[y], lambda s, b: (s + b * weight) / (n + weight))
        return F.struct(theta(add(lambda r: 1 - r), F.col("all") - good_n, 0).alias("bad"), theta(add(lambda r: r), good_n, 1).alias("good"), ((good_n + SHARE) / (F.col("all") + 1)).alias("share"), acc["r"].alias("r"))

    start = F.struct(before[0].alias("bad"), before[1].alias("good"), F.lit(SHARE).alias("share"), F.transform("ps", lambda p: F.lit(0.5)).alias("r"))
    steps = F.aggregate(F.sequence(F.lit(1), F.lit(2 * rounds + 1)), start, lambda acc, i: F.when(i % 2 == 1, expect(acc)).otherwise(maximise(acc)))
    fitted = one.select("ps", steps["r"].alias("r")).select(F.explode(F.arrays_zip("ps", "r")).alias("z"))
    return fitted.select("z.ps.code", "z.ps.n", F.col("z.r").alias("quality"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(id, base counts, base_failed, kept, quality) of each document: kept are those that pass the base and whose quality is at least `least`."""
    seen = counts(docs, id_col, text_col).withColumn("code", votes())
    seen = materialize(seen.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "code"), "quality")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    # At most 3 ** len(RULES) rows of two numbers.
    out = seen.join(F.broadcast(fit(seen).select("code", "quality")), "code")
    return out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("quality") >= least)).alias("kept"), F.round("quality", 6).alias("quality"))
