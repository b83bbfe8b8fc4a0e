"""Personal data by weak supervision, in built-in functions only.

Candidate spans come from the base patterns and from looser ones. Four labelers vote on each (yes, no
or nothing): the pattern with its check, a gazetteer (domains, calling codes, card issuers, address
ranges), the words before, and the neighbouring characters. Expectation-maximisation over all votes
of the corpus estimates each labeler's reliability and each candidate's probability, without labels;
a logistic span classifier is then trained on these probabilities. It sees the votes and what no
labeler looks at, the span's kind and length in that kind, and has the last word. Votes of one kind
can take 81 patterns and lengths fall in 4 classes, so the corpus is summed up in at most 1296 counts,
and both fits are array expressions over that one row.

Spans of the base patterns that pass their check are always kept. The classifier adds the candidates
that it accepts (looser forms, or failing matches that everything else speaks for).

Defined results: null texts are empty and have no spans. Positions are code points, ends exclusive.
Repeated rows give repeated results, null ids are kept. Empty tables give empty tables. Of the input
only id and text are read. Whole texts are searched; no pattern backtracks over more than one token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora_spark.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive, and tried only where a token starts or the last match ended: the same matches in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms: spelt-out addresses, longer IP addresses, other separators, no country code.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}+(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]{1,63}+|\.[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){7}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9._])[0-9]{4}([._])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9._])",
    "phone": r"(?<![0-9+.A-Za-z-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
}
NEEDLE = {"email": ("[at]", "(at)", "[AT]", "(AT)"), "ip": (":",), "card": (), "phone": ()}
#: Gazetteers, as patterns that a candidate must fit.
GAZETTEER = {
    "email": r"(?i)\b(com|org|net|edu|gov|int|info|biz|io|co|us|uk|de|fr|es|it|pt|br|nl|be|ch|at|eu|ca|au|jp|cn|in|mx|ar)$",
    "ip": r"^([1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.|:",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|6(011|5))",
    "phone": r"^(\+(1|7|2[0-9]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9])",
}
CONTEXT = r"(?i)(e-?mail|courriel|correo|kontakt|contact|write|mailto|\btel\b|phone|t.l.phone|telefon|call|fax|mobile|cell|handy|m.vil|\bcard\b|credit|visa|mastercard|amex|karte|carte|tarjeta|\bip\b|address|adresse|server|host|login)\W{0,4}(\w+\W{1,3}){0,3}$"
AGAINST = r"(?i)(version|release|isbn|issn|doi|order|invoice|page|section|figure|table|chapter|serial|sku|part no|\bno\.|nr\.|#)\W{0,3}$"
NEAR = 40
#: Classes of a span's length, 8 characters each; the last one is open.
LENGTHS = 4
CHUNK = 256


def _matches(df: DataFrame, text: str, out: str, pattern: str, needles: tuple[str, ...] = ()) -> DataFrame:
    """df with out: array of (start, length, what, before, after) of the pattern's matches, leftmost first.

    The text is split at the matches; starts are running sums of the pieces' lengths, taken in chunks
    so that many matches cost linear time.
    """
    keep = [F.col(f"`{c}`") for c in df.columns]
    m, p, steps = f"_{out}_m", f"_{out}_p", f"_{out}_s"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if needles:
        there = F.contains(F.col(text), F.lit(needles[0]))
        for x in needles[1:]:
            there = there | F.contains(F.col(text), F.lit(x))
        found = F.when(there, found).otherwise(F.array().cast("array<string>"))
    df = df.select(*keep, found.alias(m))
    df = df.select(*keep, m, F.when(F.size(m) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>")).alias(p))
    n = F.size(m)
    df = df.select(*keep, m, p, F.zip_with(F.slice(p, F.lit(1), n), m, lambda b, x: F.struct(F.char_length(b).alias("gap"), F.char_length(x).alias("len"))).alias(steps))
    inside = lambda a, s: F.struct((a["at"] + s["gap"] + s["len"]).alias("at"), F.concat(a["out"], F.array(a["at"] + s["gap"])).alias("out"))
    none = F.array().cast("array<int>")

    def chunk(a: Column, c: Column) -> Column:
        part = F.aggregate(F.slice(F.col(steps), c * CHUNK + 1, F.lit(CHUNK)), F.struct(a["at"].alias("at"), none.alias("out")), inside)
        return F.struct(part["at"].alias("at"), F.concat(a["out"], F.array(part["out"])).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
    chunks = F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))
    starts = F.when(n > 0, F.flatten(F.aggregate(chunks, start, chunk, lambda a: a["out"]))).otherwise(none)
    parts = F.arrays_zip(starts.alias("start"), F.col(m).alias("what"), F.transform(F.slice(p, F.lit(1), n), lambda b: F.right(b, F.lit(NEAR))).alias("before"), F.transform(F.slice(p, F.lit(2), n), lambda a: F.left(a, F.lit(1))).alias("after"))
    return df.select(*keep, parts.alias(out))


def _passes(kind: str, what: Column) -> Column:
    """The check of the base pattern."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return what.rlike(rf"^{part}(\.{part}){{3}}$")
    digits = F.regexp_replace(what, "[^0-9]", "")
    if kind == "card":
        return F.char_length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    return F.char_length(digits).between(9, 15)


def _candidate(kind: str, loose: bool):
    """One match as a candidate: its span, whether it is a base span, and the code of its votes."""
    k = KINDS.index(kind)

    def make(m: Column) -> Column:
        what = m["what"]
        passes = F.lit(False) if loose else _passes(kind, what)
        pattern = F.lit(1) if loose else F.when(passes, 2).otherwise(0)  # 0: no, 1: nothing, 2: yes
        gazetteer = F.when(what.rlike(GAZETTEER[kind]), 2).otherwise(0)
        context = F.when(m["before"].rlike(AGAINST), 0).when(m["before"].rlike(CONTEXT), 2).otherwise(1)
        glued = m["before"].rlike(r"[\p{L}0-9@/._-]$") | m["after"].rlike(r"^[\p{L}0-9@/_-]")
        votes = F.lit(81 * k) + 27 * pattern + 9 * gazetteer + 3 * context + F.when(glued, 0).otherwise(2)
        code = votes * LENGTHS + F.least(F.floor(F.char_length(what) / 8).cast("int"), F.lit(LENGTHS - 1))
        return F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), (m["start"] + F.char_length(what)).alias("end"), passes.alias("base"), code.alias("code"))

    return make


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): all candidate spans of each text, array<struct<start, kind, end, base, code>>."""
    df = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    for kind in KINDS:
        df = _matches(df, "text", kind, BASE[kind])
    for kind in KINDS:
        df = _matches(df, "text", f"loose_{kind}", LOOSE[kind], NEEDLE[kind])
    strict = df.select("_id", F.concat(*(F.transform(k, _candidate(k, False)) for k in KINDS)).alias("strict"), F.concat(*(F.transform(f"loose_{k}", _candidate(k, True)) for k in KINDS)).alias("loose"))
    kept = strict.select("_id", "strict", "loose", F.filter("strict", lambda b: b["base"]).alias("sure"))
    apart = F.filter("loose", lambda c: ~F.exists("sure", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return kept.select(F.col("_id").alias(id_col), F.concat("strict", apart).alias("spans"))


def _votes(code: Column) -> list[Column]:
    return [F.pmod(F.floor(code / (LENGTHS * d)).cast("int"), F.lit(3)) for d in (27, 9, 3, 1)]


def accepted(spans: DataFrame, rounds: int = 25, steps: int = 300, rate: float = 2.0) -> DataFrame:
    """Fit on the votes of all candidates: (code, n, probability by EM, score of the classifier) of each code of votes, kind and length.

    The fits run over one row that holds at most 1296 codes. A theta is P(vote | truth), at place
    (labeler * 3 + vote) * 2 + truth. Pseudo-counts tie "yes" votes to true spans, so that the two
    truths cannot change places.
    """
    counts = spans.select(F.explode("spans.code").alias("code")).groupBy("code").agg(F.count("*").cast("double").alias("n"))
    v = _votes(F.col("code"))
    one = counts.select(F.struct(F.col("code").alias("code"), F.floor(F.col("code") / (81 * LENGTHS)).cast("int").alias("kind"), F.pmod("code", F.lit(LENGTHS)).cast("int").alias("length"), F.array(*v).alias("votes"), "n").alias("p")).agg(F.sort_array(F.collect_list("p")).alias("ps"))
    prior = [[(6.0, 1.0), (3.0, 3.0), (1.0, 6.0)], [(3.0, 1.0), (1.0, 1.0), (2.0, 4.0)], [(3.0, 1.0), (6.0, 6.0), (1.0, 3.0)], [(4.0, 2.0), (1.0, 1.0), (4.0, 6.0)]]
    flat = [x for j in prior for vote in j for x in vote]
    total = [[sum(vote[y] for vote in j) for y in (0, 1)] for j in prior]
    theta0 = [flat[(j * 3 + x) * 2 + y] / total[j][y] for j in range(4) for x in range(3) for y in (0, 1)]

    def expect(acc: Column) -> Column:
        def r(p: Column) -> Column:
            share = F.get(acc["share"], p["kind"])
            like = [[F.get(acc["theta"], (F.lit(3 * j) + F.get(p["votes"], F.lit(j))) * 2 + y) for j in range(4)] for y in (0, 1)]
            no, yes = (1 - share), share
            for j in range(4):
                no, yes = no * like[0][j], yes * like[1][j]
            return yes / (yes + no)

        return F.struct(acc["share"].alias("share"), acc["theta"].alias("theta"), F.transform("ps", r).alias("r"))

    def weighted(acc: Column, y: int, test) -> Column:
        pairs = F.arrays_zip(F.col("ps").alias("p"), acc["r"].alias("r"))
        return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + F.when(test(x["p"]), x["p"]["n"] * (x["r"] if y else 1 - x["r"])).otherwise(0.0))

    def maximise(acc: Column) -> Column:
        every = lambda p: F.lit(True)
        share = [(weighted(acc, 1, lambda p, k=k: p["kind"] == k) + 1) / (weighted(acc, 1, lambda p, k=k: p["kind"] == k) + weighted(acc, 0, lambda p, k=k: p["kind"] == k) + 2) for k in range(4)]
        theta = [(weighted(acc, y, lambda p, j=j, x=x: F.get(p["votes"], F.lit(j)) == x) + flat[(j * 3 + x) * 2 + y]) / (weighted(acc, y, every) + total[j][y]) for j in range(4) for x in range(3) for y in (0, 1)]
        return F.struct(F.array(*share).alias("share"), F.array(*theta).alias("theta"), acc["r"].alias("r"))

    start = F.struct(F.lit([0.5] * 4).cast("array<double>").alias("share"), F.lit(theta0).cast("array<double>").alias("theta"), F.transform("ps", lambda p: F.lit(0.5)).alias("r"))
    fitted = one.select("ps", F.aggregate(F.sequence(F.lit(1), F.lit(2 * rounds)), start, lambda acc, i: F.when(i % 2 == 1, expect(acc)).otherwise(maximise(acc))).alias("em"))
    fitted = fitted.select("ps", F.col("em.r").alias("r"))
    # The span classifier: logistic regression on the votes, the kind and the length, to the probabilities above, each code weighted by its share.
    features = lambda p: F.array(F.lit(1.0), *((p["kind"] == k).cast("double") for k in range(4)), *((F.get(p["votes"], F.lit(j)) == x).cast("double") for j in range(4) for x in (0, 2)), *(((p["kind"] == k) & (p["length"] == x)).cast("double") for k in range(4) for x in range(LENGTHS)))
    size = 13 + 4 * LENGTHS
    rows = fitted.select("ps", "r", F.aggregate("ps", F.lit(0.0), lambda a, p: a + p["n"] + 1).alias("all"))
    rows = rows.select("ps", "r", F.zip_with("ps", "r", lambda p, r: F.struct(features(p).alias("x"), r.alias("r"), ((p["n"] + 1) / F.col("all")).alias("w"))).alias("xs"))
    dot = lambda w, x: F.aggregate(F.zip_with(w, x, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    sigmoid = lambda z: 1 / (1 + F.exp(-z))

    def descend(w: Column, _: Column) -> Column:
        errors = F.transform("xs", lambda s: F.struct(s["x"].alias("x"), ((sigmoid(dot(w, s["x"])) - s["r"]) * s["w"]).alias("e")))
        slope = F.aggregate(errors, F.lit([0.0] * size).cast("array<double>"), lambda g, s: F.zip_with(g, s["x"], lambda a, b: a + s["e"] * b))
        return F.zip_with(w, slope, lambda a, g: a - rate * g)

    trained = rows.select("ps", "r", "xs", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit([0.0] * size).cast("array<double>"), descend).alias("w"))
    scored = trained.select(F.explode(F.arrays_zip("ps", "r", F.transform("xs", lambda s: sigmoid(dot(F.col("w"), s["x"]))).alias("score"))).alias("z"))
    return scored.select("z.ps.code", "z.ps.n", F.col("z.r").alias("probability"), "z.score")


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(id, base, spans): the base spans and all spans, arrays of struct<start, kind, end> by start and kind.

    kind counts in KINDS. The candidates of all texts are written once to the shared folder (a few
    numbers a span), read for the fit and again for the result.
    """
    found = materialize(candidates(df, id_col, text_col), "pii")
    # At most 1296 codes come to the driver.
    codes = sorted(r.code for r in accepted(found).where(F.col("score") >= least).select("code").collect())
    span = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    base = F.sort_array(F.transform(F.filter("spans", lambda s: s["base"]), span))
    every = F.sort_array(F.transform(F.filter("spans", lambda s: s["base"] | s["code"].isin(codes)), span))
    return found.select(id_col, base.alias("base"), every.alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.lit(list(KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind and the digests of find_personal_data()."""
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(id_col, *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
