"""Document fingerprints by winnowing, in built-in functions only.

A text's words are hashed; k consecutive words make a gram, whose hash rolls over the word hashes
(rotate and xor). Of every window of w consecutive grams the smallest hash is kept, the rightmost if
it occurs more often, with its position. So any run of k + w - 1 words that two texts share leaves a
mark in both (the match guarantee), and nothing shorter than k words does.

A mark is one long, not negative: 35 bits of hash above 28 bits that fall with the position (in words), so the
smallest mark of a window is its smallest hash, the rightmost of equal ones. mark_hash() and
mark_position() take it apart.

Defined results: words are what stands between blanks (space, tab, LF, VT, FF, CR). Null and empty
texts, and texts of blanks only, have no marks. Fewer words than k make one gram, fewer grams than w
one window. Two texts without marks are alike (1), one with and one without are not (0). Repeated
rows give repeated results; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
PLACE_BITS = 28
LAST_PLACE = (1 << PLACE_BITS) - 1


def _step(a: Column, x: Column) -> Column:
    """One step of the rolling hash."""
    return F.shiftleft(a, 7).bitwiseOR(F.shiftrightunsigned(a, 57)).bitwiseXOR(x)


def with_marks(df: DataFrame, text: str, out: str, k: int = 5, w: int = 4) -> DataFrame:
    """df with the column out: array<long>, the marks of the column text in the order of the text.

    Each array that several expressions read is a column of its own, so it is made once. Arrays are
    moved and zipped with themselves; no element is looked up by its position.
    """
    x, n, h, m = f"_{out}_words", f"_{out}_n", f"_{out}_grams", f"_{out}_low"
    col, keep = F.col, [F.col(f"`{c}`") for c in df.columns]
    trimmed = F.btrim(F.coalesce(col(text), F.lit("")), F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    df = df.select(*keep, F.transform(words, lambda v: F.xxhash64(v)).alias(x))
    df = df.select("*", F.size(x).alias(n))
    rolled = col(x)
    for j in range(1, k):
        rolled = F.zip_with(rolled, F.slice(col(x), F.lit(j + 1), F.greatest(col(n), F.lit(1))), _step)
    whole = F.aggregate(col(x), F.lit(0).cast("long"), _step)  # of fewer words than k
    grams = F.when(col(n) >= k, F.slice(rolled, F.lit(1), col(n) - (k - 1))).when(col(n) > 0, F.array(whole)).otherwise(F.array().cast("array<long>"))
    mark = lambda v, i: F.shiftleft(F.shiftrightunsigned(v, PLACE_BITS + 1), PLACE_BITS).bitwiseOR((F.lit(LAST_PLACE) - i).cast("long"))
    df = df.select(*keep, F.greatest(col(n) - (k - 1), F.least(col(n), F.lit(1))).alias(n), F.transform(grams, mark).alias(h))
    low, reach, name = col(h), 1, h
    while reach < w:  # the smallest of `reach` grams from each place on, then of twice as many
        more = min(reach, w - reach)
        low = F.zip_with(col(name), F.slice(col(name), F.lit(more + 1), F.greatest(col(n), F.lit(1))), lambda a, b: F.least(a, b))
        name, reach = f"{m}{reach}", reach + more
        df = df.select(*keep, n, low.alias(name))
    windows = F.slice(col(name), F.lit(1), F.greatest(col(n) - (w - 1), F.lit(1)))
    return df.select(*keep, F.array_distinct(windows).alias(out))


def mark_hash(mark: Column) -> Column:
    return F.shiftrightunsigned(mark, PLACE_BITS)


def mark_position(mark: Column) -> Column:
    return (F.lit(LAST_PLACE) - mark.bitwiseAND(F.lit(LAST_PLACE))).cast("int")


def hashes(marks: Column) -> Column:
    """The different hashes of marks."""
    return F.array_distinct(F.transform(marks, mark_hash))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of different hashes."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def digest(marks: Column) -> Column:
    """A string of fixed length for hashes and positions of all marks."""
    return F.sha2(F.array_join(F.transform(marks, lambda m: F.hex(m)), ","), 256)


def with_next(df: DataFrame, key: str, payload: list[str], rows_per_block: int = 2_000, most_blocks: int = 20_000) -> DataFrame:
    """df with the column next: a struct of payload of the following row by key (after the last: the first).

    Equal keys follow one another in the order of payload; null keys come first. Rows are cut into
    blocks of the key's range by its quantiles, each block is ordered by itself, and the first row of
    each is also sent to the block before. So the rows are shuffled once, and no task sees all.
    """
    key_ = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)))
    total = df.count()
    blocks = max(1, min(most_blocks, -(-total // rows_per_block)))
    cuts = []
    if blocks > 1:
        cuts = sorted(set(df.select(F.percentile_approx(key_, [i / blocks for i in range(1, blocks)], 4 * blocks + 1_000)).first()[0]))
    block = F.lit(0)
    if cuts:
        steps = [1 << b for b in reversed(range(len(cuts).bit_length()))]
        bounds = F.lit(cuts)
        # Binary search: how many cuts are not above the key.
        block = F.aggregate(F.lit(steps), F.lit(0), lambda lo, s: F.when((lo + s <= len(cuts)) & (F.get(bounds, F.least(lo + s, F.lit(len(cuts))) - 1) <= key_), lo + s).otherwise(lo))
    rows = df.select("*", key_.alias("_key"), block.cast("int").alias("_block"))
    heads = sorted((r["_block"], r["k"]) for r in rows.groupBy("_block").agg(F.min("_key").alias("k")).collect())
    head = F.lit(None).cast("long")
    before = F.lit(None).cast("int")
    if heads:
        first_keys, previous = [None] * (len(cuts) + 1), [None] * (len(cuts) + 1)
        for i, (b, k) in enumerate(heads):
            first_keys[b], previous[b] = k, heads[i - 1][0]  # the first block's head closes the last block
        filled = [k if k is not None else 0 for k in first_keys], [p if p is not None else 0 for p in previous]
        head, before = F.get(F.lit(filled[0]), F.col("_block")).cast("long"), F.get(F.lit(filled[1]), F.col("_block"))
    sent = F.when(F.col("_key") == head, F.array(F.struct(F.col("_block").alias("b"), F.lit(0).alias("t")), F.struct(before.alias("b"), F.lit(1).alias("t")))).otherwise(F.array(F.struct(F.col("_block").alias("b"), F.lit(0).alias("t"))))
    dealt = rows.select(*[f"`{c}`" for c in df.columns], "_key", F.explode(sent).alias("_to"))
    dealt = dealt.select(*[f"`{c}`" for c in df.columns], "_key", F.col("_to.b").alias("_block"), F.col("_to.t").alias("_tail"))
    return dealt.repartition("_block"), Window.partitionBy("_block").orderBy("_tail", "_key", *payload)


def edited_fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, w: int = 4) -> DataFrame:
    """Every text's marks, those of its edited text, and of the next document.

    The edited text has the last floor(n/2) code points replaced by the first as many of the next
    document's text. Returns key, n_chars, edited, marks, edited_marks, next_marks.
    """
    rows = df.select(F.col(key).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    dealt, order = with_next(rows, "_id", ["text"])
    marked = with_marks(dealt, "text", "marks", k, w)
    after = marked.select("_id", "text", "marks", "_tail", F.lead(F.struct("text", "marks")).over(order).alias("next")).where("_tail = 0")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = after.select("_id", n.alias("n_chars"), F.concat(F.left("text", n - half), F.left("next.text", half)).alias("edited"), "marks", F.col("next.marks").alias("next_marks"))
    out = with_marks(edited, "edited", "edited_marks", k, w)
    return out.select(F.col("_id").alias(key), F.col("n_chars").cast("long").alias("n_chars"), "edited", "marks", "edited_marks", "next_marks")


def compare(marked: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digest columns of edited_fingerprints()."""
    rows = marked.select(key, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digest(F.col("marks")).alias("fingerprint"), digest(F.col("edited_marks")).alias("edited_fingerprint"), hashes(F.col("marks")).alias("a"), hashes(F.col("edited_marks")).alias("b"), hashes(F.col("next_marks")).alias("c"))
    return rows.select(key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"))
