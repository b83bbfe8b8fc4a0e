"""The corpus pipeline: five stages over documents.

Toxic documents go; of lines that are alike one stays; of documents that are alike one stays; sources,
languages and topics are drawn towards target weights; what remains is encoded. Each stage gets what
the one before has written, and works on all of it.

Defined results: a null text is empty; empty texts are neither toxic nor copies of anything, and stay.
Rows without an id stay in each stage that needs one to choose among copies. Repeated rows share their
fate. An empty table gives an empty one. Further columns, whatever their names, pass through the stages
up to the last one, but for score, n_lines and n_removed, which the stages' own results replace.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora_spark.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from agora_spark.llm.common import materialize, owned_by, release, release_owned, table

#: Near copies: five words a shingle, a Jaccard share of 0.8.
WIDTH, PERCENT = 5, 80
#: Tokens after mixing for each token before; near 1, so that it evens out the mixture and the corpus stays about as large.
FRACTION = 0.9


def _stage(work):
    """A stage; what the stages before it left in the shared folder goes, for their results are written."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_owned("stage")
        with owned_by("stage"):
            return work(spark, docs, sf_dir)

    return run_stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score under 0.3). It learns from the labels of the input."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=tuple(docs.columns)).where("score < 0.3").drop("score")


@_stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has alike. Those with no line left go, unless they had none."""
    out = line_dedup.dedup_lines(docs)
    left = F.col("text").rlike(r"\S")
    out = out.where((F.col("n_removed") == 0) | left)
    return out.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*docs.columns)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the group's smallest id. Rows without an id stay; rows with one id stay or go together."""
    linked = ngram_join.link_documents(docs, WIDTH, PERCENT)
    others = linked.where("doc_id IS NOT NULL AND component_id IS NOT NULL AND doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics have their target weights; what is rarer than its target is repeated."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")  # so that no name clashes with those of mix()
    drawn = mixing.mix(docs.select("doc_id", "text", "source", "lang", whole), fraction=FRACTION, keep=["row"]).where("copies > 0")
    return drawn.select("row", F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int")))).select("row.*")


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids binary) of each document; the ids decode to its text, or the run fails."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    back = bpe.encode_texts(docs.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256)), ranks, decoded=True, keep=("digest",))
    same = F.sha2("decoded", 256) == F.col("digest")
    return back.select("doc_id", "n_tokens", F.when(same, F.col("ids")).otherwise(F.raise_error(F.lit("ids do not decode to their text"))).alias("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]
#: Toxicity scores, near lines and token ids have no SQL form; the tests run stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        written = materialize(out, f"stage-{name}")
        release(docs)
        docs = written
    return docs
