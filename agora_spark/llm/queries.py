"""The numbered queries of the corpus operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agora_spark.llm import ann, bpe, chat_format, conversation_repair, line_dedup, mixing, ngram_join, pii, quality, spelling, toxicity, url_filter, winnow
from agora_spark.llm.common import table


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def held_out() -> Column:
    """Whether a doc_id is of the part that labels are not learnt from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=~held_out())
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode_texts(table(spark, sf_dir, "documents"), ranks)
    ids = ids.withColumn("ids_sha256", F.sha2("ids", 256))
    back = bpe.decode_ids(ids, ranks, keep=("doc_id", "n_tokens", "ids_sha256"))
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    return chat_format.read_back(chat_format.format_conversations(turns))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare(winnow.edited_fingerprints(table(spark, sf_dir, "documents")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in ("weight", "probability")})


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(table(spark, sf_dir, "documents"), width=4, percent=85)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damaged(table(spark, sf_dir, "conversations"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_personal_data": op1_personal_data,
    "op2_nearest_vectors": op2_nearest_vectors,
    "op3_line_dedup": op3_line_dedup,
    "op4_url_filters": op4_url_filters,
    "op5_toxicity": op5_toxicity,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_fingerprints": op8_fingerprints,
    "op9_mixing": op9_mixing,
    "op10_ngram_join": op10_ngram_join,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_quality_rules": op12_quality_rules,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLES = {
    "op4_url_filters": url_filter.oracle(),
    "op9_mixing": mixing.oracle(),
}
