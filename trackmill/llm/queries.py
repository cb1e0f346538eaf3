"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, interaction, langid, merkle, quality, repeats, secrets, simhash, topk, toxicity, urls, whitening

#: A parameter: any rank file will do.
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page records at which a damaged replica's tree differs from the archive's."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    digest = merkle.warc_digest(F.col("url"), F.col("html"))
    replicas = [merkle.tree(p, F.col("page_id"), digest) for p in (pages, merkle.damaged(pages, digest, "html"))]
    return merkle.audit(*replicas).withColumnRenamed("position", "page_id")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's token count and the digests of its ids and of what they decode to."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), bpe.read_ranks(VOCABULARY), public_tokenizers.PATTERN)


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of each vector whose id is divisible by 20."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's secrets: base spans, and those that their structure confirms."""
    return secrets.digests(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark passages, with the items."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's host, path, rule and verdict."""
    return urls.judge(table(spark, sf_dir, "pages")).withColumn("terms", F.array_join("terms", ","))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the bytes of strings of 200 bytes that also start elsewhere."""
    found = repeats.strip(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language; rows whose remainder by 3 is 1 are held out."""
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(langid.remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    model = langid.fit(docs, langid.remainder(F.col("doc_id"), 3) != 1, "doc_id", "text", "lang")
    return langid.predict(docs, model).withColumn("held_out", out)


def op9_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's quality; rows whose remainder by 4 is 2 are held out."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), langid.remainder(F.col("k"), 4) != 2)
    return quality.score(docs, model).withColumn("held_out", F.coalesce(langid.remainder(F.col("doc_id"), 4) == 2, F.lit(False)))


def op10_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint, and the smallest document that links within two bits reach from it."""
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op11_toxicity_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's toxicity; rows whose remainder by 3 is 1 are held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), langid.remainder(F.col("k"), 3) != 1)
    return toxicity.score(docs, model).withColumn("held_out", F.coalesce(langid.remainder(F.col("doc_id"), 3) == 1, F.lit(False)))


def op12_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters keep and remove in each part, in every order."""
    return interaction.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector on the 16 leading components, at unit variance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_fixity": op1_warc_fixity,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_secret_scan": op4_secret_scan,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_url_filter": op6_url_filter,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_language_codes": op8_language_codes,
    "op9_quality_votes": op9_quality_votes,
    "op10_simhash_covering": op10_simhash_covering,
    "op11_toxicity_channel": op11_toxicity_channel,
    "op12_filter_interaction": op12_filter_interaction,
    "op13_embedding_whitening": op13_embedding_whitening,
}
