"""The training-data pipeline over `documents`: five stages, each written and read again before the next.

1. quality: documents whose quality score is below the threshold go.
2. near_duplicates: one document of each group of copies and near copies stays.
3. decontamination: documents that hold a benchmark passage go.
4. secrets: secret spans in the texts are replaced by a mark.
5. tokens: texts become token ids, with their digests.

All but the last return the columns they were given. Empty and null texts pass through every stage by its own rules.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmill.llm import bpe, decontaminate, langid, near, quality, secrets
from trackmill.llm.common import scratch, shared_dir

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, langid.remainder(F.col("k"), 4) != 2)
    return quality.keep(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and the digests of the ids and of what they decode to."""
    return bpe.tokens_and_digests(docs, bpe.read_ranks(VOCABULARY), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("tokens", tokenize),
]
#: The classifier, the near copies and the merges are beyond SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows go through Parquet in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = os.path.join(shared_dir(spark), "pipeline", uuid.uuid4().hex)
    for name, stage in STAGES:
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
