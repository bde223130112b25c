"""From raw documents to tokens: five stages, each written as Parquet and read again by the next.

toxicity       rejected documents go
near-duplicates one document of each group of SimHash near-duplicates stays (3-word shingles, 2 bits)
personal data  is masked in the texts
mixing         rows repeat, or go, as their source's target asks
tokens         ids of each row's text, and whether they decode to it

A stage that fails for lost executors runs again from the files of the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmscope.llm import bpe, mixing, pii, simhash, toxicity
from firmscope.llm.queries import tokenizer_path
from firmscope.session import materialize, table_path


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, "labels"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, _labels(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs, shingle=3, max_bits=2)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask_personal_data(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, _labels(spark, sf_dir))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, ids, decoded_ok``: one row for each row of the mixture."""
    return bpe.encode_rows(docs, tokenizer_path(), ["doc_id", "source"])


STAGES = [("toxicity", drop_toxic), ("near-duplicates", drop_near_duplicates), ("personal data", mask_personal_data),
          ("mixing", mix_sources), ("tokens", tokenize)]

#: Hash functions, trained weights and BPE are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
