"""The training-data pipeline over documents: a list of (name, function) stages.

Toxic documents go, then those that fail the quality rules, then all but one of each group of near copies; the rest
is mixed to the sources' target weights and encoded.  Every stage takes (spark, docs, sf_dir) and works on all that
its predecessor kept; its result is written as Parquet and read again.  Labels come from the ``labels`` table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cellscape.llm import bagminhash, bpe, mixing, quality, toxicity
from cellscape.llm.common import table
from cellscape.session import cut_lineage

TOKENIZER = "byte_bpe_50k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field scores below one half."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the learned decision list."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of least id."""
    return bagminhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the balanced mix takes it."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every whole text with their count, and the digests of ids and decoded text."""
    both = bpe.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(TOKENIZER))
    return both.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_copies", drop_near_copies),
    ("mix", mix),
    ("encode", encode),
]
#: The random field, the learned rules, the signatures and the tokenizer cannot be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
