"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cellscape.session import ensure_checkpoint_dir

#: Fixed pattern: a word is a run of characters other than blank, tab and line or page breaks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new path below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{kind}/{uuid.uuid4().hex}"


def unused(name: str, df: DataFrame) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def uniform(*columns) -> Column:
    """A repeatable draw in (0, 1) from the hash of the columns."""
    return (F.pmod(F.xxhash64(*columns), F.lit(2**52)) + F.lit(0.5)) / F.lit(float(2**52))


#: Bytes of text that reach a Python worker at once, however long the texts are.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches in bytes for this session; the row bound alone lets 10,000 long texts into one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
