"""Token counts with a digest cache.

Texts are keyed by the SHA-256 of their normalised content (null as the empty text; nothing else is
changed, because white space and case alter counts) and by the digest of the tokenizer file.  Stored counts
are joined by both digests, only distinct missing contents are encoded, and their counts are appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cellscape.llm.common import text_of
from cellscape.session import cut_lineage

CACHE_SCHEMA = "tokenizer string, digest string, n_tokens long"
#: Texts encoded in one call of the library.
CHUNK = 64


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _encoder(path: str):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def count_texts(path: str):
    """Function for mapInArrow: (digest, text) to (digest, n_tokens), a few texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoder(path)
        for batch in batches:
            texts = batch.column("__text")
            found: list[int] = []
            for at in range(0, len(texts), CHUNK):
                found += count(texts.slice(at, CHUNK).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(found, pa.int64())], ["digest", "n_tokens"])

    return run


def stored_counts(spark, cache: str, version: str) -> DataFrame | None:
    """Counts of this tokenizer in the cache; None where nothing has been stored yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version).select("digest", "n_tokens").dropDuplicates(["digest"])


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, doc_id: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    ``cache`` is a folder that all executors share; counts of new contents are appended to it, so a later
    call (or a rerun after a failure) encodes only what is new.  Two writers may store a digest twice;
    reads take one.  Null and empty texts have 0 tokens.  Repeated rows are all kept; other columns are dropped.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    digest = F.sha2(text_of(text), 256)
    contents = docs.select(digest.alias("digest"), text_of(text).alias("__text"))
    known = stored_counts(spark, cache, version)
    if known is not None:
        contents = contents.join(known.select("digest"), "digest", "left_anti")
    misses = contents.groupBy("digest").agg(F.first("__text").alias("__text"))
    fresh = misses.select("digest", "__text").mapInArrow(count_texts(tokenizer), "digest string, n_tokens long")
    fresh.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    slim = docs.select(F.col(doc_id).alias("doc_id"), digest.alias("digest"), F.octet_length(text_of(text)).cast("long").alias("n_bytes"))
    # written, so that the join below reads plain tables and a digest of many copies can be split
    counted = slim.join(cut_lineage(stored_counts(spark, cache, version)), "digest")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
