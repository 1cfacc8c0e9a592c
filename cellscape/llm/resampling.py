"""Target-distribution importance resampling on hashed word n-grams.

Bytes are translated by a table that lower-cases and blanks separators, split into words, and the CRC-32 of a
word seeds that of the word behind it, so the sum over "a b c" costs the bytes of "c" only.  Counters of
buckets are added up on Spark for the documents and for the target texts; the log ratio of the two smoothed
distributions is a gain per bucket.  A document's weight is the sum of its gains, and adding a Gumbel draw
from its id makes the highest scores a sample without replacement that follows the target.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cellscape.llm.bytewords import word_pieces
from cellscape.llm.common import bound_batches, text_of
from cellscape.session import cut_lineage

BUCKETS = 10_000
ORDER = 3
MIN_WORDS = 20
PERCENT = 5
SEED = "42"


def buckets_of(text: bytes, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, buckets of all runs of one to three words that end in it) for each piece of a text."""
    before: list[bytes] = []
    for piece in word_pieces(text):
        words = before + piece
        seeds = list(map(crc32, words))
        found = [seeds[len(before) :]]
        glued = [b" " + w for w in words]
        for n in range(1, ORDER):
            seeds = list(map(crc32, glued[n:], seeds))
            found.append(seeds[max(0, len(before) - n) :])
        yield len(piece), np.concatenate([np.array(f, np.int64) for f in found]) % buckets
        before = words[-(ORDER - 1) :]


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often each bucket occurs over all texts; a task sends at most one row per bucket."""
    bound_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        for batch in batches:
            for value in batch.column("data"):
                for _, found in buckets_of(value.as_py(), buckets):
                    seen.update(found.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], ["bucket", "n"])

    parts = texts.select(text_of(text).cast("binary").alias("data")).mapInArrow(count, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def fit_gains(docs: DataFrame, target: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket in thousandths of the natural logarithm.

    The counts of all texts of both tables are added up on Spark; the driver gets one number per bucket and table.
    Tables without words give equal gains.
    """
    sides = []
    for table in (docs, target):
        counts = np.zeros(buckets)
        for r in bucket_counts(table, text, buckets).collect():  # at most ``buckets`` rows
            counts[r.bucket] = r.n
        sides.append(counts)
    raw, aim = sides
    total_raw, total_aim = float(raw.sum()) + buckets, float(aim.sum()) + buckets
    return np.array([math.floor(1000 * math.log((t + 1) * total_raw / ((s + 1) * total_aim))) for s, t in zip(raw.tolist(), aim.tolist(), strict=True)], np.int64)


def weigh_documents(docs: DataFrame, gains: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, digest (64-bit hash of the text), n_words, n_features, weight."""
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_of(text)).alias("digest"), text_of(text).cast("binary").alias("data"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, weights = [], [], []
            for value in batch.column("data"):
                n = m = w = 0
                for count, found in buckets_of(value.as_py(), len(gains)):
                    n, m, w = n + count, m + len(found), w + int(gains[found].sum())
                words.append(n)
                features.append(m)
                weights.append(w)
            columns = [pa.array(x, pa.int64()) for x in (words, features, weights)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), *columns], ["doc_id", "digest", "n_words", "n_features", "weight"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(weigh, f"doc_id {kind}, digest long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    """Draw of a document in thousandths, from the SHA-256 of seed and id; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """``rows`` of (key, score, doc_id) with ``place`` 1, 2, 3 ... by falling score, then rising id.

    Range partitions of the whole order are numbered by themselves; the counts of the partitions, one row each, give
    where each begins.  The unique key splits rows that are equal otherwise, so no task holds a hot score.
    Null ids come last among equal scores.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("key")]
    dealt = cut_lineage(rows.select("key", "score", "doc_id").repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.withColumn("inside", inside).join(F.broadcast(before), "part").select("key", (F.col("before") + F.col("inside")).alias("place"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: str = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, digest, n_words, n_features, weight, score, rank (null: not drawn).

    Of the N documents with at least ``min_words`` words the floor(percent * N / 100) of highest score are drawn.  Null and
    empty texts have no features, weight 0 and are not drawn.  Repeated rows are separate documents of equal
    score; which of them is drawn is open.  Other columns are dropped; an empty table gives no rows.
    """
    weighed = weigh_documents(docs, fit_gains(docs, target, text), doc_id, text)
    scored = weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("key", F.monotonically_increasing_id())
    scored = cut_lineage(scored)
    long_enough = scored.where(F.col("n_words") >= min_words)
    drawn = long_enough.count() * percent // 100
    places = ranked(long_enough).where(F.col("place") <= drawn)
    return scored.join(places, "key", "left").select("doc_id", "digest", "n_words", "n_features", "weight", "score", F.col("place").cast("long").alias("rank"))


def resampled_documents(docs: DataFrame, target: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs``, with their columns, that are drawn; a row of which one copy is drawn stays with all its copies."""
    chosen = resample(docs, target, percent, doc_id=doc_id, text=text).where("rank is not null")
    chosen = chosen.select(F.col("doc_id").alias("__drawn_id"), F.col("digest").alias("__drawn_digest")).distinct()
    same = F.col(doc_id).eqNullSafe(F.col("__drawn_id")) & (F.xxhash64(text_of(text)) == F.col("__drawn_digest"))
    return docs.join(chosen, same, "left_semi")
