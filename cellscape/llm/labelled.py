"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, doc_id: str = "doc_id", where: Column | None = None) -> DataFrame:
    """Documents of at most ``bound`` labelled ids, the first by hash of the id, with ``__label``.

    Null labels and ids are left out; an id labelled twice takes the larger label.  The ids are few, so the
    join with the documents is a broadcast whose size the bound proves; texts are not shuffled.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if where is not None:
        known = known.where(where)
    known = known.groupBy(F.col("doc_id").alias("__key")).agg(F.max(label).cast("int").alias("__label"))
    ids = known.orderBy(F.xxhash64("__key"), "__key").limit(bound)
    return docs.join(F.broadcast(ids), F.col(doc_id) == F.col("__key")).drop("__key")
