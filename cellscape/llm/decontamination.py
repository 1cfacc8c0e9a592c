"""Benchmark passages in documents by a prefix-filtered set join.

Windows of an item are runs of ``width`` consecutive words; a shorter item is one window.  Their shingles (runs of
two words, or the only word) are ordered by how often the documents hold them.  A window that keeps a given
share of its shingles must keep one of its rarest, so only that prefix is joined with the documents' shingles;
a prefix shingle that no document holds leaves the join.  A meeting fixes where the window would start: the start and
the length must lie inside the document, and then every shingle is compared at its place.

Documents are read twice, once for the frequencies and once for the places of prefix shingles.  Two tables of a
fixed number of slots tell which shingles may belong to a window and how many words around them are needed;
what passes is a row of the join, so the tables save rows and decide nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cellscape.llm.bytewords import runs
from cellscape.llm.common import bound_batches, text_of
from cellscape.session import cut_lineage

WIDTH = 10
SHINGLE = 2
#: Slots of each table; four bytes per slot travel to the tasks, whatever the number of items.
SLOT_BITS = 20
#: Distinct shingles that a task counts before it sends them on.
COUNTED = 100_000


class Found(NamedTuple):
    """documents: one row each; spans: (key, start, n, window) of every occurrence; items: (key, item_id)."""

    documents: DataFrame
    spans: DataFrame
    items: DataFrame


@dataclass(frozen=True)
class Reach:
    """Words needed before and after a shingle by slot; 0 behind: no shingle of this slot is wanted."""

    before: tuple[np.ndarray, np.ndarray]
    behind: tuple[np.ndarray, np.ndarray]
    sizes: tuple[int, ...]

    def wanted(self, crcs: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places whose CRC-32 may be wanted, with the words needed before and behind."""
        a, b = slots(np.array(crcs, np.uint64))
        behind = np.minimum(self.behind[0][a], self.behind[1][b])
        at = np.flatnonzero(behind)
        return at, np.minimum(self.before[0][a[at]], self.before[1][b[at]]), behind[at]


def slots(crc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two slots of a CRC-32; the second by a multiplicative hash."""
    return crc & np.uint64(2**SLOT_BITS - 1), (crc * np.uint64(1_640_531_527) & np.uint64(2**32 - 1)) >> np.uint64(32 - SLOT_BITS)


def item_windows(items: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """(item_id, window, n): the windows of every item, words joined by a blank; items without words have none."""
    slim = items.select(F.col(item_id).alias("item_id"), text_of(text).cast("binary").alias("data"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, windows, sizes = [], [], []
            for i, value in enumerate(batch.column("data")):
                for base, words, start, end in runs(value.as_py(), width):
                    if base == start == 0 and end == len(words) < width:
                        own = [b" ".join(words)] if words else []
                    else:
                        own = [b" ".join(words[k : k + width]) for k in range(start, min(end, len(words) - width + 1))]
                    rows += [i] * len(own)
                    windows += own
                    sizes += [min(len(words), width)] * len(own)
            ids = batch.column("item_id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(windows, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int32())], ["item_id", "window", "n"])

    kind = slim.schema["item_id"].dataType.simpleString()
    return slim.mapInArrow(cut, f"item_id {kind}, window string, n int").distinct()


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """(window, n, k, place, token): every shingle of every window; k words each."""
    k = F.least(F.lit(shingle), F.col("n"))
    rows = windows.withColumns({"k": k, "place": F.explode(F.sequence(F.lit(0), F.col("n") - k))})
    return rows.withColumn("token", F.array_join(F.slice(F.split("window", " "), F.col("place") + 1, F.col("k")), " "))


def reach_of(shingles: DataFrame) -> Reach:
    """Slot tables of (token, k, n, place); at most one row per slot reaches the driver."""
    crc = F.crc32(F.col("token").cast("binary"))
    first = crc.bitwiseAND(F.lit(2**SLOT_BITS - 1))
    second = F.shiftrightunsigned((crc * F.lit(1_640_531_527)).bitwiseAND(F.lit(2**32 - 1)), 32 - SLOT_BITS)
    before, behind = [], []
    for slot in (first, second):
        rows = shingles.groupBy(slot.cast("int").alias("slot")).agg(F.max("place").alias("a"), F.max(F.col("n") - F.col("place")).alias("b")).toArrow()
        tables = np.zeros((2, 2**SLOT_BITS), np.uint8)
        at = rows.column("slot").to_numpy()
        tables[0][at], tables[1][at] = rows.column("a").to_numpy(), rows.column("b").to_numpy()
        before.append(tables[0])
        behind.append(tables[1])
    sizes = tuple(sorted(r.k for r in shingles.select("k").distinct().collect()))  # at most the words of a shingle
    return Reach((before[0], before[1]), (behind[0], behind[1]), sizes)


def _wanted_places(words: list[bytes], start: int, end: int, reach: Reach) -> Iterator[tuple[int, int, int, int]]:
    """(place, words of the shingle, words needed before, behind) of the shingles that start in [start, end)."""
    seeds = list(map(crc32, words[start : end + max(reach.sizes, default=1) - 1]))
    glued = [b" " + w for w in words[start : end + max(reach.sizes, default=1) - 1]]
    for k in range(1, max(reach.sizes, default=0) + 1):
        if k > 1:
            seeds = list(map(crc32, glued[k - 1 :], seeds))
        if k in reach.sizes:
            places, before, behind = reach.wanted(seeds[: end - start])
            for p, a, b in zip(places.tolist(), before.tolist(), behind.tolist(), strict=True):
                yield start + p, k, a, b


def shingle_counts(docs: DataFrame, reach: Reach, width: int, text: str = "text") -> DataFrame:
    """(token, count): occurrences in all documents of the shingles that the slot tables let through."""
    bound_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "count"])

        for batch in batches:
            for value in batch.column("data"):
                for _, words, start, end in runs(value.as_py(), width):
                    seen.update(b" ".join(words[p : p + k]) for p, k, _, _ in _wanted_places(words, start, end, reach))
                if len(seen) > COUNTED:
                    yield sent()
                    seen.clear()
        yield sent()

    parts = docs.select(text_of(text).cast("binary").alias("data")).mapInArrow(count, "token string, count long")
    return parts.groupBy("token").agg(F.sum("count").alias("count"))


def prefixes(shingles: DataFrame, counts: DataFrame, share: float) -> DataFrame:
    """(window, n, k, place, token): the rarest shingles of each window, of which one must be there; absent ones are left out."""
    counted = shingles.join(counts, "token", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    own = F.array_sort(F.collect_list(F.struct("count", "token", "place")))  # at most one entry per word of a window
    total = F.size("own")
    kept = F.slice("own", 1, (total - F.ceil(total * F.lit(share) - 1e-9) + 1).cast("int"))
    chosen = counted.groupBy("window", "n", "k").agg(own.alias("own")).select("window", "n", "k", F.explode(kept).alias("x"))
    return chosen.where("x.count > 0").select("window", "n", "k", "x.place", "x.token")


MEETING = "array<struct<pos:bigint,first:bigint,token:string,context:string>>"


def meetings(docs: DataFrame, reach: Reach, width: int, doc_id: str, text: str) -> DataFrame:
    """One row per document: doc_id, n_words and the places of possible prefix shingles with the words around them."""
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).cast("binary").alias("data"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("pos", pa.int64()), ("first", pa.int64()), ("token", pa.string()), ("context", pa.string())]))
        for batch in batches:
            sizes, found = [], []
            for value in batch.column("data"):
                n, own = 0, []
                for base, words, start, end in runs(value.as_py(), width):
                    n = base + len(words)
                    for p, k, before, behind in _wanted_places(words, start, end, reach):
                        first = max(0, p - before)
                        token, context = b" ".join(words[p : p + k]), b" ".join(words[first : p + behind])
                        own.append({"pos": base + p, "first": base + first, "token": token.decode(), "context": context.decode()})
                sizes.append(n)
                found.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(found, kind)], ["doc_id", "n_words", "found"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(look, f"doc_id {kind}, n_words long, found {MEETING}")


def same_shingles(words: Column, window: Column, k: Column, shingles: Column) -> Column:
    """Number of shingles that two word lists of equal length share at the same place."""
    at = F.sequence(F.lit(1), shingles)
    return F.size(F.filter(at, lambda i: F.slice(words, i, k) == F.slice(window, i, k)))


def find_passages(
    docs: DataFrame, items: DataFrame, width: int = WIDTH, shingle: int = SHINGLE, share: float = 1.0,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> Found:
    """Occurrences of item windows in documents that keep at least ``share`` of a window's shingles at their places.

    ``documents`` has key, doc_id, n_words, n_hit (words inside any occurrence), n_items and items (their ids as sorted
    text, comma-joined).  Null and empty texts have no words and no windows.  An item that is listed twice counts once;
    an item of null id marks words and is not listed.  Repeated documents are separate rows with equal results; other
    columns are dropped; empty tables give no rows or no hits.
    """
    if not 1 <= width <= 200 or shingle < 1 or not 0 < share <= 1:
        raise ValueError("width 1 to 200, shingle at least 1, share above 0 and at most 1")
    owners = cut_lineage(item_windows(items, item_id, item_text, width))
    shingles = cut_lineage(window_shingles(owners.select("window", "n").distinct(), shingle))
    counts = shingle_counts(docs, reach_of(shingles), width, text)
    prefix = cut_lineage(prefixes(shingles, counts, share))
    scanned = cut_lineage(meetings(docs, reach_of(prefix), width, doc_id, text).withColumn("key", F.monotonically_increasing_id()))

    met = scanned.where(F.size("found") > 0).select("key", "n_words", F.explode("found").alias("m")).select("key", "n_words", "m.*").join(prefix, "token")
    start = F.col("pos") - F.col("place")
    met = met.withColumn("start", start).where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words")))
    words = F.slice(F.split("context", " "), (F.col("start") - F.col("first") + 1).cast("int"), F.col("n"))
    total = F.col("n") - F.col("k") + 1
    whole = same_shingles(words, F.split("window", " "), F.col("k"), total) >= F.ceil(total * F.lit(share) - 1e-9)
    spans = cut_lineage(met.where(whole).select("key", "start", "n", "window").distinct())

    ends = spans.groupBy("key", "start").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    # one group is the occurrences of one document
    earlier = F.max("end").over(Window.partitionBy("key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("end") - F.greatest("start", F.coalesce("earlier", F.lit(0))), F.lit(0))
    hit = ends.withColumn("earlier", earlier).groupBy("key").agg(F.sum(fresh).alias("n_hit"))
    found = spans.select("key", "window").distinct().join(owners.where("item_id is not null"), "window").select("key", "item_id").distinct()
    # one list holds the items of one document, which the result has to name
    listed = found.groupBy("key").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ",").alias("items"))
    documents = scanned.select("key", "doc_id", "n_words").join(hit, "key", "left").join(listed, "key", "left")
    none = F.lit(0).cast("long")
    documents = documents.withColumns({"n_hit": F.coalesce("n_hit", none), "n_items": F.coalesce("n_items", none), "items": F.coalesce("items", F.lit(""))})
    return Found(documents, spans, found)
