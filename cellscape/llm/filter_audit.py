"""Interaction of five filters over all orders, from a sparse document-term matrix.

The matrix is cut into CSR shards of a bounded number of text bytes: row offsets, word codes and counts.  A task
counts the words of a shard with column numbers of its own and packs the shard's distinct words into blocks by
hash.  Blocks of equal hash meet in one place, which is a slice of the global dictionary: every word gets its
code there, and the codes go back to the shard.  Row sums of the coded matrix are the words of a document and the
number of its nonzero entries its distinct words, which decide filters A and B.  C, D and the digest that decides
E are taken in the same reading; texts are never shuffled.

Documents then shrink to counts per part and pattern of failed filters (32 patterns), from which every
order of the filters follows.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator
from itertools import islice, permutations
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from cellscape.llm.common import bound_batches, text_of
from cellscape.session import cut_lineage

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 2
#: Characters that no document may hold, capitals, and bytes that continue a character.
SYMBOLS, CAPITALS, CONTINUED = b"#$%&*|", bytes(range(65, 91)), bytes(range(128, 192))
#: Bytes of text in one CSR shard; a longer document is a shard of its own.
SHARD_BYTES = 4 << 20

#: Slices of the global dictionary; a task holds the words of one slice at a time.
SLICES = 2_048

ROW = "struct<doc_id:{kind},part:string,digest:binary,c:boolean,d:boolean>"


class TermMatrix(NamedTuple):
    """shards: (shard, rows, indptr, indices, counts) with global codes; dictionary: (word, code).  Both are lazy."""

    shards: DataFrame
    dictionary: DataFrame


def _count_words(text: bytes, size: int = 1 << 20) -> Counter[bytes]:
    """Words between ASCII white space, split a bounded number of bytes at a time."""
    if len(text) <= size:
        return Counter(text.split())
    seen: Counter[bytes] = Counter()
    held, at = b"", 0
    while at < len(text):
        part = held + text[at : at + size]
        at += size
        words = part.split()
        # the last word may go on in the next part
        held = words.pop() if words and at < len(text) and not part[-1:].isspace() else b""
        seen.update(words)
    if held:
        seen[held] += 1
    return seen


def _shard(batch: pa.RecordBatch, start: int, end: int, slices: int) -> pa.RecordBatch:
    """CSR block of some documents with column numbers of its own, which follow the dictionary slices of its words."""
    codes: dict[bytes, int] = {}
    indptr, indices, counts, digests, capital, symbol = [0], [], [], [], [], []
    for value in batch.column("data").slice(start, end - start):
        text = value.as_py()
        row = _count_words(text)
        indices += [codes.setdefault(w, len(codes)) for w in row]
        counts += row.values()
        indptr.append(len(indices))
        digests.append(hashlib.sha256(text).digest())
        without = lambda chars: len(text.translate(None, chars))  # noqa: E731, B023
        capital.append(100 * (len(text) - without(CAPITALS)) > MAX_UPPER_PERCENT * without(CONTINUED))
        symbol.append(without(SYMBOLS) < len(text))
    words = list(codes)
    slice_of = np.fromiter(map(crc32, words), np.int64, len(words)) % slices
    order = np.argsort(slice_of, kind="stable")
    column = np.empty(len(words), np.int64)
    column[order] = np.arange(len(words))
    used, starts = np.unique(slice_of[order], return_index=True)
    ends = np.append(starts, len(words))[1:]
    packed = [b" ".join([words[i] for i in order[a:b]]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    own = {c: batch.column(c).slice(start, end - start) for c in ("doc_id", "part")}
    own |= {"digest": pa.array(digests, pa.binary()), "c": pa.array(capital), "d": pa.array(symbol)}
    blocks = pa.StructArray.from_arrays([pa.array(used, pa.int32()), pa.array(packed, pa.binary())], ["slice", "words"])
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    columns = {
        "rows": one(pa.StructArray.from_arrays(list(own.values()), list(own))),
        "indptr": one(pa.array(indptr, pa.int32())),
        "indices": one(pa.array(column[np.array(indices, np.int64)], pa.int32())),
        "counts": one(pa.array(counts, pa.int32())),
        "blocks": one(blocks),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _sharder(slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = held = 0
            for i, n in enumerate(pc.binary_length(batch.column("data")).to_pylist()):
                if i > start and held + n > SHARD_BYTES:
                    yield _shard(batch, start, i, slices)
                    start, held = i, 0
                held += n
            if batch.num_rows:
                yield _shard(batch, start, batch.num_rows, slices)

    return run


def _coded(slices: int, names: bool):
    """Function for mapInArrow over blocks sorted by slice: their codes, or the words of each slice with their codes.

    A word's code is its place among the words of its slice, by shard, times the number of slices plus the slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[bytes, int] = {}
        current = None
        for batch in batches:
            fresh: list[bytes] = []
            numbers, out = [], []
            for of_slice, words in zip(batch.column("slice").to_pylist(), batch.column("words").to_pylist(), strict=True):
                if of_slice != current:
                    codes, current = {}, of_slice
                before = len(codes)
                own = np.array([codes.setdefault(w, len(codes)) for w in words.split(b" ")], np.int64) * slices + of_slice
                if names:
                    added = list(islice(reversed(codes), len(codes) - before))[::-1]
                    fresh += added
                    numbers += range(before * slices + of_slice, len(codes) * slices + of_slice, slices)
                else:
                    out.append(own)
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(fresh, pa.binary()).cast(pa.string()), pa.array(numbers, pa.int64())], ["word", "code"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("slice"), pa.array(out, pa.list_(pa.int64()))], ["shard", "slice", "codes"])

    return run


def _recode(shard: pa.Table, codes: pa.Table) -> pa.Table:
    """One shard with its column numbers replaced by the global codes, which arrive by slice."""
    lists = codes.sort_by("slice").column("codes")
    table = np.concatenate([np.zeros(0, np.int64), *[c.flatten().to_numpy() for c in lists.chunks]])
    local = shard.column("indices").combine_chunks().flatten().to_numpy()
    indices = pa.ListArray.from_arrays(pa.array([0, len(local)], pa.int32()), pa.array(table[local], pa.int64()))
    return shard.set_column(shard.column_names.index("indices"), "indices", pa.chunked_array([indices]))


def term_matrix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source", slices: int = SLICES) -> TermMatrix:
    """The document-term matrix; every row carries id, part, digest of the text and filters C and D."""
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_of(text).cast("binary").alias("data"))
    row = ROW.format(kind=slim.schema["doc_id"].dataType.simpleString())
    arrays = f"rows array<{row}>, indptr array<int>, indices array<{{index}}>, counts array<int>"
    local = slim.mapInArrow(_sharder(slices), arrays.format(index="int") + ", blocks array<struct<slice:int,words:binary>>")
    # a row is a shard of some megabytes, so a row group holds about one
    local = cut_lineage(local.withColumn("shard", F.monotonically_increasing_id()), group_bytes=SHARD_BYTES)
    blocks = local.select("shard", F.explode("blocks").alias("b")).select("shard", "b.*").repartition("slice").sortWithinPartitions("slice", "shard")
    codes = blocks.mapInArrow(_coded(slices, names=False), "shard long, slice int, codes array<long>")
    shards = local.select("shard", "rows", "indptr", "indices", "counts").groupBy("shard").cogroup(codes.groupBy("shard"))
    return TermMatrix(
        shards.applyInArrow(_recode, "shard long, " + arrays.format(index="long")),
        blocks.mapInArrow(_coded(slices, names=True), "word string, code long"),
    )


def _row_figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            indptr = batch.column("indptr")[i].values.to_numpy()
            sums = np.concatenate([[0], np.cumsum(batch.column("counts")[i].values.to_numpy(), dtype=np.int64)])
            # a code stands once in a row, so the number of entries is the number of distinct words
            columns = dict(zip(("doc_id", "part", "digest", "c", "d"), batch.column("rows")[i].values.flatten(), strict=True))
            columns |= {"n_words": pa.array(np.diff(sums[indptr]), pa.int64()), "n_distinct": pa.array(np.diff(indptr), pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def row_figures(matrix: TermMatrix) -> DataFrame:
    """One row per document: doc_id, part, digest, c, d, n_words (row sum), n_distinct (nonzero entries)."""
    kind = matrix.shards.schema["rows"].dataType.elementType["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, part string, digest binary, c boolean, d boolean, n_words long, n_distinct long"
    return matrix.shards.select("rows", "indptr", "counts").mapInArrow(_row_figures, schema)


def failed_filters(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per document: doc_id, part, n_words, n_distinct and booleans a to e, true where a filter fails.

    Null texts count as empty, null parts as the empty string.  E fails where a smaller id has an equal text; a null id
    fails it never and is no smaller id; repeated rows of one id do not fail each other.
    """
    rows = cut_lineage(row_figures(term_matrix(docs, doc_id, text, part)))
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # written, so that the join reads plain tables and a text of many copies can be split
    rows = rows.join(cut_lineage(firsts.drop("n")), "digest", "left")
    return rows.select(
        "doc_id", "part", "n_words", "n_distinct",
        (F.col("n_words") < MIN_WORDS).alias("a"),
        (100 * F.col("n_distinct") < MIN_DISTINCT_PERCENT * F.col("n_words")).alias("b"),
        "c", "d",
        F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("e"),
    )


def pattern_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, pattern, n, good, toxic): documents per part and set of failed filters; bit i of pattern is filter i.

    An id labelled twice takes the larger label; null labels count as 0.
    """
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    pattern = sum((F.col(f).cast("int") * 2**i for i, f in enumerate(FILTERS.lower())), F.lit(0))
    slim = failed.select("doc_id", "part", pattern.alias("pattern")).join(known, "doc_id", "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return slim.groupBy("part", "pattern").agg(F.count(F.lit(1)).alias("n"), zero("good"), zero("toxic"))


def _orders() -> Column:
    """All orders and steps as an array: the order, the step, bits of the filters before it and its own bit."""
    steps = [
        {"filter_order": "".join(order), "step": k + 1, "before": sum(2 ** FILTERS.index(g) for g in order[:k]), "own": 2 ** FILTERS.index(f)}
        for order in permutations(FILTERS)
        for k, f in enumerate(order)
    ]
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,before:int,own:int>>")


def order_audit(patterns: DataFrame) -> DataFrame:
    """One row per part, order and step with the effects of the step's filter; see ``audit_filters``."""
    # at most 32 patterns per part
    own = patterns.groupBy("part").agg(F.collect_list(F.struct("pattern", "n", "good", "toxic")).alias("p"))
    rows = own.select("part", "p", F.explode(_orders()).alias("o")).select("part", "p", "o.*")

    def total(value: str, where) -> Column:
        return F.aggregate(F.filter("p", where), F.lit(0).cast("long"), lambda acc, x: acc + x[value])

    hits = lambda x: x["pattern"].bitwiseAND(F.col("own")) != 0
    passed = lambda x: x["pattern"].bitwiseAND(F.col("before")) == 0
    # among all orders a failing filter comes first of its pattern's filters in 120 / number of them
    share = F.aggregate(F.filter("p", hits), F.lit(0).cast("long"), lambda acc, x: acc + (x["n"] * F.lit(120) / F.bit_count(x["pattern"])).cast("long"))
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda x: passed(x) & ~hits(x)).alias("kept"),
        total("n", lambda x: passed(x) & hits(x)).alias("removed"),
        total("n", lambda x: ~passed(x) & hits(x)).alias("redundant"),
        total("n", lambda x: x["pattern"] == F.col("own")).alias("unique_fails"),
        total("good", lambda x: passed(x) & hits(x)).alias("good_lost"),
        total("toxic", lambda x: passed(x) & hits(x)).alias("toxic_lost"),
        share.alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    kept: left after the step; removed: removed here; redundant: fails the step's filter, removed earlier;
    unique_fails: fails this filter only; good_lost, toxic_lost: removed here with that label; shapley: removals by
    this filter summed over all orders.  An empty table has no parts and gives no rows.
    """
    return order_audit(pattern_counts(failed_filters(docs, doc_id, text, part), labels))
