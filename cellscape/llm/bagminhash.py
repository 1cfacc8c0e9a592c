"""Near-duplicate texts by BagMinHash.

A text is a bag of five-word shingles with their multiplicities.  The weight axis of a shingle is cut into the
dyadic blocks [0,1), [1,2), [2,4), ...; every block carries a Poisson process of points (time, weight, component)
whose randomness depends on shingle and block alone.  A bag owns the points below its weight, and component i of
its signature is the earliest of its points with label i, so two bags agree in a component with probability equal
to their weighted Jaccard similarity.  Points are drawn in rounds up to a time horizon in proportion to 1/weight of
the bag, so the work is one draw per shingle plus a fixed number per text.

Bands of the signature give candidates: texts that share a band value, directly or through others, form a family.
A family is verified by the exact overlap of its bags, in blocks of bounded size: a task gets one pair of blocks,
counts shared shingles as a matrix product and returns a star of edges, so no pair of a bucket goes unseen, none is
written out, and a family of any size is spread over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from cellscape.llm.common import bound_batches
from cellscape.llm.groups import roots, unite, whole_groups
from cellscape.llm.urls import BROADCAST_BLOCKS, build_filter, possible_hits
from cellscape.operators.components import connected_components
from cellscape.session import cut_lineage

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 32, 6
SIZE = BANDS * ROWS
#: Horizon of the point processes in units of 1/weight: all components are hit with about 98 per cent.
HORIZON = math.log(SIZE) + 4
#: Texts of a family that are held together; larger families are dealt into blocks, and a task gets two of them.
BLOCK = 1_024
#: Shingles counted in one product.
COLUMNS = 4_096
CHUNK_CHARS = 1_000_000
CACHED_WORDS = 100_000
GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit changes about half of the output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_words = _WordHashes()


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts and the text each belongs to; a text of 1 to 4 words is one shingle, no words give none."""
    split = [t.lower().split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.fromiter((h for s in split for h in map(_words.__getitem__, s)), np.uint64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    short = sizes < SHINGLE
    width = np.where(short, np.maximum(sizes, 1), SHINGLE)[doc] if len(flat) else np.zeros(0, np.int64)
    first = place + width <= sizes[doc] if len(flat) else np.zeros(0, bool)
    start = np.flatnonzero(first)
    value = np.zeros(len(start), np.uint64)
    for j in range(SHINGLE):
        used = j < width[start]
        at = np.minimum(start + j, max(len(flat) - 1, 0))
        value = np.where(used, mix(value * GOLD + flat[at] + np.uint64(1)), value) if len(start) else value
    return value, doc[start]


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: hash, text, multiplicity."""
    value, doc = shingles(texts)
    if not len(value):
        return value, doc, np.zeros(0, np.int64)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return value[at], doc[at], np.diff(np.append(at, len(value)))


def signatures(value: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Earliest point per text and component; infinite throughout for texts without shingles."""
    sig = np.full(n * SIZE, np.inf)
    total = np.bincount(doc, weights=weight, minlength=n)
    horizon = np.where(total > 0, HORIZON / np.maximum(total, 1), 0.0)
    todo = np.ones(n, bool)
    while True:
        own = todo[doc]
        _draw(sig, value[own], doc[own], weight[own], horizon)
        lacking = np.isinf(sig.reshape(n, SIZE)).any(1) & (total > 0)
        if not lacking.any():
            return sig.reshape(n, SIZE)
        todo, horizon = lacking, np.where(lacking, horizon * 2, horizon)


def _draw(sig: np.ndarray, value: np.ndarray, doc: np.ndarray, weight: np.ndarray, horizon: np.ndarray) -> None:
    block, top = 0, int(weight.max()) if len(weight) else 0
    while block == 0 or (1 << (block - 1)) < top:
        low = 0 if block == 0 else 1 << (block - 1)
        rate = 1 if block == 0 else low
        held = weight > low
        seed = mix(value[held] + np.array([block + 1], np.uint64) * GOLD)
        owner, reach = doc[held], weight[held]
        limit = horizon[owner] * (SIZE * rate)
        t = np.zeros(len(seed))
        step = np.zeros(1, np.uint64)
        partial = block > 1
        while len(seed):
            step += np.uint64(1)
            r = mix(seed + step * GOLD)
            t = t - np.log1p(-((r >> np.uint64(11)).astype(np.float64) * 2.0**-53))
            alive = t < limit
            if not alive.all():
                seed, owner, t, limit, r = seed[alive], owner[alive], t[alive], limit[alive], r[alive]
                if partial:
                    reach = reach[alive]
                if not len(seed):
                    break
            q = mix(r ^ GOLD)
            label = ((q >> np.uint64(32)) * np.uint64(SIZE) >> np.uint64(32)).astype(np.int64)
            place, time = owner * SIZE + label, t / (SIZE * rate)
            if partial:  # a point at weight y belongs to the bag if y lies below its multiplicity
                below = low * (1 + (q & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32) < reach
                place, time = place[below], time[below]
            np.minimum.at(sig, place, time)
        block += 1


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band from the signature rounded to single precision."""
    bits = sig.astype(np.float32).view(np.uint32).astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLD, (len(sig), BANDS)).copy()
    for r in range(ROWS):
        key = mix(key + bits[:, :, r] * GOLD + np.uint64(r + 1))
    return key.view(np.int64)


def overlap(a: str, b: str) -> float:
    """Weighted Jaccard similarity of the bags of two texts; 0 if either has no words."""
    return _overlap(_bag(a), _bag(b))


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    value, _, count = bags([text])
    return value, count


def _overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    return shared / (int(a[1].sum()) + int(b[1].sum()) - shared)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        done = 0
        while done < len(texts):
            stop, size = done, 0
            while stop < len(texts) and size < CHUNK_CHARS:
                size += len(texts[stop])
                stop += 1
            part = texts[done:stop]
            value, doc, weight = bags(part)
            some = np.bincount(doc, minlength=len(part)) > 0
            keys = band_keys(signatures(value, doc, weight, len(part)))
            ends = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[some].ravel(), pa.int64()))
            own = batch.slice(done, stop - done)
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("node"), lists], ["doc_id", "node", "bands"])
            done = stop


def expanded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bags as sets: the k-th occurrence of a shingle is an element of its own, so shared elements are shared multiplicity."""
    value, doc, count = bags(texts)
    place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    value, doc = np.repeat(value, count), np.repeat(doc, count)
    return np.where(place > 0, mix(value + place.astype(np.uint64) * GOLD), value), doc


def shared_counts(value: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Elements that each pair of texts shares, as products of slices of the incidence matrix."""
    _, column, seen = np.unique(value, return_inverse=True, return_counts=True)
    common = seen > 1
    number = np.cumsum(common) - 1
    own = common[column]
    column, doc = number[column[own]], doc[own]
    out = np.zeros((n, n), np.float32)  # whole numbers, exact in single precision below 2**24
    order = np.argsort(column, kind="stable")
    column, doc = column[order], doc[order]
    for low in range(0, int(common.sum()), COLUMNS):
        a, b = np.searchsorted(column, (low, low + COLUMNS))
        held = np.zeros((n, min(COLUMNS, int(common.sum()) - low)), np.float32)
        held[doc[a:b], column[a:b] - low] = 1.0
        out += held @ held.T
    return out


GROUP = ["family", "bi", "bj"]


def _links(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts in whole_groups(batches, GROUP):
            src, dst = [], []
            for at, stop in zip(starts, [*starts[1:], part.num_rows], strict=True):
                group = part.slice(at, stop - at)
                n, block = group.num_rows, group.column("block").to_numpy()
                value, doc = expanded(group.column("text").to_pylist())
                size = np.bincount(doc, minlength=n).astype(np.float64)
                i, j = np.nonzero(_alike(shared_counts(value, doc, n), size, threshold))
                asked = (i < j) & ((block[i] != block[j]) | (group.column("bi")[0].as_py() == group.column("bj")[0].as_py()))
                root = np.arange(n)
                unite(root, i[asked], j[asked])
                root = roots(root)
                node = group.column("node").combine_chunks()
                away = np.flatnonzero(root != np.arange(n))
                src.append(node.take(pa.array(away)))
                dst.append(node.take(pa.array(root[away])))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(src), pa.concat_arrays(dst)], ["src", "dst"])

    return run


def _alike(shared: np.ndarray, size: np.ndarray, threshold: float) -> np.ndarray:
    """Rows and columns whose overlap reaches the threshold, a slice of rows at a time."""
    out = np.zeros(shared.shape, bool)
    for at in range(0, len(shared), 256):
        both = shared[at : at + 256].astype(np.float64)
        either = size[at : at + 256, None] + size[None, :] - both
        out[at : at + 256] = (both > 0) & (both >= threshold * either - 1e-9)
    return out


def _perhaps(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key a Bloom filter of bounded size may hold, so that the exact join that follows shuffles little else."""
    blocks, n = build_filter(wanted.select(key), key, BROADCAST_BLOCKS)
    return possible_hits(rows, key, cut_lineage(blocks), n)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = SIMILAR) -> DataFrame:
    """One row per non-null text row: doc_id, node (digest of the text), class_id.

    ``class_id`` is the least doc_id among texts connected by similarity ``threshold`` or more.  Equal texts
    share a class, also empty ones; other texts without words are alone.  Rows with null text are alone with their
    own id.  Null ids follow their text.  Repeated rows are all returned.  Other columns are dropped.
    """
    bound_batches(docs.sparkSession)
    slim = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("node"), F.col(text).alias("text"))
    signed = cut_lineage(slim.mapInArrow(_sign, "doc_id long, node binary, bands array<long>"))

    # families by short node numbers: should two texts share a number, a family is larger than it need be
    short = F.xxhash64("node").alias("short")
    rows = signed.select(short, F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("short").alias("least"), F.max("short").alias("most")).where("least <> most")
    shared = cut_lineage(shared.select("key", "least"))
    stars = _perhaps(rows, "key", shared).join(shared, "key").select("short", "least").distinct()
    families = connected_components(stars.select(F.col("short").alias("src"), F.col("least").alias("dst")))
    families = cut_lineage(families.select(F.col("node").alias("short"), F.col("component").alias("family")))

    texts = _perhaps(slim.select("node", "text", short), "short", families).join(families, "short").groupBy("node").agg(F.first("family").alias("family"), F.first("text").alias("text"))
    texts = cut_lineage(texts)
    sizes = texts.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    dealt = texts.join(sizes.where("n > 1"), "family")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("family", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "node", "text")
    edges = dealt.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(_links(threshold), "src binary, dst binary")
    component = connected_components(edges)

    owned = signed.groupBy("node").agg(F.min("doc_id").alias("first"))
    labelled = owned.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = labelled.groupBy("component").agg(F.min("first").alias("class_id"))
    classes = cut_lineage(labelled.join(least, "component").select("node", "class_id"))
    known = signed.select("doc_id", "node").join(classes, "node").select("doc_id", "node", "class_id")
    alone = docs.where(F.col(text).isNull()).select(F.col(doc_id).cast("long").alias("doc_id"))
    return known.unionByName(alone.select("doc_id", F.lit(None).cast("binary").alias("node"), F.col("doc_id").alias("class_id")))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` without near duplicates: of each class the row of least id stays; rows with null text all stay."""
    found = near_duplicates(docs, doc_id, text)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "node"))
    # a class without any id is told apart by its node
    group = F.when(F.col("class_id").isNotNull(), F.col("class_id").cast("string")).otherwise(F.hex("node"))
    winners = found.where(F.col("node").isNotNull()).groupBy(group.alias("g")).agg(best.alias("w")).select(F.col("w.doc_id").alias("__id"), F.col("w.node").alias("__node"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # rows of all columns inside one struct cannot clash with the keys
    row = F.struct(*columns).alias("row")
    keyed = docs.where(F.col(text).isNotNull()).select(row, F.col(doc_id).cast("long").alias("key"), F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("md5"))
    kept = keyed.join(cut_lineage(winners), F.col("key").eqNullSafe(F.col("__id")) & (F.col("md5") == F.col("__node")), "left_semi")
    kept = kept.dropDuplicates(["key", "md5"]).select("row.*")
    return kept.unionByName(docs.where(F.col(text).isNull()).select(*columns))
