"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation learned on a bounded sample turns centred unit vectors into balanced 64-bit codes.  The code is cut
into four 16-bit chunks; a vector is entered under every key within one bit of each chunk, so two vectors meet
if any chunk differs in at most two bits.  Of all meetings of a pair one is canonical (the first such table, and
there the least middle key), so each pair is judged once without a list of pairs.  A first pass over the codes
alone marks which entries have a partner within the Hamming radius; only those get their vectors and are
reranked by exact cosine.  Tasks return sums and star edges, never pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cellscape.llm.groups import roots, unite, whole_groups
from cellscape.operators.components import connected_components
from cellscape.session import cut_lineage

BITS, TABLES = 64, 4
CHUNK = BITS // TABLES
#: Largest Hamming distance of a candidate; at cosine 0.93 the expected distance is 7.7 with deviation 2.6.
RADIUS = 22
ALIKE = 0.93
#: Bound of the sample that the rotation is learned on, in rows and in values.
SAMPLE_ROWS, SAMPLE_VALUES = 20_000, 4_000_000
ROUNDS = 40
#: A key with more entries is dealt into blocks of about this size, and every pair of blocks is a task group.
BLOCK = 2048


def learn_rotations(x: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimensions x 64) of unit vectors: PCA, then rotations that bring values close to their signs."""
    dims = x.shape[1]
    mean = x.mean(0) if len(x) else np.zeros(dims)
    rng = np.random.default_rng(seed)
    centred = x - mean
    width = min(dims, BITS)
    _, vectors = np.linalg.eigh(centred.T @ centred + 1e-9 * np.eye(dims))
    axes = vectors[:, ::-1][:, :width]
    parts = []
    while sum(p.shape[1] for p in parts) < BITS:
        rotation, _ = np.linalg.qr(rng.standard_normal((width, width)))
        projected = centred @ axes
        for _ in range(ROUNDS if len(x) else 0):
            u, _, v = np.linalg.svd(np.where(projected @ rotation >= 0, 1.0, -1.0).T @ projected)
            rotation = (u @ v).T
        parts.append(axes @ rotation)
    return mean, np.hstack(parts)[:, :BITS]


def encode_vectors(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    bits = (x - mean) @ projection >= 0
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision; scaled by the largest component first against overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as a dense matrix, shorter rows padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    out = np.zeros((len(sizes), dims), np.float64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = values
    return out


def chunk_of(code: np.ndarray, table: np.ndarray) -> np.ndarray:
    return (code >> (table.astype(np.uint64) * np.uint64(CHUNK))) & np.uint64(2**CHUNK - 1)


def canonical(a: np.ndarray, b: np.ndarray, table: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the pair of codes is judged at this table and key, and lies within the radius."""
    differ = a ^ b
    ok = np.bitwise_count(differ) <= RADIUS
    for t in range(TABLES - 1):
        ok &= (table <= t) | (np.bitwise_count(chunk_of(differ, np.full(1, t))) > 2)
    ca, d = chunk_of(a, table), chunk_of(differ, table)
    lowest = d & (~d + np.uint64(1))
    count = np.bitwise_count(d)
    middle = np.where(count == 0, ca, np.where(count == 1, np.minimum(ca, ca ^ d), np.minimum(ca ^ lowest, ca ^ d ^ lowest)))
    return ok & (middle == key)


def group_pairs(starts: np.ndarray, rows: int, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows inside groups, i < j, in bounded pieces."""
    sizes = np.diff(np.append(starts, rows))
    for size in np.unique(sizes):
        if size < 2:
            continue
        own = starts[sizes == size]
        if size <= 64:
            i, j = np.triu_indices(size, 1)
            step = max(1, most // len(i))
            for at in range(0, len(own), step):
                base = own[at : at + step, None]
                yield (base + i).ravel(), (base + j).ravel()
        else:
            for base in own:
                rows_at_once = max(1, most // int(size))
                for a in range(0, size, rows_at_once):
                    i = np.arange(a, min(size, a + rows_at_once))
                    ii, jj = np.repeat(i, size), np.tile(np.arange(size), len(i))
                    up = jj > ii
                    yield base + ii[up], base + jj[up]


GROUP = ["label", "dims", "table", "key", "bi", "bj"]


def _judged(part: pa.Table, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    col = lambda n: part.column(n).to_numpy()
    code, table, key = col("code").view(np.uint64), col("table"), col("key").view(np.uint64)
    block, bi, bj = col("block"), col("bi"), col("bj")
    for i, j in group_pairs(starts, part.num_rows):
        crossing = np.minimum(block[i], block[j]) == bi[i]
        crossing &= np.maximum(block[i], block[j]) == bj[i]
        i, j = i[crossing], j[crossing]
        ok = canonical(code[i], code[j], table[i], key[i])
        yield i[ok], j[ok]


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries with at least one candidate judged here."""
    for part, starts in whole_groups(batches, GROUP):
        hit = np.zeros(part.num_rows, bool)
        for i, j in _judged(part, starts):
            hit[i] = hit[j] = True
        yield from part.filter(pa.array(hit)).combine_chunks().to_batches()


def _rerank(dims: int, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts in whole_groups(batches, GROUP):
            x = unit(matrix(part.column("vector"), dims))
            node, copies = part.column("node").to_numpy(), part.column("copies").to_numpy()
            links = np.zeros(part.num_rows, np.int64)
            root = np.arange(part.num_rows)
            for i, j in _judged(part, starts):
                for at in range(0, len(i), 65_536):
                    a, b = i[at : at + 65_536], j[at : at + 65_536]
                    near = (x[a] * x[b]).sum(1) >= threshold
                    a, b = a[near], b[near]
                    np.add.at(links, a, copies[b])
                    np.add.at(links, b, copies[a])
                    unite(root, a, b)
            root = roots(root)
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(node[root[some]])], ["node", "links", "root"])

    return run


def usable(vector: Column, label: Column) -> Column:
    """Label and vector present, components all finite, at least one not zero."""
    v = vector.cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return label.isNotNull() & vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def entries(coded: DataFrame) -> DataFrame:
    """Each code under the 17 keys within one bit of each chunk, hot keys dealt into pairs of blocks."""
    deltas = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(CHUNK)])
    tables = F.array(*[F.lit(t) for t in range(TABLES)])
    rows = coded.select("label", "dims", "node", "copies", "code", F.explode(tables).alias("table"))
    chunk = F.call_function("shiftrightunsigned", F.col("code"), F.col("table") * CHUNK).bitwiseAND(F.lit(2**CHUNK - 1))
    rows = rows.select("*", chunk.cast("long").alias("__c")).select("*", F.explode(deltas).alias("__d"))
    rows = rows.withColumn("key", F.col("__c").bitwiseXOR(F.col("__d"))).drop("__c", "__d")
    hot = rows.groupBy("label", "dims", "table", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    rows = rows.join(hot, ["label", "dims", "table", "key"], "left")
    blocks = F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    rows = rows.withColumn("__o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.select("label", "dims", "table", "key", F.least("block", "__o").alias("bi"), F.greatest("block", "__o").alias("bj"), "block", "node", "copies", "code")


def link_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = ALIKE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal, their dimensions too, and their cosine is ``threshold`` or more.
    Null, zero or non-finite vectors, null labels and null ids link with nothing and are their own component (a null
    id has a null component and is not kept).  Equal vectors are one node, so copies link without being compared.
    Other columns are dropped; an empty table gives no rows.
    """
    base = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    good = base.where(usable(F.col("vector"), F.col("label")) & F.col("vec_id").isNotNull())
    nodes = cut_lineage(good.groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")).withColumn("dims", F.size("vector")))
    dims = nodes.agg(F.max("dims")).first()[0] or 1
    bound = min(SAMPLE_ROWS, SAMPLE_VALUES // dims)
    sample = nodes.select("vector", "node").orderBy(F.xxhash64("node"), "node").limit(bound).toArrow()
    mean, projection = learn_rotations(unit(matrix(sample.column("vector"), dims)) if sample.num_rows else np.zeros((0, dims)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = encode_vectors(unit(matrix(batch.column("vector"), dims)), mean, projection)
            kept = ["label", "dims", "node", "copies"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(code.view(np.int64))], [*kept, "code"])

    kind = dict(nodes.dtypes)["label"]
    numbered = nodes.withColumn("label", F.xxhash64("label")) if kind not in ("int", "bigint") else nodes.withColumn("label", F.col("label").cast("long"))
    coded = cut_lineage(numbered.mapInArrow(encode, "label long, dims int, node long, copies long, code long"))
    held = entries(coded)
    marked = held.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(_mark, held.schema)
    marked = cut_lineage(marked)
    with_vectors = marked.join(numbered.select("label", "node", "vector"), ["label", "node"]).select(*GROUP, "block", "node", "copies", "code", "vector")
    found = with_vectors.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(_rerank(dims, threshold), "node long, links long, root long")
    found = cut_lineage(found)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    component = connected_components(found.where("node <> root").select(F.col("node").alias("src"), F.col("root").alias("dst")))
    summed = nodes.select("label", "vector", "node", "copies").join(links, "node", "left").join(component, "node", "left")
    summed = summed.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    placed = good.join(summed, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = base.where(~(usable(F.col("vector"), F.col("label")) & F.col("vec_id").isNotNull()))
    every = placed.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return every.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
