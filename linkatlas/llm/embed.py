"""Near-duplicate vectors by Euclidean p-stable hashing with exact cosine checks.

Unit vectors with cosine c lie sqrt(2 - 2c) apart. Each table hashes a vector to the quantised offsets of
``WIDTH``-wide cells along some Gaussian directions; vectors that share a table's cell are compared in
double precision. The directions to a table grow with the logarithm of the number of vectors, so that an
unrelated one (cosine near 0) is met ``STRAYS`` times a table, and the tables are as many as a pair at
the threshold needs to meet ``MEETINGS`` times on average: it is missed with a chance of exp(-MEETINGS), 0.07,
and closer pairs with less. The index draws its directions at random from a fixed seed and holds every row;
nothing is fitted on a sample.

Equal vectors are one entry with a count. A cell is worked off in blocks of ``BLOCK`` vectors against
each other, spread over tasks; a block yields a count for each vector and a spanning forest of its
links, never the pairs. A pair counts in the first table where it meets, which the keys of the earlier
tables tell; they travel with the vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Held, bounded_batches, bounds, components, grouped, kept

WIDTH, SEED, STRAYS, MEETINGS, BLOCK, SMALL = 2.0, 7, 0.1, 2.7, 512, 24


def same_cell(distance: float, width: float = WIDTH) -> float:
    """The chance that two points so far apart fall in one cell along a Gaussian direction."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def layout(n: int, least_cos: float = 0.95) -> tuple[int, int]:
    """Directions to a table, and tables, for n vectors."""
    directions = max(1, math.ceil(math.log(max(n, 2) / STRAYS) / -math.log(same_cell(math.sqrt(2)))))
    return directions, math.ceil(MEETINGS / same_cell(math.sqrt(max(2 - 2 * least_cos, 1e-12))) ** directions)


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cells(unit: np.ndarray, directions: int, tables: int, some: int = 1 << 23) -> np.ndarray:
    """The key of each vector's cell in each of ``tables``."""
    rng = np.random.default_rng([SEED, unit.shape[1], directions, tables])
    a = rng.standard_normal((unit.shape[1], tables * directions), np.float32) / np.float32(WIDTH)
    shift = rng.random(tables * directions, np.float32)
    out = np.empty((len(unit), tables), np.int64)
    step = max(1, some // (tables * directions))
    for at in range(0, len(unit), step):
        q = np.floor(unit[at : at + step].astype(np.float32) @ a + shift).astype(np.int64).view(np.uint64).reshape(-1, tables, directions)
        key = np.full(q.shape[:2], unit.shape[1], np.uint64)
        for k in range(directions):
            key = (key ^ q[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[at : at + step] = key.view(np.int64)
    return out


def _met(unit: np.ndarray, first: np.ndarray, size: np.ndarray, cross: np.ndarray, side: np.ndarray, least_cos: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The linked pairs of rows of each group, a share at a time; of a ``cross`` group, only those of unlike ``side``.

    Pairs of small groups are compared many groups at once, those of larger ones by a product of matrices, where
    cosines too near the threshold for the order of summation are taken again as for small groups.
    """
    cosine = lambda a, b: np.einsum("ij,ij->i", unit[a], unit[b])
    step = max(1, (1 << 22) // unit.shape[1])
    for s in np.unique(size[(size > 1) & (size <= SMALL)]).tolist():
        own = size == s
        i, j = np.triu_indices(s, 1)
        starts, parted = first[own], cross[own]
        many = max(1, step // len(i))
        for at in range(0, len(starts), many):
            begin = starts[at : at + many, None]
            a, b = (begin + i).ravel(), (begin + j).ravel()
            hit = cosine(a, b) >= least_cos
            hit &= ~np.repeat(parted[at : at + many], len(i)) | (side[a] != side[b])
            yield a[hit], b[hit]
    for at, s, parted in zip(*(x[size > SMALL].tolist() for x in (first, size, cross)), strict=True):
        x = unit[at : at + s]
        dot = x @ x.T
        a, b = np.nonzero(np.triu(dot >= least_cos - 1e-9, 1))
        near = np.abs(dot[a, b] - least_cos) <= 1e-9
        a, b = a + at, b + at
        hit = ~near
        hit[near] = cosine(a[near], b[near]) >= least_cos
        if parted:
            hit &= side[a] != side[b]
        yield a[hit], b[hit]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links a - b that are not their own root, and their roots."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    root, a, b = np.arange(len(nodes)), place[: len(a)], place[len(a) :]
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            moved = np.flatnonzero(root != np.arange(len(nodes)))
            return nodes[moved], nodes[root[moved]]
        root = new


def _rows(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and where each list begins and the last ends."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()


def vector_links(vectors: DataFrame, least_cos: float = 0.95) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Null, empty and all-zero vectors and those with null or non-finite components link with nothing, nor
    do vectors of different lengths. Repeated rows link with each other. A null vec_id never names a
    component. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    keep = Held()
    v = F.col("embedding")
    sound = F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    # Equal vectors by 128 bits of hash.
    kind = "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    rows = vectors.select(F.col("vec_id").cast("long"), v.cast(f"array<{kind}>").alias("embedding"))
    rows = rows.withColumn("a", F.when(sound, F.xxhash64(v))).withColumn("b", F.when(sound, F.xxhash64(F.lit("b"), v)))
    ids = rows.select("vec_id", "a", "b")
    classes = rows.where("a is not null").groupBy("a", "b").agg(F.first("embedding").alias("v"), F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = keep(classes.withColumn("cid", F.monotonically_increasing_id()), "vectors")
    shape = layout(classes.count(), least_cos)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, at = _rows(b.column(2))
            size = np.diff(at)
            for d in np.unique(size):
                own = np.flatnonzero(size == d)
                out = cells(units(values[at[own][:, None] + np.arange(d)].astype(np.float64)), *shape)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * shape[1], pa.int32()), pa.array(out.ravel()))
                yield pa.record_batch([*(b.column(c).take(pa.array(own)) for c in range(3)), pa.array(np.full(len(own), d, np.int64)), lists], names=["cid", "copies", "v", "d", "keys"])

    hashed = keep(classes.select("cid", "copies", "v").mapInArrow(keys, f"cid long, copies long, v array<{kind}>, d long, keys array<long>"), "keys")
    post = hashed.select("cid", "d", F.posexplode("keys").alias("t", "key"))
    cell = ["t", "key", "d"]
    lists = keep(post.groupBy(*cell).agg(F.count("*").alias("n")).where("n > 1"), "lists")
    own = F.pmod(F.xxhash64("cid"), F.col("blocks"))
    met = (
        post.join(lists, cell).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("long")).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(*cell, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cid")
    )
    full = met.join(hashed.select("cid", "v", "copies", "keys"), "cid").withColumn("keys", F.slice("keys", 1, F.col("t")))
    order = [*cell, "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, order):
            cut = bounds(table, order)
            cid, copies, t, d, i, j, own = (table.column(c).to_numpy() for c in ("cid", "copies", "t", "d", "i", "j", "own"))
            values, at = _rows(table.column("v"))
            earlier, key_at = _rows(table.column("keys"))
            # Runs of groups of one table and one length.
            runs = np.flatnonzero((t[cut[:-1]][1:] != t[cut[:-1]][:-1]) | (d[cut[:-1]][1:] != d[cut[:-1]][:-1])) + 1
            for g, h in zip([0, *runs.tolist()], [*runs.tolist(), len(cut) - 1], strict=True):
                lo, hi = cut[g], cut[h]
                unit = units(values[at[lo] : at[hi]].reshape(hi - lo, -1).astype(np.float64))
                key = earlier[key_at[lo] : key_at[hi]].reshape(hi - lo, -1)
                n, links = np.zeros(hi - lo, np.int64), []
                first = cut[g:h] - lo
                for a, b in _met(unit, first, np.diff(cut[g : h + 1]), i[cut[g:h]] != j[cut[g:h]], own[lo:hi] == i[lo:hi], least_cos):
                    fresh = np.concatenate([~(key[a[s : s + (1 << 14)]] == key[b[s : s + (1 << 14)]]).any(1) for s in range(0, len(a), 1 << 14)] or [np.zeros(0, bool)])
                    np.add.at(n, a[fresh], copies[lo + b[fresh]])
                    np.add.at(n, b[fresh], copies[lo + a[fresh]])
                    # A link that an earlier table has is in that table's forest.
                    links.append(_forest(a[fresh], b[fresh]))
                hit = np.flatnonzero(n > 0)
                node = np.concatenate([hit, *(x for x, _ in links)])
                root = np.concatenate([hit, *(x for _, x in links)])
                counts = np.concatenate([n[hit], np.zeros(len(node) - len(hit), np.int64)])
                if len(node):
                    yield pa.record_batch([pa.array(cid[lo + node]), pa.array(counts), pa.array(cid[lo + root])], names=["cid", "n", "root"])

    found = full.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    found = keep(found.mapInArrow(compare, "cid long, n long, root long"), "found")
    roots = components(found.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    known = classes.select("cid", "a", "b", "least", "copies").join(found.groupBy("cid").agg(F.sum("n").alias("n")), "cid", "left")
    known = keep(known.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("a", "b", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root")), "known")
    least = keep(known.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    final = kept(known.join(least, "root").select("a", "b", "n_links", "component_id"), "final")
    keep.drop()
    linked = ids.where("a is not null").join(final, ["a", "b"]).select("vec_id", "n_links", "component_id")
    alone = ids.where("a is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_embeddings(spark, sf_dir: str) -> DataFrame:
    return vector_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
