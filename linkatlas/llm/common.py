"""Shared plumbing: the scratch folder, batch bounds and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes an Arrow batch may hold: one task keeps a few batches, whatever the rows' lengths.
BATCH_BYTES = 8 << 20
#: The bytes that part words.
SPACES = b"\t\n\x0b\x0c\r "


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local master without it gets a new one (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="linkatlas-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table that ``kept`` wrote, once nothing lazy reads it."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Held:
    """Tables that one operator writes on its way; ``drop`` deletes them once its result stands in a table of its own."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(kept(df, name))
        return self.tables[-1]

    def drop(self) -> None:
        for t in self.tables:
            drop(t)
        self.tables = []


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes and rows; a single longer row still passes whole."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def raw_texts(column: pa.Array) -> list[bytes]:
    """Python bytes of an Arrow binary column, empty for null."""
    return [x if x is not None else b"" for x in column.to_pylist()]


def ascii_words(text: bytes) -> list[bytes]:
    """Lower-case A-Z and split at the bytes 09-0D and 20, which is what ``bytes`` methods do."""
    return text.lower().split()


def text_key(text: str = "text") -> Column:
    """A text's key: 128 bits of its SHA-256; null counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(text).cast("binary"), F.lit(b"")), 256)), 1, 16)


def word_batches(text: bytes, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """``ascii_words`` of about ``most`` bytes at a time, so that a long text is never all words at once."""
    at = 0
    while at < len(text):
        end = at + most
        while end < len(text) and text[end] not in SPACES:
            end += 1
        yield ascii_words(text[at:end])
        at = end


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """From batches sorted by integer ``keys`` without nulls, tables that each hold whole groups."""
    held: list[pa.RecordBatch] = []
    before = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        if held and before != tuple(c[0] for c in cols):
            yield pa.Table.from_batches(held)
            held = []
        moved = np.zeros(b.num_rows - 1, bool)
        for c in cols:
            moved |= c[1:] != c[:-1]
        last = int(np.flatnonzero(moved)[-1]) + 1 if moved.any() else 0
        if last:
            yield pa.Table.from_batches([*held, b.slice(0, last)])
            held = []
        held.append(b.slice(last))
        before = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the groups of a table sorted by ``keys`` begin, and its length."""
    moved = np.zeros(max(0, table.num_rows - 1), bool)
    for k in keys:
        c = table.column(k).to_numpy()
        moved |= c[1:] != c[:-1]
    return np.concatenate(([0], np.flatnonzero(moved) + 1, [table.num_rows]))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (u, v: long) as (node, root): every node that has an edge, once.

    Contraction: each round maps a node to the neighbour (or itself) with the least hashed rank, then
    relabels the edges and drops loops and repeats, so that a constant share of the nodes goes in each
    round whatever the shape. Minima are pre-aggregated; the relabelling joins split a hot hub. The root
    is one member of the component, not the smallest. Rows with a null end or u = v are ignored.
    """
    edge = kept(edges.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    maps: list[DataFrame] = []
    for turn in range(200):
        if edge.isEmpty():
            drop(edge)
            break
        rank = lambda c, t=turn: F.struct(F.xxhash64(F.lit(t), c).alias("h"), F.col(c).alias("id"))
        both = edge.select(F.explode(F.array(
            F.struct(F.col("u").alias("node"), rank("v").alias("r")), F.struct(F.col("v").alias("node"), rank("u").alias("r")),
        )).alias("e")).select("e.node", "e.r")
        step = both.groupBy("node").agg(F.min("r").alias("r"))
        own = F.struct(F.xxhash64(F.lit(turn), "node").alias("h"), F.col("node").alias("id"))
        step = kept(step.select("node", F.least("r", own)["id"].alias("parent")), "parents")
        maps.append(step)
        a = step.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        b = step.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        moved = edge.join(a, "u").select("v", "pu").join(b, "v").where("pu <> pv")
        after = kept(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
        drop(edge)
        edge = after
    else:
        raise RuntimeError("the contraction did not end")
    if not maps:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    out = maps[0].select("node", F.col("parent").alias("root"))
    for step in maps[1:]:
        out = out.join(step.select(F.col("node").alias("root"), "parent"), "root", "left").select("node", F.coalesce("parent", "root").alias("root"))
    return out
