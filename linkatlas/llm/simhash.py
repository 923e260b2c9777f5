"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint is 8 (position, byte) tokens. Two fingerprints that differ in at most 2 bits share at least
6 of them, the guaranteed minimum. Lists of single tokens hold 1/256 of the corpus each, so the index
posts conjunctions of four tokens: the 14 sets of four positions whose numbers have an exclusive-or of zero. Any
three positions lie in one of these sets, and of the sets within six shared positions each position is in
two. So each list that a pair meets in adds its positions to the pair's tally, and for a pair that shares
six or more the tally is complete; a pair that shares five at most has a tally of four. Pairs with a tally
of six are kept and verified by their differing bits. Equal fingerprints are one entry throughout.

A list of more than ``LIST_CAP`` values is split by each further position, its lists again, and adds what
these have in common. Lists of six positions that are still too long are split by a seventh, or by half of
each of the two bytes that are left; such lists have 256 values at most, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Held, bounded_batches, components, kept, raw_texts, word_batches

LIST_CAP, MAX_BITS, LEAST = 32, 2, 6


def fingerprint(text: bytes, shingle: int) -> int:
    """64 bits: each is set if over half of the shingles' XXH64 (seed 42) have it; zero for a text without words."""
    counts, n, tail = np.zeros(64, np.int64), 0, []
    for words in word_batches(text):
        words = tail + words
        k = len(words) - shingle + 1
        if k > 0:
            counts += _bits(words, shingle)
            n += k
            tail = words[k:]
        else:
            tail = words
    if not n and tail:
        counts, n = _bits(tail, len(tail)), 1
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _bits(words: list[bytes], shingle: int) -> np.ndarray:
    """How many of the shingles' hashes have each bit."""
    flat = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    first, last = (ends - size)[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    h = np.array([xxhash.xxh64_intdigest(flat[a:b], 42) for a, b in zip(first, last, strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        bits = np.unpackbits(h[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return counts


def fingerprints(docs: DataFrame, shingle: int = 3, *carried: str) -> DataFrame:
    """(doc_id, fp: long, the fingerprint's bits, carried columns) for every row; null and wordless texts have 0."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in raw_texts(b.column(1))], np.uint64)
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64)), *b.columns[2:]], names=["doc_id", "fp", *carried])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("raw"), *carried)
    kinds = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in carried)
    return rows.mapInArrow(run, f"doc_id long, fp long{kinds}")


def _signed(m: int) -> int:
    return m - (1 << 64) if m >= 1 << 63 else m


#: Masks of single positions, of half positions, and of the sets of four that are posted.
BYTES = [_signed(255 << 8 * p) for p in range(8)]
HALVES = [_signed(15 << 4 * p) for p in range(16)]
PLANES = [_signed(sum(255 << 8 * p for p in s)) for s in combinations(range(8), 4) if s[0] ^ s[1] ^ s[2] ^ s[3] == 0]


def whole_bytes(mask: Column) -> Column:
    """How many positions a mask has whole."""
    return sum((F.when(mask.bitwiseAND(F.lit(m)) == m, 1).otherwise(0) for m in BYTES), F.lit(0))


def _post(rows: DataFrame, masks: Column) -> DataFrame:
    """(fp, mask, key): the entries of ``rows`` under each of ``masks``."""
    return rows.select("fp", F.explode(masks).alias("mask")).select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))


def _finer(last: bool) -> Column:
    """The masks that split a list: by one more position, and from six positions also by half of each byte left."""
    free = lambda m: F.col("mask").bitwiseAND(F.lit(m)) == 0
    masks = [F.when(free(m), F.col("mask").bitwiseOR(F.lit(m))) for m in BYTES]
    if last:
        masks += [F.when(free(_signed((a | b) & (1 << 64) - 1)), F.col("mask").bitwiseOR(F.lit(a | b))) for i, a in enumerate(HALVES) for j, b in enumerate(HALVES) if i // 2 < j // 2]
    return F.filter(F.array(*masks), lambda x: x.isNotNull())


def tallies(fps: DataFrame, cap: int = LIST_CAP, keep: Held | None = None) -> DataFrame:
    """(u, v, tally): pairs of distinct values in ``fp`` that meet in a list, and how many shared positions the lists have.

    The tally is complete for pairs within ``MAX_BITS`` differing bits.
    """
    keep = keep or Held()
    post, out = _post(fps, F.array(*map(F.lit, PLANES))), None
    for depth in range(4, 8):
        lists = keep(post.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"), "lists")
        post = keep(post.join(lists, ["mask", "key"]), "postings")
        few = post.where(F.col("n") <= cap) if depth < 7 else post
        met = few.join(few.select("mask", "key", F.col("fp").alias("other")), ["mask", "key"]).where("fp < other").select(F.col("fp").alias("u"), F.col("other").alias("v"), "mask")
        out = met if out is None else out.unionByName(met)
        long = post.where(F.col("n") > cap)
        if depth == 7 or long.isEmpty():
            break
        post = _post(long, _finer(depth == 6)).distinct()
    return out.groupBy("u", "v").agg(F.bit_or("mask").alias("mask")).select("u", "v", whole_bytes(F.col("mask")).alias("tally"))


def links(fps: DataFrame, cap: int = LIST_CAP, keep: Held | None = None) -> DataFrame:
    """(u, v): all pairs of distinct values in ``fp`` within ``MAX_BITS`` differing bits."""
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS
    return tallies(fps, cap, keep).where(F.col("tally") >= LEAST).where(near).select("u", "v")


def simhash_groups(docs: DataFrame, shingle: int = 3, *carried: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, fingerprint (16 hex digits), component, component_id and the ``carried`` columns.

    component is one of the group's fingerprints, component_id the smallest doc_id that links reach. Null and empty texts share fingerprint zero and
    link like any others; a null doc_id gets its group's component_id; repeated rows are repeated; a long
    text is read whole, its words a part at a time; an empty table gives no rows. Columns other than
    doc_id, text and the carried ones are ignored.
    """
    keep = Held()
    rows = kept(fingerprints(docs, shingle, *carried), "fingerprints")
    uniq = keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(uniq.select("fp"), keep=keep))
    known = keep(uniq.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    least = keep(known.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    final = kept(known.join(least, "root").select("fp", F.col("root").alias("component"), "component_id"), "groups")
    keep.drop()
    return rows.join(final, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component", "component_id", *carried)


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_groups(docs).select("doc_id", "fingerprint", "component_id")
