"""Exact removal of byte strings that occur twice, by two-stage suffix sorting of candidate contexts.

A window is a string of ``length`` bytes. Each window names its anchor: the leftmost ``GRAM``-byte gram
in it whose hash is least. Equal windows name equal grams at equal places, so windows need comparing
only within an anchor's group, and consecutive windows with one anchor (a run) travel as one context of
run + length - 1 bytes. Contexts whose gram occurs once in the corpus stay where they are.

Equal contexts are collapsed to one with a count. The distinct contexts of a group meet in one task,
which sorts their suffixes in two stages: the suffixes smaller than their successors are sorted directly
(to the depth of a window), the others are induced by scanning the buckets of first bytes in order.
Common prefixes of neighbours then tell which windows occur twice. A group with more than ``GROUP_CAP``
distinct contexts is not brought together: its contexts are cut at fixed places from the gram into parts
of up to ``WIDTHS[0]`` windows, and a part meets only those that have the same bytes where all windows at
its place lie. Equal parts collapse again; the distinct ones are sorted as above, or cut more finely where
there are still too many. Parts of one window that meet are equal, so the cutting ends. All counts are
pre-aggregated, and only hashes travel until parts are known to meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Held, bounded_batches, bounds, grouped, kept, text_key

#: CHUNK: bytes of contexts that are sorted at once, more only for a larger group; PIECES: rows that are made at once from contexts.
LENGTH, GRAM, GROUP_CAP, CHUNK, PIECES = 400, 32, 256, 1 << 18, 2000
#: Windows to a part of a context in a large group, from the first cut to the last.
WIDTHS = (48, 6, 1)
#: Windows of a text that are looked at at once.
BLOCK = 1 << 20


def gram_hashes(b: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` (a power of two) bytes from each position that has them."""
    h = (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    width = 1
    while width < gram:
        x = h[:-width] * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x += h[width:]
        h = x * np.uint64(0xBF58476D1CE4E5B9 + 2 * width)
        width *= 2
    h ^= h >> np.uint64(31)
    return h


def runs(text: bytes, length: int = LENGTH, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: the gram's hash, the first window's start, how many windows, the gram's place in it.

    A long text is worked off in blocks of windows; a run ends where its block does.
    """
    found = [_runs(np.frombuffer(text, np.uint8)[at : at + block + length - 1], length, at) for at in range(0, len(text) - length + 1, block)]
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4))


def _runs(b: np.ndarray, length: int, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    h = gram_hashes(b)
    w = length - GRAM + 1
    # Rank by the hash's first 24 bits, then by place: the same for equal windows of any texts.
    place = np.uint64((1 << 40) - 1)
    v = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    pad = np.full(-len(v) % w, np.iinfo(np.uint64).max, np.uint64)
    rows = np.concatenate((v, pad)).reshape(-1, w)
    fore = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(b) - length + 1
    at = (np.minimum(back[:n], fore[w - 1 : w - 1 + n]) & place).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    return h[at[first]].view(np.int64), first + start, np.diff(np.concatenate((first, [n]))), at[first] - first


def suffix_order(flat: bytes, start: np.ndarray, size: np.ndarray, windows: np.ndarray, depth: int) -> np.ndarray:
    """The windows' starts in the order of their suffixes, told apart to ``depth`` bytes.

    Context k is flat[start[k]:start[k] + size[k]], followed by one byte that parts it from the next, and
    its windows start at its first ``windows[k]`` positions.
    """
    t = np.frombuffer(flat, np.uint8).astype(np.int16) + 1
    ends = start + size
    t[ends] = 0
    # Type: sign of the next different byte less this one; the parting byte counts as smallest.
    step = np.sign(np.diff(t.astype(np.int32), append=1))
    where = np.where(step != 0, np.arange(len(t)), len(t) - 1)
    where = np.minimum.accumulate(where[::-1])[::-1]
    small = step[where] > 0
    small[ends] = True
    # In scope: the windows, and from the last of each on up to the first suffix sorted directly.
    next_small = np.minimum.accumulate(np.where(small, np.arange(len(t)), len(t))[::-1])[::-1]
    stop = next_small[start + windows - 1]
    edge = np.zeros(len(t) + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, stop + 1, -1)
    scope = np.cumsum(edge[:-1]) > 0
    direct = np.flatnonzero(scope & small)
    end_of = np.repeat(ends, size + 1)[direct]
    keys = [flat[i:j] for i, j in zip(direct.tolist(), np.minimum(direct + depth, end_of).tolist(), strict=True)]
    order = direct[np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)] if len(keys) else direct
    head = t[order]
    order = order[np.argsort(head, kind="stable")]  # a parting byte sorts before a text's zero byte
    cut = np.searchsorted(t[order], np.arange(258))
    induced = scope & ~small
    queue: list[list[np.ndarray]] = [[] for _ in range(258)]
    out: list[np.ndarray] = []

    def push(done: np.ndarray, c: int) -> np.ndarray:
        """Queue the predecessors of ``done`` by first byte; return those of bucket ``c`` itself."""
        p = done[done > 0] - 1
        p = p[induced[p]]
        if not len(p):
            return p
        first = t[p]
        p = p[np.argsort(first, kind="stable")]
        first = t[p]
        lo = np.concatenate(([0], np.flatnonzero(first[1:] != first[:-1]) + 1, [len(p)]))
        own = p[:0]
        for a, z in zip(lo[:-1].tolist(), lo[1:].tolist(), strict=True):
            if first[a] == c:
                own = p[a:z]
            else:
                queue[int(first[a])].append(p[a:z])
        return own

    for c in range(257):
        batch = np.concatenate(queue[c]) if queue[c] else order[:0]
        while len(batch):
            out.append(batch)
            batch = push(batch, c)
        batch = order[cut[c] : cut[c + 1]]
        if len(batch):
            out.append(batch)
            push(batch, c)
    every = np.concatenate(out) if out else direct
    owner = np.searchsorted(start, every, side="right") - 1
    return every[every - start[owner] < windows[owner]]


def neighbours_share(flat: bytes, order: np.ndarray, depth: int) -> np.ndarray:
    """For each but the first in ``order``, the common prefix with the one before, capped at ``depth``."""
    a, b = order[:-1], order[1:]
    lcp = np.zeros(len(a), np.int64)
    words = np.ndarray((len(flat) - 7,), "<u8", buffer=flat, strides=(1,))
    live = np.arange(len(a))
    for k in range(depth // 8):
        live = live[words[a[live] + 8 * k] == words[b[live] + 8 * k]]
        if not len(live):
            return lcp
        lcp[live] += 8
    raw = np.frombuffer(flat, np.uint8)
    for k in range(depth // 8 * 8, depth):
        live = live[raw[a[live] + k] == raw[b[live] + k]]
        lcp[live] += 1
    return lcp


def repeated(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each context, which of its windows occur again among all the contexts' windows."""
    size = np.array([len(c) for c in contexts], np.int64)
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    flat = b"\0".join(contexts) + b"\0"
    windows = size - length + 1
    order = suffix_order(flat, start, size, windows, length)
    same = neighbours_share(flat, order, length) >= length
    twice = np.zeros(len(flat), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return [twice[a : a + n] for a, n in zip(start.tolist(), windows.tolist(), strict=True)]


def stretches(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.diff(np.concatenate(([0], flag.astype(np.int8), [0])))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def covered(starts: np.ndarray, ends: np.ndarray, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes under the windows that begin in [starts, ends)."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(ends - 1 + length, n), -1)
    return stretches(np.cumsum(edge[:-1]) > 0)


def _batch(rows: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))


def chunks(table: pa.Table) -> Iterator[pa.Table]:
    """Whole groups (key) of a table, as many together as have up to about ``CHUNK`` bytes of contexts."""
    size = np.concatenate(([0], np.cumsum(pc.binary_length(table.column("context")).to_numpy())))
    lo = 0
    for hi in bounds(table, ["key"])[1:].tolist():
        if size[hi] - size[lo] >= CHUNK or hi == table.num_rows:
            yield table.slice(lo, hi - lo)
            lo = hi


def _sorted(rows: DataFrame, length: int) -> DataFrame:
    """(id, s, e): stretches of repeated windows among the contexts of ``rows`` (key: long, id, context) that share a key."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["key"]):
            for t in chunks(table):
                out = []
                for key, flag in zip(t.column("id").to_pylist(), repeated(t.column("context").to_pylist(), length), strict=True):
                    out += [(key, s, e) for s, e in zip(*(x.tolist() for x in stretches(flag)), strict=True)]
                yield _batch(out, id=pa.binary(), s=pa.int64(), e=pa.int64())

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("key", "id", "context").repartition(parts, "key").sortWithinPartitions("key").mapInArrow(sort, "id binary, s long, e long")


def _in_parts(items: DataFrame, length: int, widths: tuple[int, ...], keep: Held) -> DataFrame:
    """(id, s, e): stretches of repeated windows among many distinct contexts, ``items`` (id, off, context), of the same grams."""
    width = widths[0]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"id": pa.binary(), "s": pa.int64(), "k": pa.int64(), "h": pa.binary(), "core": pa.int64()}
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                key, off, c = (b.column(k)[i].as_py() for k in range(3))
                at = np.arange(len(c) - length + 1)
                cell = (off - at) // width
                lo = np.concatenate(([0], np.flatnonzero(cell[1:] != cell[:-1]) + 1))
                for s, k in zip(lo.tolist(), np.diff(np.concatenate((lo, [len(at)]))).tolist(), strict=True):
                    # The bytes under all windows of the cell, and the part itself with its place.
                    inner = off - int(cell[s]) * width
                    core = xxhash.xxh3_64_intdigest(c[inner : inner - width + 1 + length], seed=int(cell[s])) - (1 << 63)
                    rows.append((key, s, k, xxhash.xxh3_128_digest(c[s : s + k - 1 + length], seed=off - s), core))
                if len(rows) >= PIECES:
                    yield _batch(rows, **kinds)
                    rows = []
            yield _batch(rows, **kinds)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"key": pa.int64(), "id": pa.binary(), "off": pa.int64(), "context": pa.binary(), "m": pa.int64()}
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                off, c, cuts = (b.column(k)[i].as_py() for k in range(3))
                rows += [(x["core"], x["h"], off - x["s"], c[x["s"] : x["s"] + x["k"] - 1 + length], x["m"]) for x in cuts]
                if len(rows) >= PIECES:
                    yield _batch(rows, **kinds)
                    rows = []
            yield _batch(rows, **kinds)

    piece = keep(items.select("id", "off", "context").mapInArrow(cut, "id binary, s long, k long, h binary, core long"), "parts")
    distinct = keep(piece.groupBy("h").agg(F.count("*").alias("c"), F.first("core").alias("core"), F.min(F.struct("id", "s", "k")).alias("at")), "distinct")
    groups = keep(distinct.groupBy("core").agg(F.count("*").alias("m")).where("m > 1"), "groups")
    asked = distinct.join(groups, "core").select(F.col("at.id").alias("id"), F.struct("h", "core", "at.s", "at.k", "m").alias("cut"))
    asked = keep(asked.groupBy("id").agg(F.collect_list("cut").alias("cuts")), "asked")
    met = keep(asked.join(items, "id").select("off", "context", "cuts").mapInArrow(fetch, "key long, id binary, off long, context binary, m long"), "met")
    found = distinct.where("c > 1").select(F.col("h").alias("id"), F.lit(0).cast("long").alias("s"), F.col("at.k").alias("e"))
    found = found.unionByName(_sorted(met.where(F.col("m") <= GROUP_CAP), length))
    many = met.where(F.col("m") > GROUP_CAP)
    if widths[1:] and not many.isEmpty():
        found = found.unionByName(_in_parts(many, length, widths[1:], keep))
    told = keep(found.groupBy(F.col("id").alias("h")).agg(F.collect_list(F.struct("s", "e")).alias("m")), "told")
    placed = piece.select("id", F.col("s").alias("at"), "h").join(told, "h")
    return placed.select("id", F.inline(F.transform("m", lambda x: F.struct((x["s"] + F.col("at")).alias("s"), (x["e"] + F.col("at")).alias("e")))))


def marks(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(tid, marks): for each text that has any, the stretches [s, e) of starts of windows that occur again."""
    spark = docs.sparkSession
    bounded_batches(spark)
    keep = Held()
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    texts = docs.select(raw.alias("raw")).where(F.octet_length("raw") >= length).select(text_key("raw").alias("tid"), "raw")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [runs(t, length) for t in b.column(1).to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            cols = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4)]
            yield pa.record_batch([b.column(0).take(pa.array(at)), *map(pa.array, cols)], names=["tid", "fp", "first", "n", "off"])

    anchors = keep(texts.mapInArrow(find, "tid binary, fp long, first long, n long, off long").dropDuplicates(["tid", "first"]), "anchors")
    # Kept, so that the join below can split a gram that is in very many places.
    twice = keep(anchors.groupBy("fp").agg(F.count("*").alias("c")).where("c > 1").select("fp"), "twice")
    wanted = keep(anchors.join(twice, "fp").groupBy("tid").agg(F.collect_list(F.struct("fp", "first", "n", "off")).alias("runs")), "runs")
    # Each text once; its copies are pre-aggregated.
    once = texts.groupBy("tid").agg(F.first("raw").alias("raw"), F.count("*").alias("copies"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"tid": pa.binary(), "fp": pa.int64(), "first": pa.int64(), "n": pa.int64(), "off": pa.int64(), "ch": pa.binary(), "context": pa.binary()}
        sent: set[bytes] = set()
        for b in batches:
            for i in range(b.num_rows):
                key, text, copies, found = (b.column(k)[i].as_py() for k in range(4))
                if copies > 1:
                    yield _batch([(key, 0, 0, len(text) - length + 1, 0, None, None)], **kinds)
                if not found:
                    continue
                rows = []
                for r in found:
                    c = text[r["first"] : r["first"] + r["n"] + length - 1]
                    ch = xxhash.xxh3_128_digest(c)
                    rows.append((key, r["fp"], r["first"], r["n"], r["off"], ch, None if ch in sent else c))
                    if len(sent) < 200_000:
                        sent.add(ch)
                for s in range(0, len(rows), 2000):
                    yield _batch(rows[s : s + 2000], **kinds)

    placed = once.join(wanted, "tid", "left").where("copies > 1 or runs is not null").select("tid", "raw", "copies", "runs")
    placed = keep(placed.mapInArrow(cut, "tid binary, fp long, first long, n long, off long, ch binary, context binary"), "contexts")
    whole = placed.where("ch is null").select("tid", F.lit(0).cast("long").alias("s"), F.col("n").alias("e"))
    placed = placed.where("ch is not null")
    classes = keep(placed.groupBy("ch", "fp", "n", "off").agg(F.first("context", True).alias("context"), F.count("*").alias("c")), "classes")
    # Kept too: contexts of a large group are many, and the joins below split them.
    crowd = keep(classes.groupBy("fp").agg(F.count("*").alias("m")).where("m > 1"), "crowd")
    cold = classes.join(crowd.where(F.col("m") <= GROUP_CAP), "fp").select(F.col("fp").alias("key"), F.col("ch").alias("id"), "context")
    told = classes.where("c > 1").select(F.col("ch").alias("id"), F.lit(0).cast("long").alias("s"), F.col("n").alias("e"))
    told = told.unionByName(_sorted(cold, length))
    large = crowd.where(F.col("m") > GROUP_CAP).select("fp")
    if not large.isEmpty():
        hot = keep(classes.join(large, "fp").select(F.col("ch").alias("id"), "off", "context"), "hot")
        told = told.unionByName(_in_parts(hot, length, WIDTHS, keep))
    told = keep(told.groupBy(F.col("id").alias("ch")).agg(F.collect_list(F.struct("s", "e")).alias("m")), "told")
    own = placed.select("tid", "first", "ch").join(told, "ch").select("tid", F.transform("m", lambda x: F.struct((x["s"] + F.col("first")).alias("s"), (x["e"] + F.col("first")).alias("e"))).alias("m"))
    out = own.unionByName(whole.select("tid", F.array(F.struct("s", "e")).alias("m"))).groupBy("tid").agg(F.flatten(F.collect_list("m")).alias("marks"))
    out = kept(out, "marks")
    keep.drop()
    return out


def strip_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """For each row: row (a struct of all its columns), kept_text, n_bytes, n_removed, n_spans, kept_sha256.

    kept_text is what is left, decoded without letters that a cut has split; kept_sha256 is of the bytes.

    Removes each byte under a string of ``length`` bytes that starts anywhere else as well, in the same
    text or another; repeated rows count as other texts. Null texts count as empty, texts shorter than
    ``length`` are kept whole, an empty table gives no rows.
    """
    if length % 8 or length < 2 * GRAM:
        raise ValueError("length must be a multiple of 8 and hold two grams")
    found = marks(docs, length)
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw")).select("row", text_key("raw").alias("tid"))
    joined = keyed.join(found, "tid", "left").select("row", "marks")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).field(b.column(0).type.get_field_index("text")).cast(pa.binary()).to_pylist()
            left, n, gone, spans = [], [], [], []
            for t, m in zip(texts, b.column(1).to_pylist(), strict=True):
                t = t or b""
                a, z = covered(np.array([x["s"] for x in m]), np.array([x["e"] for x in m]), len(t), length) if m else (np.zeros(0, np.int64),) * 2
                left.append(b"".join(t[i:j] for i, j in zip([0, *z.tolist()], [*a.tolist(), len(t)], strict=True)))
                n.append(len(t))
                gone.append(int((z - a).sum()))
                spans.append(len(a))
            yield pa.record_batch([b.column(0), pa.array([x.decode("utf-8", "ignore") for x in left], pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())], names=["row", "kept_text", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = keyed.schema["row"].dataType.simpleString()
    return joined.mapInArrow(strip, f"row {kind}, kept_text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op7_suffix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return strip_repeats(docs).select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")
