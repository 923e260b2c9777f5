"""Language-model scores from an Elias-Fano n-gram trie.

Level one holds the training words' 64-bit hashes in order, cut into shards by their first bits; a
word's rank is its id. Level two holds the word pairs, cut into shards by both ids, so that the pairs of a very common
word are spread: in each shard the contexts in order, monotone pointers to their children, and the children's
ids made non-decreasing by adding the last value before the context's range, so that a child is found by a
successor search relative to its context. Each pair has its smoothed log10-probability in 16 bits. All sequences are
Elias-Fano coded in files of the shared folder, which the tasks that build and score map into memory when they
first ask for them: no task or driver holds the model. Between counting and building, pairs travel as sorted,
compressed blocks, one for each part of the shards; parts grow in number with the tokens, not in size.

The model is of order two: there is no third level.

P(w | v) = (c(vw) + MU * P(w)) / (c(v) + MU), the Dirichlet-smoothed pair over the add-one word, which
sums to one over the training words and one unknown. A text's tokens are its words and one end; the end
is also the context of the first.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, bounds, grouped, kept, raw_texts, scratch, word_batches
from .elias import EliasFano, Shards, write_file
from .folds import fold

FOLDS, HELD, MU = 7, 2, 300.0
#: Words, or tokens that give pairs, to a shard at most, on average, and tokens to a part of the pairs' shards. A look-up asks
#: every shard once, so shards are as large as a part.
WORDS_PER_SHARD, PAIRS_PER_SHARD, TOKENS_PER_PART = 1 << 18, 1 << 21, 1 << 21
FLOOR = 16.0
#: Words whose ids a task remembers, tokens whose words and whose pairs it looks up at once, and pairs that it holds before it sends them.
REMEMBERED, AT_ONCE, PAIRS_AT_ONCE, SENT_AT_ONCE = 300_000, 250_000, 1_000_000, 2_000_000


def pieces(texts: list[bytes]) -> Iterator[tuple[int, list[bytes], bytes]]:
    """(text, tokens, the token before): each text's words and one end, the empty word, a long text in several pieces."""
    for i, t in enumerate(texts):
        before = b""
        for words in word_batches(t):
            if words:
                yield i, words, before
                before = words[-1]
        yield i, [b""], before


def together(texts: list[bytes], most: int = AT_ONCE) -> Iterator[tuple[list[bytes], list[bytes], np.ndarray, np.ndarray]]:
    """About ``most`` tokens at a time: tokens, and for each piece the token before, its length and its text."""
    words, before, size, owner = [], [], [], []
    for i, some, last in pieces(texts):
        words += some
        before.append(last)
        size.append(len(some))
        owner.append(i)
        if len(words) > most:
            yield words, before, np.array(size), np.array(owner)
            words, before, size, owner = [], [], [], []
    if words:
        yield words, before, np.array(size), np.array(owner)


def power(n: float, least: int) -> int:
    """The exponent of the smallest power of two of at least n, and at least ``least``."""
    return max(least, int(np.ceil(np.log2(max(n, 1)))))


class Words:
    """Level one: ids and counts of words, remembered for the commoner ones."""

    def __init__(self, model: dict) -> None:
        self.bits, self.base = model["word_bits"], model["base"]
        self.shards = Shards(f"{model['at']}/words", lambda x, about: (EliasFano(x, "h", about), x["count"]))
        self._clear()

    def _clear(self) -> None:
        self.place = _Places()
        self.ids, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, n = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        shard = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        first = np.flatnonzero(np.diff(shard[order], prepend=-1))
        for a, z in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
            at, s = order[a:z], int(shard[order[a]])
            if self.shards[s]:
                ef, count = self.shards[s]
                k = ef.find(h[at] & np.uint64((1 << (64 - self.bits)) - 1))
                hit = k >= 0
                ids[at[hit]] = self.base[s] + k[hit]
                n[at[hit]] = count[k[hit]]
        return ids, n

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """The counts of known words by id."""
        out = np.zeros(len(ids), np.int64)
        shard = np.searchsorted(self.base, ids, side="right") - 1
        order = np.argsort(shard, kind="stable")
        first = np.flatnonzero(np.diff(shard[order], prepend=-1))
        for a, z in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
            at, s = order[a:z], int(shard[order[a]])
            out[at] = self.shards[s][1][ids[at] - self.base[s]]
        return out

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts."""
        if len(self.place) > REMEMBERED:
            self._clear()
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        if self.place.new:
            ids, n = self.look(np.array([xxhash.xxh64_intdigest(w) for w in self.place.new], np.uint64))
            self.ids, self.n = np.concatenate((self.ids, ids)), np.concatenate((self.n, n))
            self.place.new = []
        return self.ids[at], self.n[at]


class _Places(dict):
    """Word to its place in order of arrival; new ones are noted."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at


class Pairs:
    """Level two: smoothed probabilities of pairs."""

    def __init__(self, model: dict) -> None:
        self.mask = (1 << model["pair_bits"]) - 1
        self.shards = Shards(f"{model['at']}/pairs", lambda x, about: ({k: EliasFano(x, k, about) for k in ("context", "pointer", "child")}, x["logp"]))

    def look(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 P(w | v) of pairs in ascending order, not a number where the trie has none."""
        out = np.full(len(v), np.nan)
        shard = (v ^ w) & self.mask
        order = np.argsort(shard, kind="stable")
        begin = np.flatnonzero(np.diff(shard[order], prepend=-1))
        for a, z in zip(begin.tolist(), [*begin[1:].tolist(), len(order)], strict=True):
            at, x = order[a:z], self.shards[int(shard[order[a]])]
            if x is None:
                continue
            ef, logp = x
            # Pairs come in order, so a context's pairs are neighbours: each context is looked up once.
            own = v[at]
            first = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1))
            k = ef["context"].find(own[first].astype(np.uint64))
            held = np.flatnonzero(k >= 0)
            ends = ef["pointer"].get(np.concatenate((k[held], k[held] + 1))).astype(np.int64)
            lo, hi = ends[: len(held)], ends[len(held) :]
            base = np.where(lo > 0, ef["child"].get(np.maximum(lo - 1, 0)), np.uint64(0))
            times = np.diff(np.concatenate((first, [len(at)])))
            at = at[np.repeat(k >= 0, times)]
            lo, hi, base = (np.repeat(x, times[held]) for x in (lo, hi, base))
            c = ef["child"].find(w[at].astype(np.uint64) + base, lo, hi)
            out[at[c >= 0]] = logp[c[c >= 0]] * (-FLOOR / 65535)
        return out


def distinct(v: np.ndarray, w: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in ascending order, how often each occurs (its ``n`` summed, if given), and each pair's place among them."""
    if not len(v):
        return v, w, np.zeros(0, np.int64), np.zeros(0, np.int64)
    if max(int(v.max()), int(w.max())) < 1 << 31:
        key = v << 31 | w
        order = np.argsort(key)
        key = key[order]
        moved = key[1:] != key[:-1]
    else:
        order = np.lexsort((w, v))
        moved = (v[order[1:]] != v[order[:-1]]) | (w[order[1:]] != w[order[:-1]])
    first = np.concatenate(([0], np.flatnonzero(moved) + 1))
    place = np.empty(len(v), np.int64)
    place[order] = np.concatenate(([0], np.cumsum(moved)))
    count = np.diff(np.concatenate((first, [len(v)]))) if n is None else np.add.reduceat(n[order], first)
    return v[order[first]], w[order[first]], count, place


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers of one length, compressed byte by byte of their values."""
    out = [len(arrays[0]).to_bytes(8, "little")]
    for a in arrays:
        width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        raw = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
        small = pa.compress(raw, codec="zstd", asbytes=True)
        out += [width.to_bytes(1, "little"), len(small).to_bytes(8, "little"), small]
    return b"".join(out)


def unpacked(data: bytes, count: int) -> list[np.ndarray]:
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    for _ in range(count):
        width, size = data[at], int.from_bytes(data[at + 1 : at + 9], "little")
        raw = pa.decompress(data[at + 9 : at + 9 + size], n * width, codec="zstd", asbytes=True)
        a = np.zeros((n, 8), np.uint8)
        a[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
        out.append(a.ravel().view("<u8").astype(np.int64))
        at += 9 + size
    return out


def base_p(n: np.ndarray, model: dict) -> np.ndarray:
    return (n + 1) / (model["N"] + model["V"] + 1)


def train(docs: DataFrame, mu: float = MU) -> dict:
    """Build the trie from ``docs`` (text) and return where it is. Null texts count as empty; an empty table gives an empty trie."""
    spark = docs.sparkSession
    bounded_batches(spark)
    raw = docs.select(F.col("text").cast("binary").alias("raw"))
    at = scratch(spark, "trie")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            h = np.array([xxhash.xxh64_intdigest(w) for w in seen], np.uint64)
            out = pa.record_batch([pa.array(h.view(np.int64)), pa.array(list(seen.values()), pa.int64())], names=["h", "n"])
            seen.clear()
            return out

        for b in batches:
            for t in raw_texts(b.column(0)):
                for some in word_batches(t):
                    seen.update(some)
                seen[b""] += 1
            if len(seen) > 300_000:
                yield flush()
        if seen:
            yield flush()

    words = raw.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    words = kept(words, "words")
    total = words.agg(F.count("*").alias("V"), F.sum("n").alias("N")).first()
    size, n = int(total["V"]), int(total["N"] or 0)
    bits = power(size / WORDS_PER_SHARD, 4)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def build_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["shard"]):
            cut = bounds(table, ["shard"])
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                t = table.slice(a, b - a)
                shard = int(t.column("shard")[0].as_py())
                h = t.column("h").to_numpy().view(np.uint64) & np.uint64((1 << (64 - bits)) - 1)
                arrays, meta = EliasFano.build(h, "h")
                write_file(f"{at}/words-{shard}", arrays | {"count": t.column("n").to_numpy()}, **meta)
                yield pa.record_batch([pa.array([shard]), pa.array([len(h)])], names=["shard", "size"])

    shard = F.shiftrightunsigned("h", 64 - bits)
    made = words.withColumn("shard", shard).repartition(parts, "shard").sortWithinPartitions("shard", F.col("h") < 0, "h").mapInArrow(build_words, "shard long, size long").collect()
    sizes = np.zeros(1 << bits, np.int64)
    for r in made:
        sizes[r["shard"]] = r["size"]
    model = {"at": at, "word_bits": bits, "base": np.concatenate(([0], np.cumsum(sizes))), "N": n, "V": size, "mu": mu, "pair_bits": power(n / PAIRS_PER_SHARD, 6)}
    if not n:
        return model
    pair_bits = model["pair_bits"]
    groups = min(1 << pair_bits, -(-n // TOKENS_PER_PART))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of distinct pairs in the order of their shards, one for each part."""
        level, held, many = Words(model), [], 0

        def flush() -> pa.RecordBatch:
            v, w, c, _ = distinct(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            part = ((v ^ w) & ((1 << pair_bits) - 1)) * groups >> pair_bits
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(groups + 1))
            full = np.flatnonzero(cut[1:] > cut[:-1])
            blocks = []
            for g in full.tolist():
                i = order[cut[g] : cut[g + 1]]
                blocks.append(packed(np.diff(v[i], prepend=0), w[i], c[i]))
            return pa.record_batch([pa.array(full), pa.array(blocks, pa.binary())], names=["part", "block"])

        for b in batches:
            for words, before, length, _ in together(raw_texts(b.column(0))):
                ids, _ = level.of(words)
                v = np.concatenate(([0], ids[:-1]))
                v[np.cumsum(length) - length] = level.of(before)[0]
                held.append((v, ids))
                many += len(ids)
                if many > SENT_AT_ONCE:
                    yield flush()
                    many = 0
        if held:
            yield flush()

    def build_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = Words(model)
        for table in grouped(batches, ["part"]):
            cut = bounds(table, ["part"])
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                got = [unpacked(x.as_py(), 3) for x in table.column("block").slice(a, b - a)]
                v, w, c, _ = distinct(np.concatenate([np.cumsum(x[0]) for x in got]), np.concatenate([x[1] for x in got]), np.concatenate([x[2] for x in got]))
                del got
                shard = (v ^ w) & ((1 << pair_bits) - 1)
                order = np.argsort(shard, kind="stable")
                first = np.flatnonzero(np.diff(shard[order], prepend=-1))
                for i, j in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
                    own = order[i:j]
                    build(int(shard[own[0]]), v[own], w[own], c[own], level)
                yield pa.record_batch([pa.array([len(first)])], names=["shards"])

    def build(shard: int, v: np.ndarray, w: np.ndarray, c: np.ndarray, level: Words) -> None:
        p = np.log10((c + mu * base_p(level.counts(w), model)) / (level.counts(v) + mu))
        logp = np.round(np.clip(-p, 0, FLOOR) * (65535 / FLOOR)).astype(np.uint16)
        start = np.concatenate(([0], np.flatnonzero(v[1:] != v[:-1]) + 1))
        ends = np.concatenate((start[1:], [len(v)])) - 1
        # Children become non-decreasing: each context adds the last value of the one before.
        add = np.concatenate(([0], np.cumsum(w[ends])[:-1]))
        child = w + np.repeat(add, np.diff(np.concatenate((start, [len(v)]))))
        arrays, meta = {"logp": logp}, {}
        for name, x in (("context", v[start]), ("pointer", np.concatenate((start, [len(v)]))), ("child", child)):
            more, about = EliasFano.build(x, name)
            arrays, meta = arrays | more, meta | about
        write_file(f"{at}/pairs-{shard}", arrays, **meta)

    found = raw.mapInArrow(pairs, "part long, block binary")
    built = found.repartition(max(parts, groups), "part").sortWithinPartitions("part").mapInArrow(build_pairs, "shards long")
    model["pair_shards"] = built.agg(F.sum("shards")).first()[0]
    return model


def scores(docs: DataFrame, model: dict) -> DataFrame:
    """For each row: doc_id, n_tokens, n_known, base_score, score.

    Null texts count as empty: one end. A long text is scored whole, its tokens a piece at a time. Repeated rows
    score alike; an empty table gives no rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, trie = Words(model), Pairs(model)
        held: list[tuple] = []  # a batch's sums; its pieces' texts and lengths; ids, counts, ids before, counts before
        ready: list[tuple] = []  # batches not yet sent, with their sums

        def settle() -> None:
            ids, n, v, c = (np.concatenate([h[k] for h in held]) for k in range(3, 7))
            p1 = base_p(n, model)
            back = np.log10(np.where(v >= 0, model["mu"] * p1 / (np.where(v >= 0, c, 0) + model["mu"]), p1))
            both = np.flatnonzero((v >= 0) & (ids >= 0))
            one, two, _, place = distinct(v[both], ids[both])
            found = trie.look(one, two)[place] if len(one) else np.zeros(0)
            seen = ~np.isnan(found)
            back[both[seen]] = found[seen]
            each, at = (np.ones(len(n)), (n > 0).astype(float), np.log10(p1), back), 0
            for out, owner, length, own, *_ in held:
                start = np.cumsum(length) - length
                for k, x in enumerate(each):
                    out[k] += np.bincount(owner, weights=np.add.reduceat(x[at : at + len(own)], start), minlength=out.shape[1])
                at += len(own)
            held.clear()

        def send() -> Iterator[pa.RecordBatch]:
            if held:
                settle()
            for ids, out in ready:
                yield pa.record_batch([ids, *(pa.array(x.astype(np.int64)) for x in out[:2]), *map(pa.array, out[2:])], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])
            ready.clear()

        for b in batches:
            out, full = np.zeros((4, b.num_rows)), False
            ready.append((b.column(0), out))
            for words, before, length, owner in together(raw_texts(b.column(1))):
                ids, n = level.of(words)
                v, c = np.concatenate(([0], ids[:-1])), np.concatenate(([0], n[:-1]))
                start = np.cumsum(length) - length
                v[start], c[start] = level.of(before)
                held.append((out, owner, length, ids, n, v, c))
                if sum(len(h[3]) for h in held) > PAIRS_AT_ONCE:
                    settle()
                    full = True
            if full:
                yield from send()
        yield from send()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("raw")).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def op9_ngram(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.where(fold(FOLDS) != HELD))
    out = scores(docs, model)
    return out.select("doc_id", (fold(FOLDS) == HELD).alias("held_out"), "n_tokens", "n_known", F.lit(model["N"]).cast("long").alias("train_tokens"), "base_score", "score")
