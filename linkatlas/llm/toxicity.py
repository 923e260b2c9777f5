"""Toxic passages as maximum-scoring segments of token log-odds, with extreme-value calibration.

A token is counted as itself and by its first bytes (``STEMS``). Each of these has log-odds of toxic
against clean labelled documents under an informative Dirichlet prior (its prior count is its share of
the whole), less ``ERRORS`` standard errors, or zero if that is under ``LEAST``; the token's score is the best of
them, so that only well-attested tokens score above zero, less ``DRIFT``, which keeps the expected score negative. Words
and stems are hashed into 2**BITS buckets, so the model's size is fixed. One linear scan
per text finds all maximal scoring segments. With lambda the positive root of
E[exp(lambda * score)] = 1 over clean texts' tokens and K fitted on their best segments, a segment of
score S in n tokens is worth lambda * S - ln(K n) nats; segments worth over zero are significant. Their
best and summed worth give the document's score through a logistic curve fitted on documents that the
token scores have not seen.

At most ``LABELLED`` labelled documents are used (all of them if there are fewer), chosen by hash: a
bounded sample for fitting; every document is scored whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .folds import bounded_sample, fold

BITS, LABELLED, PRIOR, DRIFT, FOLDS = 20, 40_000, 2000.0, 0.1, 5
ERRORS, LEAST = 3.0, 0.7
STEMS = (3, 4, 5, 6, 7, 8, 9)
#: Bins for the spread of clean tokens' scores.
BINS = (np.arange(-10, 401) + 0.5) / 20
#: Everything but letters parts tokens; bytes from 80 up are kept as letters.
TO_SPACE = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def words_in(text: str | None, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The tokens of about ``most`` bytes at a time, so that a long text is never all tokens at once."""
    flat = (text or "").lower().encode("utf-8", "replace").translate(TO_SPACE)
    at = 0
    while at < len(flat):
        end = flat.find(b" ", at + most)
        end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end


def buckets(word: bytes) -> list[int]:
    """The word's own bucket and those of its stems; a shorter word stands for its missing stems."""
    digest, mask = xxhash.xxh32_intdigest, (1 << BITS) - 1
    return [digest(word) & mask, *(digest(word[:k], k) & mask for k in STEMS)]


class Scores(dict):
    """Token to score, remembered while there is room."""

    def __init__(self, table: np.ndarray) -> None:
        super().__init__()
        self.table = table

    def __missing__(self, word: bytes) -> float:
        if len(self) > 300_000:
            self.clear()
        s = self[word] = float(self.table[buckets(word)].max()) - DRIFT
        return s

    def of(self, text: str | None) -> np.ndarray:
        parts = [np.fromiter(map(self.__getitem__, words), np.float64, len(words)) for words in words_in(text)]
        return np.concatenate(parts) if parts else np.zeros(0)


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) of a sequence, left to right, in linear time.

    Each segment remembers the last earlier one that begins at a smaller total: whatever stands between
    them begins at larger totals and need not be looked at again.
    """
    at = np.flatnonzero(score > 0)
    if not len(at):
        return []
    total = np.concatenate(([0.0], np.cumsum(score)))
    found: list[tuple[int, int, float, float, int]] = []  # first, end, total before, total after, link
    for i, before, after in zip(at.tolist(), total[at].tolist(), total[at + 1].tolist(), strict=True):
        first, end, low, high = i, i + 1, before, after
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append((first, end, low, high, j))
                break
            first, low, link = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = link
    return [(a, b, hi - lo) for a, b, lo, hi, _ in found]


def log_odds(toxic: np.ndarray, clean: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """A lower bound of each bucket's log-odds, zero at least; see the module's text."""
    n1, n0 = toxic.sum(), clean.sum()
    if not n1 or not n0:
        return np.zeros(len(toxic), np.float32)
    a = prior * (toxic + clean + 0.01) / (n1 + n0 + 0.01 * len(toxic))
    y1, y0 = toxic + a, clean + a
    delta = np.log(y1 / (n1 + prior - y1)) - np.log(y0 / (n0 + prior - y0))
    low = delta - ERRORS * np.sqrt(1 / y1 + 1 / y0)
    return np.where(low > LEAST, low, 0).astype(np.float32)


def karlin_lambda(score: np.ndarray, n: np.ndarray) -> float:
    """The positive root of the moment equation for scores seen ``n`` times; 1 where none is above zero."""
    p = n / max(1.0, n.sum())
    if not (p[score > 0] > 0).any():
        return 1.0
    lo, hi = 1e-6, 1.0
    f = lambda x: float((p * np.exp(np.minimum(x * score, 500))).sum()) - 1
    while f(hi) < 0 and hi < 64:
        hi *= 2
    if f(lo) > 0:
        return lo
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def worth(found: list[tuple[int, int, float]], n: int, lam: float, k: float) -> tuple[float, float, list]:
    """Best and summed worth of the significant segments, and those segments."""
    floor = float(np.log(max(k * n, 1e-9)))
    good = [(a, b, lam * s - floor) for a, b, s in found if lam * s > floor]
    return max((x[2] for x in good), default=0.0), sum(x[2] for x in good), good


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights (constant first) by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * len(y) * w * ([0] + [1] * (len(w) - 1))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def features(best: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.column_stack([np.log1p(best), np.log1p(total)])


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> dict:
    """The model, from labelled documents outside fold 0: token scores from folds 1 to 3, the curve from fold 4.

    Rows with null labels, ids or texts teach nothing; of repeated labels for one id the larger counts.
    Without toxic or without clean documents the curve is a fixed one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    told = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    told = bounded_sample(told.where(fold(FOLDS) > 0), most)
    rows = docs.where(fold(FOLDS) > 0).select("doc_id", "text").join(F.broadcast(told), "doc_id").select(fold(FOLDS).cast("int").alias("fold"), "toxic", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << BITS), np.int64)
        for b in batches:
            words: tuple[Counter, Counter] = (Counter(), Counter())
            for y, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for some in words_in(t):
                    words[int(y > 0)].update(some)
            for y, seen in enumerate(words):
                if seen:
                    at = np.array([buckets(w) for w in seen])
                    np.add.at(n[y], at, np.fromiter(seen.values(), np.int64, len(seen))[:, None])
        at = np.flatnonzero(n.any(0))
        for s in range(0, len(at), 1 << 16):
            p = at[s : s + (1 << 16)]
            yield pa.record_batch([pa.array(p), pa.array(n[1, p]), pa.array(n[0, p])], names=["bucket", "toxic", "clean"])

    counts = rows.where("fold < 4").mapInArrow(count, "bucket long, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow()
    toxic, clean = np.zeros(1 << BITS), np.zeros(1 << BITS)
    at = counts.column("bucket").to_numpy()
    toxic[at], clean[at] = counts.column("toxic").to_numpy(), counts.column("clean").to_numpy()
    sent = spark.sparkContext.broadcast(log_odds(toxic, clean))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's tokens and best segment; under -1 the spread of the clean ones' token scores."""
        scores, spread = Scores(sent.value), np.zeros(len(BINS) - 1, np.int64)
        for b in batches:
            out = []
            for y, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                s = scores.of(t)
                out.append((int(y > 0), len(s), max((x for _, _, x in segments(s)), default=0.0)))
                if y <= 0:
                    spread += np.histogram(np.minimum(s, BINS[-1]), BINS)[0]
            yield pa.record_batch([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["toxic", "n", "best"])
        at = np.flatnonzero(spread)
        yield pa.record_batch([pa.array(np.full(len(at), -1)), pa.array(at), pa.array(spread[at].astype(float))], names=["toxic", "n", "best"])

    held = rows.where("fold = 4")
    seen = held.mapInArrow(measure, "toxic long, n long, best double").toArrow()
    y, n, best = (seen.column(c).to_numpy() for c in ("toxic", "n", "best"))
    spread = np.bincount(n[y < 0], weights=best[y < 0], minlength=len(BINS) - 1)
    lam = karlin_lambda((BINS[:-1] + BINS[1:]) / 2, spread)
    fit_k = n[(y == 0) & (n > 0)] * np.exp(-lam * best[(y == 0) & (n > 0)])
    k = float(np.clip(1 / max(fit_k.mean(), 1e-9), 1e-4, 1.0)) if len(fit_k) else 0.1
    curve = np.array([-3.0, 3.0, 0.0])
    y = y[y >= 0]
    if len(y) > 10 and 0 < y.mean() < 1:

        def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scores = Scores(sent.value)
            for b in batches:
                out = []
                for y, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    s = scores.of(t)
                    out.append((int(y > 0), *worth(segments(s), len(s), lam, k)[:2]))
                yield pa.record_batch([pa.array([r[j] for r in out], kind) for j, kind in enumerate((pa.int64(), pa.float64(), pa.float64()))], names=["toxic", "best", "total"])

        w = held.mapInArrow(value, "toxic long, best double, total double").toArrow()
        curve = logistic(features(w.column("best").to_numpy(), w.column("total").to_numpy()), w.column("toxic").to_numpy().astype(float))
    return {"table": sent, "lambda": lam, "k": k, "curve": curve.tolist()}


def toxic_passages(docs: DataFrame, model: dict) -> DataFrame:
    """For each row: row (a struct of all its columns), score, passages (array of first token, end token, worth in nats), n_tokens.

    Null, empty and letterless texts have no passages and the score of a text without any. Repeated rows
    are scored alike; of equally good tokens each counts for itself; a long text is scanned whole, its tokens
    a part at a time; an empty table gives no rows; other columns travel along in ``row``.
    """
    bounded_batches(docs.sparkSession)
    sent, lam, k, curve = model["table"], model["lambda"], model["k"], np.array(model["curve"])
    at = docs.columns.index("text")
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("worth", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(sent.value)
        for b in batches:
            out = []
            for t in b.column(0).field(at).to_pylist():
                s = scores.of(t)
                out.append((*worth(segments(s), len(s), lam, k), len(s)))
            x = features(np.array([o[0] for o in out]), np.array([o[1] for o in out]))
            p = 1 / (1 + np.exp(-np.clip(curve[0] + x @ curve[1:], -30, 30)))
            spans = [[{"first": f, "end": e, "worth": w} for f, e, w in o[2]] for o in out]
            yield pa.record_batch([b.column(0), pa.array(p), pa.array(spans, kind), pa.array([o[3] for o in out], pa.int64())], names=["row", "score", "passages", "n_tokens"])

    return docs.select(F.struct("*").alias("row")).mapInArrow(run, f"row {docs.schema.simpleString()}, score double, passages array<struct<first:long,end:long,worth:double>>, n_tokens long")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    out = toxic_passages(docs, model).select(F.col("row.doc_id").cast("long").alias("doc_id"), "score", "passages")
    return out.select("doc_id", (fold(FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
