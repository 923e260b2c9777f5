"""Mixing to target weights with soft domain membership.

A classifier fitted on the labelled table gives each document a posterior over domains (language and
quality of the labelled documents). Document rates r >= 0 are then fitted by projected-gradient least
squares so that the expected token totals sum(r * tokens * posterior) match the targets. The gradient is
scaled by the domains' token-weighted second moments. Over all documents, these give steps that never
overshoot; over those whose rate is above zero, longer steps, which are taken where they bring the
totals closer. Steps end when the totals are at the targets, or when a projected step all but leaves the
rates where they are: nonnegative rates hardly come closer, and the result says that the targets are not met. A document's rate follows from its posterior and the list of steps, so that a pass
over the posteriors only sends one vector per task; documents are never moved.

The classifier is fitted on at most ``LABELLED`` labelled documents chosen by hash: a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, kept
from .folds import bounded_sample

LABELLED, WORDS, CLOSE, FLAT, TEMPER = 8_000, 1024, 1e-7, 2e-3, 0.7
SHAPES = 7


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        b = self[word] = xxhash.xxh32_intdigest(word) % WORDS
        return b


def features(text: bytes, known: _Buckets) -> tuple[int, np.ndarray]:
    """Tokens, and the text as hashed word frequencies and shape: marks, digits, capitals, repeated lines, word length, size."""
    words = text.lower().split()
    x = np.zeros(WORDS + SHAPES, np.float32)
    if words:
        n = np.bincount(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), minlength=WORDS)
        x[:WORDS] = np.sqrt(n / len(words))
        raw = np.frombuffer(text, np.uint8)
        kind = _KIND[raw]
        lines = text.split(b"\n")
        x[WORDS:] = (*(np.bincount(kind, minlength=4)[1:4] / len(raw) * 5), 1 - len(set(lines)) / len(lines), len(raw) / len(words) / 10, np.log1p(len(words)) / 10, len(set(words)) / len(words))
    return len(words), x


_KIND = np.array([1 if 33 <= c < 128 and not chr(c).isalnum() else 2 if 48 <= c < 58 else 3 if 65 <= c < 91 else 0 for c in range(256)])


def fit_classifier(x: np.ndarray, y: np.ndarray, k: int, rounds: int = 150, rate: float = 0.05, ridge: float = 1e-5) -> np.ndarray:
    """Softmax regression (constant last) by Adam over all rows."""
    x = np.column_stack([x, np.ones(len(x), np.float32)]).astype(np.float32)
    w = np.zeros((x.shape[1], k), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    hot = np.eye(k, dtype=np.float32)[y]
    for t in range(1, rounds + 1):
        g = x.T @ (posterior(x, w) - hot) / len(x) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def posterior(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = x @ w
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> dict:
    """Domains and weights. Rows with null labels, languages or ids teach nothing; without any there is one domain, "all"."""
    bounded_batches(docs.sparkSession)
    told = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    told = F.broadcast(bounded_sample(told, most))
    rows = docs.where("lang is not null").select("doc_id", "lang", "text").join(told, "doc_id").select(F.concat_ws("/", "lang", F.col("quality").cast("string")).alias("domain"), F.col("text").cast("binary").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets()
        for b in batches:
            x = [features(t or b"", known)[1].tolist() for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(x, pa.list_(pa.float32()))], names=["domain", "x"])

    t = rows.mapInArrow(run, "domain string, x array<float>").toArrow()
    names = sorted(set(t.column("domain").to_pylist()))
    if not names:
        return {"names": ["all"], "w": np.zeros((WORDS + SHAPES + 1, 1), np.float32)}
    x = t.column("x").combine_chunks().flatten().to_numpy().reshape(-1, WORDS + SHAPES)
    y = np.array([names.index(d) for d in t.column("domain").to_pylist()])
    order = np.lexsort((x[:, WORDS + 4], x[:, WORDS], y))  # sums in one order whatever the partitions
    return {"names": names, "w": fit_classifier(x[order], y[order], len(names))}


def memberships(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, n_tokens, p): tokens and the posterior over ``model["names"]`` for every row."""
    w = model["w"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets()
        for b in batches:
            got = [features(t or b"", known) for t in b.column(1).to_pylist()]
            if not got:
                continue
            x = np.column_stack([np.stack([g[1] for g in got]), np.ones(len(got), np.float32)])
            p = posterior(x.astype(np.float64), w.astype(np.float64))
            yield pa.record_batch([b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array(p.tolist(), pa.list_(pa.float64()))], names=["doc_id", "n_tokens", "p"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("raw")).mapInArrow(run, "doc_id long, n_tokens long, p array<double>")


def rates_of(p: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Rates after the steps: each a gradient step from the last, projected on r >= 0; all begin at 1."""
    r = np.ones(len(p))
    for s in steps:
        r = np.maximum(0, r - p @ s)
    return r


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, k)


def fit_rates(members: DataFrame, k: int, targets: np.ndarray | None = None) -> dict:
    """The list of ``steps``, the ``targets``, the totals ``reached`` and whether they are ``met``; members is (n_tokens, p) and is read once a step.

    Without targets they are the present totals to the power ``TEMPER``, scaled to the same sum.
    """

    def totals(done: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(k + k * k + 1)
            for b in batches:
                got = sums(b.column(0).to_numpy().astype(float), _matrix(b.column(1), k), done, off)
                out += np.concatenate((got[0], got[1].ravel(), [got[2]]))
            yield pa.record_batch([pa.array(np.arange(len(out))), pa.array(out)], names=["i", "x"])

        got = members.select("n_tokens", "p").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(k + k * k + 1)
        for r in got:
            out[r["i"]] = r["x"]
        return out[:k], out[k:-1].reshape(k, k), float(out[-1])

    return descend(totals, k, targets)


def sums(n: np.ndarray, p: np.ndarray, done: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Expected totals after the steps, second moments of the documents whose rate is above zero, and how far a step along ``off`` would still move totals.

    The last is the projected gradient's squared length, weighted by tokens: documents at zero that the step
    would push further down do not count.
    """
    r = rates_of(p, done)
    live = p[r > 0]
    g = p @ off
    return (n * r) @ p, (live * n[r > 0, None]).T @ live, float((n * np.where((r > 0) | (g < 0), g, 0) ** 2).sum())


def descend(totals, k: int, targets: np.ndarray | None, most: int = 2000) -> dict:
    """Projected-gradient steps until the totals are within ``CLOSE`` of the targets, or the plain step would move rates by under ``FLAT``.

    The move is the root mean square over tokens. Neither within ``most`` steps is an error, never a result.
    """
    done = np.zeros((0, k))
    now, active, _ = totals(done, np.zeros(k))
    if targets is None:
        targets = np.where(now > 0, now, 0) ** TEMPER
        targets = targets * (now.sum() / max(targets.sum(), 1e-300))
    scale = lambda m: np.linalg.pinv(m + np.eye(k) * (1e-9 * np.trace(m))) if np.trace(m) > 0 else np.zeros((k, k))
    safe, size, tokens = scale(active), max(1.0, float(np.abs(targets).sum())), float(now.sum())
    left = np.inf
    for _ in range(most):
        off = now - targets
        met = bool(np.abs(off).max() <= CLOSE * size)
        if met or left <= FLAT**2 * tokens or not tokens:
            return {"steps": done, "targets": targets, "reached": now, "met": met}
        step = safe @ off
        longer = np.vstack([done, scale(active) @ off])
        after, live, moved = totals(longer, step)
        if np.linalg.norm(after - targets) >= np.linalg.norm(off):
            longer = np.vstack([done, step])
            after, live, moved = totals(longer, step)
        done, now, active, left = longer, after, live, moved
    raise RuntimeError("the rates did not settle")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """For each row: doc_id, n_tokens, domain (the likeliest), p_domain, rate, and of the domain: target, reached, met.

    ``targets`` maps domains to token totals; see ``fit_rates`` for the default. ``met`` is false for every row
    where no nonnegative rates reach all targets; ``reached`` is then the nearest. Null and empty texts have
    no tokens and move nothing, but get the rate their posterior implies. Of equally likely domains the first by
    name is named. Repeated rows get one rate each; an empty table gives no rows; other columns are ignored.
    """
    model = fit(docs, labels)
    names = model["names"]
    k = len(names)
    members = kept(memberships(docs, model), "memberships")
    want = None if targets is None else np.array([targets.get(n, 0.0) for n in names])
    fitted = fit_rates(members, k, want)
    done = fitted["steps"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _matrix(b.column(2), k)
            if not len(p):
                continue
            top = p.argmax(1)
            cols = [b.column(0), b.column(1), pa.array([names[i] for i in top], pa.string()), pa.array(p.max(1)), pa.array(rates_of(p, done)), pa.array(fitted["targets"][top]), pa.array(fitted["reached"][top]), pa.array(np.full(len(p), fitted["met"]))]
            yield pa.record_batch(cols, names=["doc_id", "n_tokens", "domain", "p_domain", "rate", "target", "reached", "met"])

    return members.mapInArrow(run, "doc_id long, n_tokens long, domain string, p_domain double, rate double, target double, reached double, met boolean")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
