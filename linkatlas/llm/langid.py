"""Language spans: script ranges narrow the candidates, then Viterbi over per-word scores.

A word is a run of letters (with their marks) of one script, cut every ``PIECES`` letters, so that a language
can change within text that has no spaces. Its score for a language is the sum of its byte trigrams' smoothed
log-probabilities (hashed into 2**16 cells). Its script, by the code points' ranges, rules out languages that
hardly use it. The best path over a text's words pays ``SWITCH`` nats per change of language; its runs are
the spans. The language with the most bytes of words names the document, and its share is the score.

Trigram counts come from at most ``LABELLED`` documents with a language, chosen by hash: a bounded
sample for fitting; every document is labelled whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .folds import bounded_sample, fold

CELLS, SWITCH, LABELLED, FOLDS, HELD = 1 << 16, 12.0, 20_000, 4, 2
#: First code points of script blocks, in order.
SCRIPTS = [(0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x800, "indic"), (0x1000, "other"), (0x1E00, "latin"), (0x2000, "other"), (0x3040, "kana"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other")]
NAMES = sorted({n for _, n in SCRIPTS})


#: Letters to a word at most: fewer in scripts that are written without spaces.
PIECES = {n: 4 if n in ("han", "kana", "other") else 32 for n in NAMES}
#: Codes of code points: no letter, a mark (which goes with the letter before), else one more than the script.
NO, MARK = 0, 255


def _codes(size: int = 0x30000) -> np.ndarray:
    """The code of each code point; those past the scripts' table are letters of script "other", or "han" from 20000 up."""
    out = np.zeros(size, np.uint8)
    starts = [first for first, _ in SCRIPTS]
    for cp in range(0x10000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "M":
            out[cp] = MARK
        elif kind == "L":
            out[cp] = 1 + NAMES.index(SCRIPTS[int(np.searchsorted(starts, cp, side="right")) - 1][1])
    for cp in range(0x10000, 0x20000):
        kind = unicodedata.category(chr(cp))[0]
        out[cp] = MARK if kind == "M" else 1 + NAMES.index("other") if kind == "L" else NO
    out[0x20000:] = 1 + NAMES.index("han")
    return out


CODES = _codes()
MOST = np.array([PIECES[n] for n in NAMES])


def flat(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' words in UTF-8, lower case, parted by single spaces, with one before and one after; each word's text and script."""
    lower = [(t or "").lower() for t in texts]
    cp = np.frombuffer(" ".join([*lower, ""]).encode("utf-32-le", "replace"), np.uint32)
    code = CODES[np.minimum(cp, len(CODES) - 1)]
    # Marks take the code of what stands before.
    at = np.where(code != MARK, np.arange(len(cp)), 0)
    code = code[np.maximum.accumulate(at)] if len(cp) else code
    code = np.where(code == MARK, NO, code)
    letter = code != NO
    moved = np.concatenate(([True], code[1:] != code[:-1]))[: len(cp)]
    begin = np.maximum.accumulate(np.where(moved, np.arange(len(cp)), 0))
    start = letter & ((np.arange(len(cp)) - begin) % MOST[np.maximum(code, 1) - 1] == 0)
    where = np.flatnonzero(start)
    ends = np.cumsum([len(t) + 1 for t in lower])
    kept = np.flatnonzero(letter)
    spaced = np.insert(cp[kept], np.searchsorted(kept, where), 32)
    b = spaced.astype("<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8", "replace") + b" "
    return np.frombuffer(b if len(where) else b" ", np.uint8), np.searchsorted(ends, where, side="right"), code[where] - 1


def trigrams(b: np.ndarray) -> np.ndarray:
    """The cell of the trigram around each byte but the first and last."""
    x = b.astype(np.uint32)
    return ((x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(2654435761)) >> np.uint32(16)


def words_of(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    letter = np.concatenate(([0], (b != 32).view(np.int8), [0]))
    step = np.diff(letter)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def fit(docs: DataFrame, most: int = LABELLED) -> dict | None:
    """The model from documents with text and lang outside the held fold; None if there are none."""
    spark = docs.sparkSession
    bounded_batches(spark)
    told = docs.where((fold(FOLDS) != HELD) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    told = bounded_sample(told, most).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            texts = batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                b, _, script = flat([texts[i] for i in np.flatnonzero(langs == lang)])
                if lang not in n:
                    n[lang], scripts[lang] = np.zeros(CELLS, np.int64), np.zeros(len(NAMES), np.int64)
                n[lang] += np.bincount(trigrams(b)[b[1:-1] != 32], minlength=CELLS)
                scripts[lang] += np.bincount(script, minlength=len(NAMES))
        for lang, c in n.items():
            at = np.flatnonzero(c)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(c[at])], names=["lang", "cell", "n"])
            yield pa.record_batch([pa.array([lang] * len(NAMES), pa.string()), pa.array(-1 - np.arange(len(NAMES))), pa.array(scripts[lang])], names=["lang", "cell", "n"])

    t = told.mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    lang, cell, n = np.array(t.column("lang").to_pylist(), object), t.column("cell").to_numpy(), t.column("n").to_numpy()
    langs = sorted(set(lang))
    if not langs:
        return None
    logp, allowed = np.zeros((CELLS, len(langs)), np.float32), np.zeros((len(NAMES), len(langs)), bool)
    for k, name in enumerate(langs):
        c, s = np.full(CELLS, 0.05), np.zeros(len(NAMES))
        own = (lang == name) & (cell >= 0)
        c[cell[own]] += n[own]
        logp[:, k] = np.log(c / c.sum())
        own = (lang == name) & (cell < 0)
        s[-1 - cell[own]] = n[own]
        allowed[:, k] = s >= max(1, 0.002 * s.sum())
    allowed[~allowed.any(1)] = True
    return {"langs": langs, "logp": spark.sparkContext.broadcast(logp), "allowed": allowed}


def viterbi(score: np.ndarray, starts: np.ndarray, switch: float = SWITCH, long: int = 1 << 15) -> np.ndarray:
    """The best state of each word; ``starts`` has where each text's words begin, and the total. Ties stay, or go to the first state."""
    size = np.diff(starts)
    out = np.empty(len(score), np.int64)
    for i in np.flatnonzero(size > long):
        out[starts[i] : starts[i + 1]] = _long_path(score[starts[i] : starts[i + 1]], switch, min(long, 1024))
    size = np.where(size > long, 0, size)
    order = np.argsort(-size, kind="stable")
    first, size = starts[:-1][order], size[order]
    best = np.empty_like(score)
    came = np.empty(score.shape, np.int16)
    live = int((size > 0).sum())
    now = score[first[:live]].copy()
    best[first[:live]], came[first[:live]] = now, 0
    own = np.arange(score.shape[1], dtype=np.int16)
    for t in range(1, int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -t, side="left"))
        now = now[:live]
        top = now.argmax(1)
        jump = now[np.arange(live), top] - switch
        stay = now >= jump[:, None]
        at = first[:live] + t
        came[at] = np.where(stay, own, top[:, None])
        now = np.where(stay, now, jump[:, None]) + score[at]
        now -= now.max(1, keepdims=True)
        best[at] = now
    alive = np.zeros(0, np.int64)
    for t in range((int(size[0]) if len(size) else 0) - 1, -1, -1):
        live = int(np.searchsorted(-size, -t, side="left"))
        at = first[:live] + t
        new = best[at[len(alive) :]].argmax(1)
        state = np.concatenate([came[at[: len(alive)] + 1, alive] if len(alive) else alive, new])
        out[at] = state
        alive = state
    return out


def _long_path(score: np.ndarray, switch: float, step: int) -> np.ndarray:
    """One text's best path: all its blocks of ``step`` words at once for each state they may be entered in, then block after block."""
    n, k = score.shape
    blocks = -(-n // step)
    s = np.zeros((blocks * step, k))
    s[:n] = score
    s = s.reshape(blocks, step, k)
    own = np.arange(k, dtype=np.int16)
    enter = np.where(own[:, None] == own, 0.0, -switch)
    now = enter[None] + s[:, 0, None, :]  # block, state before it, state at its word
    came = np.empty((blocks, step, k, k), np.int16)
    for t in range(1, step):
        top = now.argmax(2)
        jump = now.max(2)[..., None] - switch
        stay = now >= jump
        came[:, t] = np.where(stay, own, top[..., None])
        now = np.where(stay, now, jump) + s[:, t, None, :]
    value, entered = np.zeros(k), np.empty((blocks, k), np.int64)
    for b in range(blocks):
        way = value[:, None] + now[b]
        entered[b], value = way.argmax(0), way.max(0)
        value = value - value.max()
    last, before = np.empty(blocks, np.int64), np.empty(blocks, np.int64)
    state = int(value.argmax())
    for b in range(blocks - 1, -1, -1):
        last[b], before[b] = state, entered[b, state]
        state = int(before[b])
    path = np.empty((blocks, step), np.int64)
    path[:, -1] = last
    each = np.arange(blocks)
    for t in range(step - 1, 0, -1):
        path[:, t - 1] = came[each, t, before, path[:, t]]
    return path.ravel()[:n]


def spans(docs: DataFrame, model: dict | None) -> DataFrame:
    """For each row: doc_id, lang_pred, score, spans (array of first word, end word, lang).

    ``und``, score 0 and no spans for texts that are null or without a letter, and for all texts where the
    model is None. Of languages with equally many bytes the first by name is predicted; a tie between two paths
    stays in the language it is in, or begins in the first by name. Long texts are labelled whole. Repeated rows
    are labelled alike; an empty table gives no rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            pred, share, runs = ["und"] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
            b, text_of, script = flat(texts)
            first, end = words_of(b)
            if model and len(first):
                langs, logp = model["langs"], model["logp"].value
                cell = trigrams(b)
                # Words are parted by single spaces, so sums between starts take in one trigram around a space; it is zeroed.
                score = np.empty((len(first), len(langs)), np.float32)
                inside = b[1:-1] != 32
                for k in range(len(langs)):
                    score[:, k] = np.add.reduceat(np.where(inside, logp[cell, k], 0).astype(np.float64), first - 1)
                score = np.where(model["allowed"][script], score, score.min(1, keepdims=True) - 50)
                starts = np.searchsorted(text_of, np.arange(len(texts) + 1))
                state = viterbi(score, starts)
                mass = np.zeros((len(texts), len(langs)))
                np.add.at(mass, (text_of, state), end - first)
                total = mass.sum(1)
                change = np.flatnonzero(np.concatenate(([True], (state[1:] != state[:-1]) | (text_of[1:] != text_of[:-1]))))
                for a, z in zip(change.tolist(), [*change[1:].tolist(), len(state)], strict=True):
                    i = int(text_of[a])
                    runs[i].append({"first": a - int(starts[i]), "end": z - int(starts[i]), "lang": langs[state[a]]})
                for i in np.flatnonzero(total):
                    top = int(mass[i].argmax())
                    pred[i], share[i] = langs[top], mass[i, top] / total[i]
            yield pa.record_batch([batch.column(0), pa.array(pred, pa.string()), pa.array(share), pa.array(runs, kind)], names=["doc_id", "lang_pred", "score", "spans"])

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<first:long,end:long,lang:string>>")


def op6_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = spans(docs, fit(docs))
    return out.select("doc_id", (fold(FOLDS) == HELD).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
