"""Elias-Fano sequences in flat files that are memory-mapped, with vectorised access and successor search."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

import numpy as np


def local_path(uri: str) -> str:
    """The path of a file URI, or of a plain path."""
    return uri.removeprefix("file://") if uri.startswith("file:///") else uri.removeprefix("file:")


def write_file(uri: str, arrays: dict[str, np.ndarray], **meta) -> None:
    """Write arrays under a header; the file appears whole or not at all, and a repeated task writes it again."""
    head, at, parts = {}, 0, []
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        head[name] = [a.dtype.str, at, len(a)]
        raw += b"\0" * (-len(raw) % 8)
        parts.append(raw)
        at += len(raw)
    text = json.dumps({"arrays": head, "meta": meta}).encode()
    text += b" " * (-len(text) % 8)
    data = [len(text).to_bytes(8, "little"), text, *parts]
    if "://" in uri and not uri.startswith("file:"):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        with store.open_output_stream(path) as f:
            for d in data:
                f.write(d)
        return
    path = local_path(uri)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(part := f"{path}.{uuid.uuid4().hex}", "wb") as f:
        f.writelines(data)
    os.replace(part, path)


def read_file(uri: str) -> tuple[dict[str, np.ndarray], dict]:
    """Map a file's arrays; one in a remote store is fetched to a temporary file that is unlinked at once."""
    if "://" in uri and not uri.startswith("file:"):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        with store.open_input_stream(path) as f, tempfile.TemporaryFile() as t:
            while chunk := f.read(1 << 22):
                t.write(chunk)
            t.flush()
            raw = np.memmap(t, np.uint8, mode="r")
    else:
        raw = np.memmap(local_path(uri), np.uint8, mode="r")
    raw = np.asarray(raw)
    n = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + n].tobytes())
    at = 8 + n
    return {k: raw[at + a : at + a + size * np.dtype(d).itemsize].view(d) for k, (d, a, size) in head["arrays"].items()}, head["meta"]


class Shards(dict):
    """Files by number, opened when first asked for; one that was never written is None."""

    def __init__(self, stem: str, load) -> None:
        super().__init__()
        self.stem, self.load = stem, load

    def __missing__(self, k: int):
        try:
            self[k] = self.load(*read_file(f"{self.stem}-{k}"))
        except FileNotFoundError:
            self[k] = None
        return self[k]


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary, with running counts per 64-bit word."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str, meta: dict) -> None:
        self.n, self.low_bits = meta[f"{name}.n"], meta[f"{name}.l"]
        self.low, self.high, self.ones, self.zeros = (arrays[f"{name}.{k}"] for k in ("low", "high", "ones", "zeros"))

    @staticmethod
    def build(values: np.ndarray, name: str) -> tuple[dict[str, np.ndarray], dict]:
        v = values.astype(np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits and n:
            part = v & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << off)
            over = off + np.uint64(bits) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - off[over]))
        hi = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = (top >> bits) + n + 1
        words = size // 64 + 1
        flags = np.zeros(words * 64, np.uint8)
        flags[hi] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        per = flags.reshape(-1, 64).sum(1, dtype=np.int64)
        ones = np.concatenate(([0], np.cumsum(per)))
        zeros = np.arange(words + 1) * 64 - ones
        kind = np.uint32 if words * 64 < 1 << 32 else np.int64
        return {f"{name}.low": low, f"{name}.high": high, f"{name}.ones": ones.astype(kind), f"{name}.zeros": zeros.astype(kind)}, {f"{name}.n": n, f"{name}.l": bits}

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        v = self.low[word] >> off
        over = off + np.uint64(self.low_bits) > 64
        v[over] |= self.low[word[over] + 1] << (np.uint64(64) - off[over])
        return v & np.uint64((1 << self.low_bits) - 1)

    def _select(self, k: np.ndarray, counts: np.ndarray, flip: bool) -> np.ndarray:
        word = np.searchsorted(counts, k.astype(counts.dtype), side="right") - 1
        rest = k - counts[word].astype(np.int64)
        w = ~self.high[word] if flip else self.high[word]
        at = word << 6
        # Halve the word until the bit is found.
        for width in (32, 16, 8, 4, 2, 1):
            below = np.bitwise_count(w & np.uint64((1 << width) - 1)).astype(np.int64)
            on = rest >= below
            rest = rest - below * on
            at += on * width
            w = w >> (on * width).astype(np.uint64)
        return at

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at ``i``."""
        if not len(i):
            return np.zeros(0, np.uint64)
        high = (self._select(i, self.ones, False) - i).astype(np.uint64)
        return high << np.uint64(self.low_bits) | self._lows(i)

    def find(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Successor search: the first place in [lo, hi) with a value of at least x, or -1 unless it equals x."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        top = (x >> np.uint64(self.low_bits)).astype(np.int64)
        q = np.flatnonzero(top < int(self.zeros[-1]))
        top, low = top[q], x[q] & np.uint64((1 << self.low_bits) - 1)
        prev = np.maximum(top - 1, 0)
        a = np.where(top > 0, self._select(prev, self.zeros, True) - prev, 0)
        b = np.minimum(self._select(top, self.zeros, True) - top, self.n)
        if lo is not None:
            a, b = np.maximum(a, lo[q]), np.minimum(b, hi[q])
        end = b.copy()
        live = np.flatnonzero(a < b)
        while len(live):
            mid = (a[live] + b[live]) >> 1
            less = self._lows(mid) < low[live]
            a[live[less]] = mid[less] + 1
            b[live[~less]] = mid[~less]
            live = live[a[live] < b[live]]
        hit = np.flatnonzero(a < end)
        hit = hit[self._lows(a[hit]) == low[hit]]
        out[q[hit]] = a[hit]
        return out
