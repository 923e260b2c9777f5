"""Breadth-first search of one group of nodes in memory: sources travel as bits, links are walked in slices."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa

#: Links that one row of a slice table holds; nodes with more have several rows, which are joined in a further table.
ROW = 64
#: Stands for no distance.
FAR = 1 << 29


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """From batches sorted by ``keys``, tables that each hold one group."""
    held: list[pa.RecordBatch] = []
    before = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        moved = np.zeros(b.num_rows - 1, bool)
        for c in cols:
            moved |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(moved) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[lo] for c in cols)
            if held and key != before:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            before = key
    if held:
        yield pa.Table.from_batches(held)


def slices(off: np.ndarray, src: np.ndarray) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """Tables that join the rows ``src[off[i]:off[i+1]]`` for each i: a table's k-th slice has the k-th source of its longest rows.

    Each table comes with the place of its rows in the next; the last one's places are the i that have any source.
    """
    out = []
    at = np.flatnonzero(np.diff(off))
    while True:
        count = np.diff(off)[at]
        pieces = -(-count // ROW)
        owner = np.repeat(np.arange(len(at)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, length = off[at][owner] + nth * ROW, np.minimum(count[owner] - nth * ROW, ROW)
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        longer = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")
        cut = [src[begin[:c] + k] for k, c in enumerate(longer.tolist())]
        if len(owner) == len(at):
            return [*out, (at[order], cut)]
        out.append((order, cut))
        # Rows of one node are joined next: the table's row p is piece order[p].
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        src, off = back, np.concatenate(([0], np.cumsum(pieces)))
        final, at = at, np.arange(len(at))
        rest = slices(off, src)
        return [*out, *rest[:-1], (final[rest[-1][0]], rest[-1][1])]


def joined(bits: np.ndarray, tables: list[tuple[np.ndarray, list[np.ndarray]]], rows: np.ndarray | None = None) -> np.ndarray:
    """For each row of the last table (or those in ``rows``, ascending), the union of its sources' rows of ``bits``."""
    some: list[np.ndarray | None] = [None] * len(tables)
    some[-1] = rows
    for t in range(len(tables) - 1, 0, -1):
        if some[t] is not None:
            used = np.zeros(len(tables[t - 1][0]), bool)
            for s in tables[t][1]:
                used[s[some[t][: np.searchsorted(some[t], len(s))]]] = True
            some[t - 1] = np.flatnonzero(used)
    for t, (place, cut) in enumerate(tables):
        if some[t] is not None:
            cut = [s[some[t][: np.searchsorted(some[t], len(s))]] for s in cut]
            if t:
                to = np.zeros(len(tables[t - 1][0]), np.int64)
                to[some[t - 1]] = np.arange(len(some[t - 1]))
                cut = [to[s] for s in cut]
        acc = bits.take(cut[0], axis=0) if cut else bits[:0]
        room = np.empty((len(cut[1]) if len(cut) > 1 else 0, bits.shape[1]), bits.dtype)
        for s in cut[1:]:
            if not len(s):
                break
            got = bits.take(s, axis=0, out=room[: len(s)], mode="clip")
            np.bitwise_or(acc[: len(s)], got, out=acc[: len(s)])
        bits = acc
    return bits


def column_counts(bits: np.ndarray) -> np.ndarray:
    """How many rows have each bit set: three rows are added to a sum and a carry until few are left."""
    total = np.zeros(bits.shape[1] * 64, np.int64)
    weight = 1
    while len(bits):
        carries = []
        while len(bits) >= 48:
            k = len(bits) // 3
            a, b, c = bits[:k], bits[k : 2 * k], bits[2 * k : 3 * k]
            u = a ^ b
            carries.append((a & b) | (u & c))
            bits = np.concatenate((u ^ c, bits[3 * k :]))
        total += weight * np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        bits = np.concatenate(carries) if carries else bits[:0]
        weight *= 2
    return total


class Links:
    """The links of one or more components: node i has links from ``src[off[i]:off[i+1]]``."""

    def __init__(self, off: np.ndarray, src: np.ndarray) -> None:
        n = len(off) - 1
        self.tables = slices(off, src)
        self.place = self.tables[-1][0]
        self.row = np.full(n, -1, np.int64)
        self.row[self.place] = np.arange(len(self.place))
        self.dst = np.repeat(np.arange(n, dtype=np.int32), np.diff(off))[np.argsort(src, kind="stable")]
        self.out = np.concatenate(([0], np.cumsum(np.bincount(src, minlength=n))))

    def after(self, nodes: np.ndarray) -> np.ndarray:
        """Which nodes have a link from one of ``nodes``."""
        met = np.zeros(len(self.row), bool)
        begin, size = self.out[nodes], self.out[nodes + 1] - self.out[nodes]
        if 2 * size.sum() > len(self.dst):
            met[self.place] = True
        else:
            met[self.dst[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())]] = True
        return met


def levels(links: Links, sources: np.ndarray, words: int, given: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """For each distance from 0, how many nodes each source first reaches there.

    A round looks at the nodes that have a link from the last round's and that some source has not yet reached. The last
    nodes may have their distances ``given`` (source x node); they are not counted.
    """
    n = len(links.row)
    new = np.zeros((n, words), np.uint64)
    k = np.arange(len(sources))
    np.bitwise_or.at(new, (sources, k // 64), np.uint64(1) << (k % 64).astype(np.uint64))
    full = np.bitwise_or.reduce(new[sources], axis=0)
    seen = new.copy()
    lacks = np.ones(n, bool)
    lacks[sources] = (seen[sources] != full).any(axis=1)
    last = sources
    waits = set() if given is None else set(np.unique(given).tolist())
    dist = 0
    yield np.ones(len(sources), np.int64)
    while True:
        if dist in waits:
            at = given == dist
            which = np.flatnonzero(at.any(axis=0))
            put = np.zeros((len(which), words * 8), np.uint8)
            put[:, : -(-len(sources) // 8)] = np.packbits(at[:, which].T, axis=1, bitorder="little")
            which += n - given.shape[1]
            new[which] = put.view(np.uint64)
            last = np.concatenate((last, which))
        rows = links.row[links.after(last) & lacks]
        rows.sort()
        some = rows[:0]
        if len(rows):
            got = joined(new, links.tables, rows if len(rows) < 0.9 * len(links.place) else None)
            place = links.place[rows] if len(rows) == len(got) else links.place
            before = seen.take(place, axis=0)
            got &= ~before
            some = np.flatnonzero(got.any(axis=1))
        waits.discard(dist)
        dist += 1
        if not len(some):
            if not any(d < FAR for d in waits):
                return
            yield np.zeros(len(sources), np.int64)
            new[last] = 0
            last = last[:0]
            continue
        if len(some) < len(place):
            place, got, before = place[some], got[some], before[some]
        yield column_counts(got)[: len(sources)]
        new[last] = 0
        new[place] = got
        before |= got
        seen[place] = before
        lacks[place] = (before != full).any(axis=1)
        last = place


def search_group(label: np.ndarray, node: np.ndarray, is_source: np.ndarray, links: pa.ListArray, words: int, below: int | None = None) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(sources, dist, counts): of the rows of one group, which hold a node's component and either say that it is a source or list links to it.

    Links from nodes that are neither a source nor linked to are left aside: nothing reaches them. The walk ends before the
    distance ``below``, if given.
    """
    ids, first = np.unique(node, return_index=True)
    order = np.lexsort((ids, label[first]))
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    ids_at, comp = ids[order], label[first][order]
    mine = np.flatnonzero(~is_source)
    at = rank[np.searchsorted(ids, node[mine])]
    by = np.argsort(at, kind="stable")
    rows = links.take(pa.array(mine[by]))
    flat, size = rows.flatten().to_numpy(), np.diff(rows.offsets.to_numpy())
    into = np.repeat(at[by], size)
    found = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
    known = ids[found] == flat
    src, into = rank[found[known]].astype(np.int32), into[known]
    off = np.concatenate(([0], np.cumsum(np.bincount(into, minlength=len(ids)))))
    picked = np.sort(rank[np.searchsorted(ids, np.unique(node[is_source]))])
    held = None
    begin = 0
    while begin < len(picked):
        lo = int(np.searchsorted(comp, comp[picked[begin]]))
        width = int(np.searchsorted(comp, comp[picked[begin]], side="right")) - lo
        w = max(1, min(words, (4 << 20) // width))  # four tables of this many words are held
        block = picked[begin : begin + 64 * w]
        hi = int(np.searchsorted(comp, comp[block[-1]], side="right"))
        if (lo, hi) != held:
            held = lo, hi
            here = Links(off[lo : hi + 1] - off[lo], src[off[lo] : off[hi]] - np.int32(lo))
        for dist, counts in enumerate(islice(levels(here, block - lo, w), below)):
            yield ids_at[block], dist, counts
        begin += len(block)
