"""Kernels against plain versions of themselves."""

import itertools
import random
import time

import numpy as np
import pyarrow as pa
import xxhash

from linkatlas.llm import elias, embed, langid, mixing, ngram, simhash, suffix, toxicity


def test_fingerprint():
    def plain(text, k):
        w = text.lower().split()
        if not w:
            return 0
        n = max(1, len(w) - k + 1)
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), seed=42) for i in range(n)]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > n)

    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50):
        t = " \t".join(rng.choice(["A", "bc", "É", "x\x0by", "zz"]) for _ in range(n)).encode()
        assert simhash.fingerprint(t, 3) == plain(t, 3)


def test_repeated_windows():
    rng = random.Random(3)
    for _ in range(150):
        length, letters = 16, rng.choice([b"ab", b"abc\x00", bytes(range(250, 256)) + b"\x00a"])
        pool = bytes(rng.choice(letters) for _ in range(60))
        contexts = []
        for _ in range(rng.randint(1, 8)):
            a = rng.randint(0, 40)
            contexts.append(pool[a : a + rng.randint(5, 20)] + bytes(rng.choice(letters) for _ in range(rng.randint(16, 30))))
        count = {}
        for c in contexts:
            for i in range(len(c) - length + 1):
                count[c[i : i + length]] = count.get(c[i : i + length], 0) + 1
        want = [[count[c[i : i + length]] > 1 for i in range(len(c) - length + 1)] for c in contexts]
        assert [x.tolist() for x in suffix.repeated(contexts, length)] == want


def test_runs_cover_each_window_once():
    rng = np.random.default_rng(2)
    text = bytes(rng.integers(97, 100, 5000, dtype=np.uint8))
    fp, first, n, off = suffix.runs(text)
    assert first[0] == 0 and (first[1:] == (first + n)[:-1]).all() and first[-1] + n[-1] == 4601
    h = suffix.gram_hashes(np.frombuffer(text, np.uint8)).view(np.int64)
    assert (h[first + off] == fp).all() and (off >= n - 1).all() and (off + suffix.GRAM <= 400).all()
    assert len(suffix.runs(b"x" * 399)[0]) == 0


def test_segments():
    def plain(s):
        """All maximal segments by the recursive definition."""
        best, at = 0, None
        for i in range(len(s)):
            total = 0
            for j in range(i, len(s)):
                total += s[j]
                if total > best + 1e-12:
                    best, at = total, (i, j + 1)
        if at is None:
            return []
        return plain(s[: at[0]]) + [(at, best)] + [((a + at[1], b + at[1]), v) for (a, b), v in plain(s[at[1] :])]

    rng = random.Random(5)
    for _ in range(60):
        s = [rng.choice([-3, -1, 1, 2]) + rng.random() / 100 for _ in range(rng.randint(0, 14))]
        got = toxicity.segments(np.array(s))
        want = plain(s)
        assert [(a, b) for a, b, _ in got] == [x[0] for x in want]
        assert np.allclose([x[2] for x in got], [x[1] for x in want])


def test_karlin_lambda_solves_the_moment_equation():
    score, n = np.array([-0.5, 2.0]), np.array([9.0, 1.0])
    lam = toxicity.karlin_lambda(score, n)
    assert abs((0.9 * np.exp(-0.5 * lam) + 0.1 * np.exp(2 * lam)) - 1) < 1e-6
    assert toxicity.karlin_lambda(np.array([-1.0]), np.array([1.0])) == 1.0


def test_viterbi():
    rng = np.random.default_rng(4)
    for _ in range(20):
        sizes = rng.integers(0, 7, 5)
        starts = np.concatenate(([0], np.cumsum(sizes)))
        score = rng.normal(size=(starts[-1], 3)).astype(np.float32) * 3
        got = langid.viterbi(score, starts, 2.0)
        for a, z in zip(starts[:-1], starts[1:]):
            if a == z:
                continue
            value = lambda path: sum(score[a + i, k] for i, k in enumerate(path)) - 2.0 * sum(x != y for x, y in zip(path, path[1:]))  # noqa: B023, E731
            every = [[]]
            for _ in range(z - a):
                every = [p + [k] for p in every for k in range(3)]
            assert abs(value(list(got[a:z])) - max(map(value, every))) < 1e-4


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((1, 0), (5, 3), (700, 100), (1000, 10**6), (1500, 2**60)):
        v = np.sort(rng.integers(0, top + 1, n)).astype(np.uint64)
        arrays, meta = elias.EliasFano.build(v, "x")
        ef = elias.EliasFano(arrays, "x", meta)
        assert (ef.get(np.arange(n)) == v).all()
        q = np.concatenate([v, rng.integers(0, top + 5, 300).astype(np.uint64)])
        first = np.searchsorted(v, q)
        assert (ef.find(q) == np.where((first < n) & (v[np.minimum(first, n - 1)] == q), first, -1)).all()


def test_elias_file_round_trip(tmp_path):
    elias.write_file(f"file://{tmp_path}/a/x", {"p": np.arange(5, dtype=np.uint16), "q": np.array([1 << 40])}, k=3)
    arrays, meta = elias.read_file(f"file://{tmp_path}/a/x")
    assert arrays["p"].tolist() == [0, 1, 2, 3, 4] and arrays["q"].tolist() == [1 << 40] and meta == {"k": 3}


def test_cells_recall():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(600, 64))
    b = rng.normal(size=a.shape)
    ua = embed.units(a)
    b -= (b * ua).sum(1, keepdims=True) * ua
    for n in (600, 100_000):
        shape = embed.layout(n)
        for c, least in ((0.95, 0.88), (0.97, 0.97)):
            ub = embed.units(c * ua + np.sqrt(1 - c * c) * embed.units(b))
            assert (embed.cells(ua, *shape) == embed.cells(ub, *shape)).any(1).mean() > least
    assert (embed.cells(ua, *shape, some=1) == embed.cells(ua, *shape)).mean() > 0.999


def test_rates_reach_targets_and_stay_nonnegative():
    rng = np.random.default_rng(3)
    p, n = rng.dirichlet([0.3, 0.3, 0.3], 500), rng.integers(1, 200, 500)
    fit = lambda target: mixing.descend(lambda steps, off: mixing.sums(n, p, steps, off), 3, target)
    target = np.array([0.05, 1.5, 1.0]) * (n @ p)
    got = fit(target)
    r = mixing.rates_of(p, got["steps"])
    assert got["met"] and (r >= 0).all() and (r == 0).any() and np.abs(got["reached"] - target).max() < 1e-4 * target.sum()
    assert np.allclose((n * r) @ p, got["reached"])
    # Targets that no rates reach: not met, and about as near as the plain solver of nonnegative least squares comes.
    target = np.array([0.0, 1.0, 1.0]) * (n @ p)
    got = fit(target)
    plain, a = np.ones(500), n[:, None] * p
    for _ in range(20_000):
        plain = np.maximum(0, plain - a @ ((n * plain) @ p - target) / np.linalg.norm(a, 2) ** 2)
    near = lambda x: np.linalg.norm(x - target) / target.sum()
    assert not got["met"] and near(got["reached"]) < near((n * plain) @ p) + 0.05


def test_segments_of_a_million_tokens():
    s = np.where(np.arange(1_000_000) % 2 == 0, 1.0, -1.5)
    began = time.process_time()
    assert len(toxicity.segments(s)) == 500_000 and time.process_time() - began < 10


def test_long_path_is_the_same_path():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = int(rng.integers(9, 60))
        s = rng.normal(size=(n, 3)).astype(np.float32) * 3
        assert (langid.viterbi(s, np.array([0, n]), 2.0) == langid.viterbi(s, np.array([0, n]), 2.0, 8)).all()


def test_words_by_script():
    texts = ["Hello “Wörld” x2y", "한글 かな漢字カナ abc", "", None, "việt Ạ e\u0301a 12", "힣 日本語日本語語"]
    b, text, script = langid.flat(texts)
    words = b.tobytes().decode().split()
    assert words == ["hello", "wörld", "x", "y", "한글", "かな", "漢字", "カナ", "abc", "việt", "ạ", "e\u0301a", "힣", "日本語日", "本語語"]
    assert [langid.NAMES[k] for k in script] == ["latin"] * 4 + ["hangul", "kana", "han", "kana"] + ["latin"] * 4 + ["hangul", "han", "han"]
    assert text.tolist() == [0] * 4 + [1] * 5 + [4] * 3 + [5] * 3


def test_tally_alone_rejects():
    """Of 8 positions, sharing a posted set of four or five positions is not enough; six are."""
    planes = [m & (1 << 64) - 1 for m in simhash.PLANES]
    for shared in itertools.product((False, True), repeat=8):
        mask = sum(255 << 8 * p for p in range(8) if shared[p])
        tally = 0
        for m in planes:
            if m & mask == m:
                tally |= m
        n = sum((tally >> 8 * p & 255) == 255 for p in range(8))
        assert n == sum(shared) if sum(shared) >= 6 else n <= 4


def test_pair_blocks():
    rng = np.random.default_rng(2)
    for top in (10, 1 << 45):
        v, w = rng.integers(0, top, 500), rng.integers(0, top, 500)
        one, two, n, place = ngram.distinct(v, w)
        assert list(zip(one.tolist(), two.tolist())) == sorted(set(zip(v.tolist(), w.tolist()))) and n.sum() == 500
        assert (one[place] == v).all() and (two[place] == w).all()
        back = ngram.unpacked(ngram.packed(v, w, n[place]), 3)
        assert (back[0] == v).all() and (back[1] == w).all() and (back[2] == n[place]).all()


def test_chunks_of_groups():
    """A batch of many groups is sorted in chunks; no group is parted, no row lost."""
    sizes = [3, 1, 40, 2, 500, 1, 1]
    key = [k for k, n in enumerate(sizes) for _ in range(n)]
    table = pa.table({"key": key, "id": [b"%d" % i for i in range(len(key))], "context": [bytes(2000)] * len(key)})
    parts = list(suffix.chunks(table))
    assert pa.concat_tables(parts).equals(table)
    assert len(parts) == 2 and [sorted(set(p.column("key").to_pylist())) for p in parts] == [[0, 1, 2, 3, 4], [5, 6]]
    assert all(sum(map(len, p.column("context").to_pylist())) < suffix.CHUNK + 500 * 2000 for p in parts)
