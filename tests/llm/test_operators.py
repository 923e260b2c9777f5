"""Each operator on small odd tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import SF, same_rows
from pyspark.sql import functions as F

from linkatlas.llm import decontam, embed, langid, license, merkle, mixing, ngram, queries, simhash, suffix, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, extra=False):
    df = spark.createDataFrame([(*r, *(None,) * (5 - len(r))) for r in rows], DOCS)
    if extra:
        for c in ("fp", "h", "key", "row", "n", "score", "tid", "marks", "raw", "item_id", "pos", "cid", "license", "path_", "p", "held", "id", "of", "copies", "th", "component", "rate", "target"):
            df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def words():
    rng = random.Random(9)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]


def odd_rows(words):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = text(90)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One two"), (None, text(50)), (6, text(3000)), (7, shared), (8, f"{text(20)} {shared} {text(20)}"), (9, shared), (9, shared), (10, "x" * 2000), (11, "é" * 500), (12, text(60) + " " + shared[:200])]
    return rows + [(20 + i, text(30)) for i in range(6)]


def components_of(fps, bits):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in fps:
        for b in fps:
            if bin(a ^ b).count("1") <= bits:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("cap", [simhash.LIST_CAP, 1])
def test_simhash(spark, words, cap, monkeypatch):
    rows = odd_rows(words)
    base = " ".join(words[:200])
    rows += [(100 + i, base + f" {words[i]}") for i in range(25)]
    got = simhash.simhash_groups(docs_of(spark, rows, extra=True)).collect()
    fp = [simhash.fingerprint((t or "").encode(), 3) for _, t in rows]
    comp = components_of(set(fp), 2)
    least = {}
    for (i, _), f in zip(rows, fp):
        if i is not None:
            least[comp[f]] = min(least.get(comp[f], i), i)
    want = Counter((i, f"{f:016x}", least.get(comp[f])) for (i, _), f in zip(rows, fp))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    links = simhash.links(spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in set(fp)], "fp long"), cap).collect()
    assert all(bin((r.u ^ r.v) & ((1 << 64) - 1)).count("1") <= 2 for r in links)
    assert simhash.simhash_groups(docs_of(spark, [])).count() == 0


def test_simhash_long_lists_lose_nothing(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    fps = {centre} | {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    from linkatlas.llm.common import components

    want = components_of(fps, 2)
    for cap in (4, 10_000):
        got = {r.node & ((1 << 64) - 1): r.root for r in components(simhash.links(df, cap)).collect()}
        for a in fps:
            for b in fps:
                if a < b:
                    assert (a in got and b in got and got[a] == got[b]) == (want[a] == want[b])


def brute_strip(texts, length):
    return [(n, gone, spans, hashlib.sha256(left).hexdigest()) for n, gone, spans, left in brute_left(texts, length)]


def brute_left(texts, length):
    key = lambda t, i: xxhash.xxh3_128_intdigest(t[i : i + length])
    count = Counter(key(t, i) for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[key(t, i)] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        left = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), spans, left))
    return out


@pytest.mark.parametrize("cap", [suffix.GROUP_CAP, 1])
def test_suffix(spark, words, cap, monkeypatch):
    monkeypatch.setattr(suffix, "GROUP_CAP", cap)
    rows = odd_rows(words) + [(50, "line of text. " * 200), (51, "ab" * 400), (51, "ba" * 300)]
    got = suffix.strip_repeats(docs_of(spark, rows, extra=True), 80 * 5).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = Counter((i, *w) for (i, _), w in zip(rows, brute_strip([(t or "").encode() for _, t in rows], 400)))
    assert Counter(tuple(r) for r in got) == want
    if cap > 1:
        assert suffix.strip_repeats(docs_of(spark, [])).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(20, 16))
    x = [(base[i % 20] + rng.normal(size=16) * (0.02 if i < 60 else 0.5)).tolist() for i in range(90)]
    rows = [(i, v) for i, v in enumerate(x)] + [(200, x[0]), (201, x[0]), (202, [2 * c for c in x[0]]), (203, None), (204, []), (205, [0.0] * 16), (206, [None] * 16), (207, [math.nan] * 16), (208, [math.inf] * 16), (209, x[0][:8]), (210, x[5]), (210, x[5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as n", "2 as cid", "3 as t", "4 as key")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed.vector_links(df).collect())
    ok = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v in rows]
    n = len(rows)
    unit = [np.array(v) / np.linalg.norm(v) if k else None for (_, v), k in zip(rows, ok)]
    link = [[i != j and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.95 for j in range(n)] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        root = [min([root[i]] + [root[j] for j in range(n) if link[i][j]]) for i in range(n)]
    least = {r: min(rows[i][0] for i in range(n) if root[i] == r) for r in root}
    want = Counter((rows[i][0], sum(link[i]), least[root[i]], rows[i][0] == least[root[i]]) for i in range(n))
    assert got == want
    assert embed.vector_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_ngram(spark, words, monkeypatch):
    rows = odd_rows(words)
    df = docs_of(spark, rows, extra=True)
    model = ngram.train(df.where("doc_id is null or doc_id < 20"))
    got = ngram.scores(df, model).collect()
    tokens = [[*(t or "").encode().lower().split(), b""] for _, t in rows]
    one, two = Counter(), Counter()
    for (i, _), w in zip(rows, tokens):
        if i is None or i < 20:
            one.update(w)
            two.update(zip([b"", *w[:-1]], w))
    n, v = sum(one.values()), len(one)
    assert (model["N"], model["V"]) == (n, v)
    p1 = lambda w: (one[w] + 1) / (n + v + 1)
    want = Counter()
    for (i, _), w in zip(rows, tokens):
        base = sum(math.log10(p1(x)) for x in w)
        score = sum(math.log10((two[a, x] + ngram.MU * p1(x)) / (one[a] + ngram.MU)) if one[a] else math.log10(p1(x)) for a, x in zip([b"", *w[:-1]], w))
        want[(i, len(w), sum(one[x] > 0 for x in w), round(base, 6), round(score / len(w), 3))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score / r.n_tokens, 3)) for r in got) == want
    monkeypatch.setattr(ngram, "PAIRS_AT_ONCE", 3)
    assert ngram.scores(df, model).collect() == got
    empty = ngram.train(docs_of(spark, []))
    assert [(r.n_tokens, r.n_known, r.score) for r in ngram.scores(docs_of(spark, [(1, None)]), empty).collect()] == [(1, 0, 0.0)]
    assert ngram.scores(docs_of(spark, []), model).count() == 0


def test_toxicity(spark, words):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        t = [rng.choice(words) for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            for _ in range(5):
                t[rng.randrange(40)] = rng.choice(["zzfoul", "zzrude"])
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    odd = [(900, None), (901, ""), (902, "123 !!"), (None, "zzfoul zzrude zzfoul zzrude"), (903, rows[0][1]), (903, rows[0][1])]
    df = docs_of(spark, rows + odd, extra=True)
    told = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    out = toxicity.toxic_passages(df, toxicity.fit(df, told)).selectExpr("row.doc_id", "score", "passages", "n_tokens").collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows) + len(odd)
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(by[i].score >= 0.5) == (i % 4 == 0) for i in held]) > 0.95
    assert by[900].passages == [] and by[901].score == by[902].score < 0.5 and by[None].score >= 0.5
    assert any(s.first <= rows[0][1].split().index(w) < s.end for w in ("zzfoul", "zzrude") if w in rows[0][1] for s in by[0].passages)
    assert toxicity.toxic_passages(docs_of(spark, []), toxicity.fit(docs_of(spark, []), told.limit(0))).count() == 0


def test_language(spark):
    rng = random.Random(3)
    syl = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["ßen", "über", "sch", "ung"], "gr": ["λο", "γο", "ς", "και"]}
    text = lambda lang, n: " ".join("".join(rng.choice(syl[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, text(lang, 30), lang) for i in range(240) for lang in [sorted(syl)[i % 3]]]
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "12 !?", None), (903, text("aa", 20) + ". " + text("bb", 40), None), (None, text("gr", 5), None)]
    df = docs_of(spark, rows + odd, extra=True)
    out = {r.doc_id: r for r in langid.spans(df, langid.fit(df)).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang in rows)
    assert [out[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and out[900].score == 0 and out[902].spans == []
    assert [(s.first, s.end, s.lang) for s in out[903].spans] == [(0, 20, "aa"), (20, 60, "bb")] and out[903].lang_pred == "bb"
    assert out[None].lang_pred == "gr" and out[None].score == 1.0
    nothing = langid.fit(docs_of(spark, []))
    assert nothing is None and langid.spans(docs_of(spark, rows[:2]), nothing).first().lang_pred == "und"


def test_decontamination(spark):
    question = "If Tom has 12 apples and buys 30 kg of pears then how many pieces of fruit does Tom carry home today"
    changed = "Well then. If Ann has 17 apples and buys 45 kg of pears then how many pieces of fruit does Ann carry home today ok"
    torn = "Well then. If Ann has 17 apples and buys 45 kg of pears then how many pieces of fruit does Bob carry home today ok"
    bench = spark.createDataFrame([(1, question), (2, None), (3, "too short"), (4, "a plain item with words that are only here and nowhere else at all")], "item_id long, text string")
    rows = [(1, question), (2, changed), (3, torn), (4, None), (5, ""), (6, "nothing of the kind is in this text at all, whatever one says"), (None, "so a plain item with words that are only here and nowhere else at all"), (7, "x " * 5000), (8, question), (8, question)]
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks(docs_of(spark, rows, extra=True), bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (None, 4), (8, 1)}
    assert got[1, 1].changed == 0 and got[1, 1].share == 1.0 and got[2, 1].changed >= 3
    assert decontam.leaks(docs_of(spark, []), bench).count() == 0 == decontam.leaks(docs_of(spark, rows), bench.limit(0)).count()


def test_licenses(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, "a/LICENSE", f"Title\n{mit}\n"), (2, "a/x.txt", "text"), (3, "a/b/y.txt", None), (4, "a/b/z.txt", f"code\n{gpl}"), (5, "c/w.txt", ""), (6, None, mit), (7, "a/b/c/COPYING.txt", gpl), (8, "a/b/c/d/q", "the license of this"), (8, "a/b/c/d/q", "the license of this"), (9, "ab/r", "no")]
    df = spark.createDataFrame(rows, "id long, path string, text string").selectExpr("*", "1 as license", "2 as dir", "3 as th", "4 as line")
    got = Counter((r.id, r.license, r.found) for r in license.license_scan(df).collect())
    assert got == Counter([(1, "MIT", "header"), (2, "MIT", "directory"), (3, "MIT", "directory"), (4, "GPL-3.0", "header"), (5, None, None), (6, "MIT", "header"), (7, "GPL-3.0", "header"), (8, "GPL-3.0", "directory"), (8, "GPL-3.0", "directory"), (9, None, None)])
    assert license.license_scan(df.limit(0)).count() == 0


def test_every_unit_at_the_threshold(spark):
    """Units that reach it by one term, or by common words alone, against scoring every unit there is."""
    common = "to be and in or source use forms with without that are provided the following are met"
    texts = ["MIT", "x\nISC\ny", "Released. Other words here", common, "the terms of this source code form subject to", "all of it is in the way", "mit mit mit und auch", "Apache", "nothing", "the the the of of", "any person to be found in a file of source", ""]
    df = spark.createDataFrame([(i, f"d{i}/f", t) for i, t in enumerate(texts)], "id long, path string, text string")
    units = [(i, u) for i, t in enumerate(texts) for u in {*t.split("\n"), *re.sub(r"([.!?;]) +", r"\1\n", t).split("\n")}]
    best = {r.line: (-r.cosine, r.license) for r in license.line_licenses(spark.createDataFrame(units, "id long, line string")).collect()}
    want = {i: min((best[u] for j, u in units if j == i and u in best), default=(None, None))[1] for i in range(len(texts))}
    assert {r.id: r.license for r in license.license_scan(df).collect()} == want
    assert want[0] == "MIT" and want[1] == "ISC" and want[3] == "BSD-3-Clause" and want[8] is None


def test_merkle(spark, monkeypatch):
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * (i % 5)) for i in range(700)] + [(None, None, None), (3, "u", "v"), (3, "u", "v"), (5, "u", "other"), (6, "u", "long " * 100_000)]
    for most in (merkle.MOST, 10):
        monkeypatch.setattr(merkle, "MOST", most)
        a = merkle.written(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as file", "2 as seq", "3 as hash"))
        a = a.selectExpr("*", "1 as file", "2 as seq", "3 as hash", "4 as ok", "5 as bad")
        assert merkle.audit_report(a, a).where("not ok").count() == 0
        b = a.withColumn("html", F.when(F.col("page_id").isin(17, 300, 699), F.concat(F.lit("!"), F.expr("substring(html, 2)"))).otherwise(F.col("html")))
        report = merkle.audit_report(a, b).collect()
        assert len(report) == len(rows) and {r.page_id for r in report if not r.ok} == {17, 699, 300}
        by_file = {}
        for r in sorted(report, key=lambda r: (r.file, r.seq)):
            assert r.offset == by_file.get(r.file, 0)
            by_file[r.file] = r.offset + r.length
    lost = a.where("page_id is null or page_id not in (3, 400)")
    assert Counter(r.page_id for r in merkle.audit_report(a, lost).where("not ok").collect()) == {3: 3, 400: 1}
    assert merkle.audit_report(a.limit(0), b.limit(0)).count() == 0
    with pytest.raises(ValueError):
        merkle.leaves(spark.createDataFrame(rows, "page_id long, url string, html string"))


def test_mixing(spark, words):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        low = i % 3 == 0
        rows.append((i, " ".join(rng.choice(words[:200] if low else words[200:]) for _ in range(20 + i % 30)), "aa"))
    odd = [(900, None, None), (901, "", "aa"), (None, words[0], None), (902, rows[0][1], "aa"), (902, rows[0][1], "aa")]
    df = docs_of(spark, rows + odd, extra=True)
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(0, 300, 2)] + [(None, 1), (7, None)], "doc_id long, quality int")
    out = mixing.mix(df, labels, {"aa/0": 3000.0, "aa/1": 2000.0}).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows) + len(odd) and all(by[i].domain == f"aa/{int(i % 3 != 0)}" for i, _, _ in rows)
    assert all(r.rate >= 0 and r.met for r in out) and by[900].n_tokens == 0
    # Each domain's expected tokens, from the posteriors and the rates that came out.
    model = mixing.fit(df, labels)
    members = {r.doc_id: r for r in mixing.memberships(df, model).collect()}
    totals = sum(by_rate * m.n_tokens * np.array(m.p) for by_rate, m in ((r.rate, members[r.doc_id]) for r in out))
    assert np.allclose(totals, [3000, 2000], atol=1) and np.allclose([by[0].target, by[1].target], [3000, 2000]) and np.allclose([by[0].reached, by[1].reached], totals, atol=1)
    # A text as long as all others.
    long = mixing.mix(docs_of(spark, [*rows, (901, " ".join(words) * 300, None)]), labels).collect()
    assert max(r.n_tokens for r in long) > 100_000 and all(math.isfinite(r.rate) for r in long)
    assert mixing.mix(docs_of(spark, []), labels).count() == 0
    assert {r.domain for r in mixing.mix(docs_of(spark, rows[:5]), labels.limit(0)).collect()} == {"all"}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, SF), duck.sql(queries.SQL[name]))


@pytest.mark.parametrize("name", ["op5_toxicity", "op6_language"])
def test_held_out(spark, duck, name):
    rows = {r.doc_id: r for r in queries.QUERIES[name](spark, "/root/testdata/sf0.01").collect()}
    assert len(rows) == 1000
    sql = "select doc_id, toxic from '/root/testdata/sf0.01/labels.parquet'" if name == "op5_toxicity" else "select doc_id, lang from '/root/testdata/sf0.01/documents.parquet'"
    truth = [(rows[i], y) for i, y in duck.sql(sql).fetchall() if rows[i].held_out]
    assert np.mean([(r.predicted if name == "op5_toxicity" else r.lang_pred) == y for r, y in truth]) > 0.9
