"""The pipeline stage by stage against plain versions of what each stage must have done."""

import corpus_pipeline

import pytest

from linkatlas.llm import simhash
from linkatlas.llm.common import kept
from test_operators import brute_left, docs_of


SF = "/root/testdata/sf0.01"


def groups_by_hand(texts):
    """The least id of each group linked by fingerprints within two bits, all pairs looked at."""
    fp = {i: simhash.fingerprint((t or "").encode(), 3) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids[: ids.index(a)]:
            if (fp[a] ^ fp[b]).bit_count() <= 2:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {find(i) for i in ids}


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows(spark, empty):
    sf = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    clean = "Some words that nobody else has written here at all, and which hold no question of any kind."
    other = "An entirely different text about ships and harbours, with its own words from beginning to end."
    long = " ".join(f"w{i % 977}x{i // 977}" for i in range(100_000))
    rows = [(None, clean), (None, item), (1, other), (1, item), (2, None), (3, ""), (4, "x"), (4, "x"), (None, "x"), (5, long)]
    docs = docs_of(spark, rows, extra=True)
    docs = docs.limit(0) if empty else docs
    out = {name: stage(spark, docs, sf) for name, stage in corpus_pipeline.STAGES}
    for name, df in out.items():
        assert name == "source_mixing" or df.columns == docs.columns
    got = {name: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr) for name, df in out.items() if name != "source_mixing"}
    of = lambda keep: [] if empty else sorted(keep, key=repr)
    assert got["toxicity"] == of(rows)
    assert got["simhash_near_dedup"] == of([(None, clean), (1, other), (1, item), (2, None), (4, "x"), (5, long)])
    assert got["suffix_array_dedup"] == of(rows) or len(item) >= corpus_pipeline.PASSAGE
    assert got["benchmark_decontamination"] == of([r for r in rows if r[1] != item])
    assert out["source_mixing"].count() == (0 if empty else len(rows))


def test_stages(spark):
    import duckdb

    duck = duckdb.connect()
    for t in ("labels", "benchmark"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()} if "text" in docs.columns else {}
        docs = kept(stage(spark, docs, SF), name)
        after = docs.collect()
        ids = {r.doc_id for r in after}
        assert len(ids) == len(after) and ids <= set(before)
        seen.append(len(after))
        if name != "source_mixing":
            assert docs.columns == columns
        if name == "toxicity":
            toxic = {i for i, in duck.sql("select doc_id from labels where toxic = 1").fetchall()}
            clean = {i for i, in duck.sql("select doc_id from labels where toxic = 0").fetchall()}
            assert len(toxic & ids) < 0.4 * len(toxic) and len(clean & ids) > 0.95 * len(clean)
        if name == "simhash_near_dedup":
            assert ids == groups_by_hand(before)
        if name == "suffix_array_dedup":
            want = {i: w[3] for i, w in zip(before, brute_left([(t or "").encode() for t in before.values()], corpus_pipeline.PASSAGE))}
            cut = {r.doc_id: r.text for r in after}
            assert ids == set(before)
            assert all((cut[i] or "") == want[i].decode("utf-8", "ignore") for i in ids)
            # No 51 words in a row are left in two documents.
            seen_in = {}
            for i, t in cut.items():
                w = (t or "").split()
                for k in range(len(w) - 50):
                    seen_in.setdefault(hash(tuple(w[k : k + 51])), set()).add(i)
            assert max(map(len, seen_in.values())) == 1
        if name == "benchmark_decontamination":
            items = [" ".join(t.lower().split()) for t, in duck.sql("select text from benchmark").fetchall()]
            whole = {i for i, t in before.items() if any(x in " ".join((t or "").lower().split()) for x in items)}
            assert not whole & ids
        if name == "source_mixing":
            assert all(r.rate >= 0 for r in after) and ids == set(before)
    assert corpus_pipeline.run(spark, SF).count() == seen[-1]
