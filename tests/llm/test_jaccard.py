"""Groups of the pipeline's stage against a plain comparison of all pairs."""

import corpus_pipeline
import numpy as np
from quantloom.llm import jaccard, simhash

SF = "/root/testdata/sf0.001"


def similar(a, b):
    x, y = (set(zip(*[t.lower().split()[i:] for i in range(5)], strict=False)) for t in (a, b))
    return len(x & y) >= 0.8 * len(x | y)


def test_near_copies_beyond_three_bits_go(spark):
    rng = np.random.default_rng(1)
    base = [[f"w{k}" for k in rng.integers(0, 5000, 120)] for _ in range(8)]
    rows = []
    for i, w in enumerate(base):
        for j in range(4):
            # Two changed words cost at most 10 of 116 shingles; eight spread ones cost far more.
            v = list(w)
            for at in ([], [40, 80], [41, 81], range(5, 120, 15))[j]:
                v[at] = f"x{i}_{j}"
            rows.append((10 * i + j, " ".join(v)))
    fps = [simhash.fingerprint(t.encode()) for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if similar(rows[a][1], rows[b][1])]
    assert any((fps[a] ^ fps[b]).bit_count() > 3 for a, b in pairs)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert kept == sorted(10 * i + j for i in range(8) for j in (0, 3))


def test_given_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    fps = [simhash.fingerprint(t.encode()) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if (fps[a] ^ fps[b]).bit_count() <= 3 or (len(x.split()) >= 5 and len(y.split()) >= 5 and similar(x, y)):
                lo, hi = sorted((root(a), root(b)))
                group[hi] = lo
    want = sorted({rows[root(i)][0] for i in range(len(rows))})
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == want


def test_stars_compare_exactly():
    sets = [np.arange(0, 100), np.arange(0, 80), np.arange(0, 79), np.arange(200, 300), np.arange(20, 100)]
    assert sorted(jaccard.set_stars([s.astype(np.uint64) for s in sets], 0.8)) == [(0, 1), (0, 2), (0, 4)]
