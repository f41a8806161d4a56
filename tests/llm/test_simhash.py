import numpy as np
import xxhash
from quantloom.llm import simhash


def brute(rows, distance=3):
    fps = []
    for _, text in rows:
        w = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")).encode().split()
        n = max(1, len(w) - 2)
        each = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(n)] if w else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in each) > len(each)))
    comp = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= distance and comp[j] > comp[i]:
                    comp[j] = comp[i]
                    changed = True
    low = {}
    for (i, _), c in zip(rows, comp, strict=True):
        if i is not None:
            low[c] = min(low.get(c, i), i)
    return sorted(((str(r[0]), f, str(low.get(c))) for r, f, c in zip(rows, fps, comp, strict=True)))


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = [" ".join(rng.choice(["al", "be", "ga", "de", "ep", "ze", "et"], 60)) for _ in range(12)]
    rows = [(100 - i, t) for i, t in enumerate(base)]
    rows += [(200 + i, base[i % 12][: -3] + "É" * (i % 2)) for i in range(24)]
    rows += [(300, None), (301, ""), (302, "one"), (303, "ONE"), (304, "one two"), (None, base[0]), (7, base[1]), (7, base[1]), (7, base[2])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == brute(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.one_of_each(docs).count() == 0


def test_large_bucket_lookups_find_the_same_groups():
    rng = np.random.default_rng(5)
    free = (1 << 10) - 1
    fps = np.unique(rng.integers(0, 1 << 10, 300).astype(np.uint64))
    plain = simhash.bucket_stars(fps, free, 1)
    wide = np.unique(rng.integers(0, 1 << 13, 6000).astype(np.uint64))
    looked = simhash.bucket_stars(wide, (1 << 13) - 1, 1)

    def groups(n, stars):
        root = np.arange(n)
        for a, b in stars:
            root[b] = a
        return root

    def slow(values):
        root = np.arange(len(values))
        for _ in range(40):
            for bit in range(13):
                at = np.minimum(np.searchsorted(values, values ^ np.uint64(1 << bit)), len(values) - 1)
                ok = values[at] == values ^ np.uint64(1 << bit)
                low = np.where(ok, np.minimum(root, root[at]), root)
                root = low
        return root

    assert (groups(len(fps), plain) == slow(fps)).all()
    assert (groups(len(wide), looked) == slow(wide)).all()


def test_one_row_of_each_component(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(5, text, "a"), (3, text, "b"), (3, text, "b"), (9, "other words here now", None), (None, text, "c")], "doc_id long, text string, source string")
    got = sorted((r.doc_id, r.source or "") for r in simhash.one_of_each(docs).collect())
    assert got == [(3, "b"), (9, "")]
