import hashlib
import re
from functools import partial

import pytest
from quantloom.llm import mixing

ROWS = [(i, f"s{i % 7 % 4}" if i % 11 else None, " ".join(["w"] * (i * 7919 % 23))) for i in range(200)]
ROWS += [(300, "s1", None), (300, "s1", "a b"), (300, "s1", "a b"), (None, "s2", "x\x0by z"), (301, "big", "v " * 900), (302, "zero", "")]


def brute(rows, weights=(3, 1, 2), share=1.5, passes=2):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t in rows]
    sources = sorted({s for _, s, _ in rows if s is not None}) + [None] * any(s is None for _, s, _ in rows)
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[1] == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    full, target = set(), {}
    while True:
        left = share * sum(total.values()) - sum(passes * total[s] for s in full)
        rest = sum(weight[s] for s in sources if s not in full)
        over = {s for s in sources if s not in full and left * weight[s] / rest > passes * total[s]}
        if not over:
            break
        full |= over
    target = {s: passes * total[s] if s in full else left * weight[s] / rest for s in sources}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    order = sorted(range(len(rows)), key=lambda i: (md5("" if rows[i][0] is None else str(rows[i][0])), md5(rows[i][2] or "")))
    handed, done = [], dict.fromkeys(sources, 0)
    for k in range(passes):
        for i in order:
            s = rows[i][1]
            done[s] += size[i]
            if target[s]:
                handed.append((done[s] / target[s], sources.index(s), k, order.index(i), i))
    taken, before = [0] * len(rows), 0
    for *_, i in sorted(handed):
        if before < sum(target.values()):
            taken[i] += size[i]
        before += size[i]
    return size, total, target, taken


@pytest.mark.parametrize(("share", "most_rows"), [(1.5, 200_000), (0.3, 200_000), (2.0, 200_000), (1.5, 0), (0.3, 1)])
def test_against_brute_force(spark, share, most_rows, monkeypatch):
    monkeypatch.setattr(mixing, "_end_of_budget", partial(mixing._end_of_budget, most_rows=most_rows))
    docs = spark.createDataFrame(ROWS, "doc_id long, source string, text string").selectExpr("*", "1 as target")
    size, total, target, taken = brute(ROWS, share=share)
    want = sorted((str(r[0]), n, total[r[1]], round(target[r[1]], 6), t) for r, n, t in zip(ROWS, size, taken, strict=True))
    got = mixing.mixed_sizes(docs, share=share).collect()
    assert sorted((str(r.doc_id), r["size"], r.source_size, round(r.target, 6), r.taken) for r in got) == want
    mixed = mixing.mixed_documents(docs.drop("target"), share=share).collect()
    assert sum(len((r.text or "").split()) for r in mixed) == sum(taken)


def test_targets_are_met_in_order(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], "w w") for i in range(400)], "doc_id long, source string, text string")
    mixed = [r.source for r in mixing.mixed_documents(docs, weights=(3, 1), share=1.0).collect()]
    assert len(mixed) == 400 and abs(mixed.count("a") - 300) <= 1
    assert abs(mixed[:100].count("a") - 75) <= 2


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", ""), (2, None, None)], "doc_id long, source string, text string")
    assert [r.taken for r in mixing.mixed_sizes(docs).collect()] == [0, 0]
    assert mixing.mixed_sizes(docs.limit(0)).count() == 0
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
