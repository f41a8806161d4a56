import hashlib
import random

import numpy as np
import pytest
from quantloom.llm import suffixdedup as s


def brute(texts, length):
    where = {}
    data = [(t or "").encode() for t in texts]
    for k, d in enumerate(data):
        for i in range(len(d) - length + 1):
            where.setdefault(d[i : i + length], []).append((k, i))
    gone = [set() for _ in data]
    for places in where.values():
        if len(places) > 1:
            for k, i in places:
                gone[k].update(range(i, i + length))
    out = []
    for d, g in zip(data, gone, strict=True):
        runs = sum(1 for i in g if i - 1 not in g)
        out.append((len(d), len(g), runs, hashlib.sha256(bytes(b for i, b in enumerate(d) if i not in g)).hexdigest()))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    text = lambda k, chars: "".join(rng.choice(chars) for _ in range(k))
    passages = [text(rng.randint(15, 90), "abcdef é") for _ in range(8)]
    docs = []
    for _ in range(n):
        parts = [text(rng.randint(0, 60), "abcdefgh é\n") for _ in range(4)]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages)[rng.randint(0, 9) :])
        docs.append("".join(parts))
    docs += [docs[3], docs[4][: len(docs[4]) // 2] + "!" + docs[4][len(docs[4]) // 2 :], None, "", None, "ab" * 80, "ab" * 70 + "c", "z" * 100, "\0" * 50, "\0" * 51, passages[0], passages[0] * 3]
    docs += [passages[1]] * 5 + [text(300, "ab") for _ in range(5)]
    return docs


@pytest.mark.parametrize(("seed", "length", "gram"), [(1, 24, 8), (2, 40, 13), (3, 30, 30)])
def test_against_brute_force(spark, seed, length, gram, monkeypatch):
    texts = corpus(seed)
    rows = [(i if i % 9 else None, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cls int")
    got = s.repeated_bytes(docs, length, gram).collect()
    mine = sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got)
    assert mine == sorted((str(d), *b) for (d, _, _), b in zip(rows, brute(texts, length), strict=True))


def test_repeated_rows_with_one_id(spark):
    docs = spark.createDataFrame([(1, "x" * 30 + "y"), (1, "x" * 30 + "y"), (1, "q" * 5)], "doc_id long, text string")
    assert sorted(r.n_removed for r in s.repeated_bytes(docs, 20, 7).collect()) == [0, 31, 31]
    assert s.repeated_bytes(docs.limit(0), 20, 7).count() == 0


def test_pieces_of_long_texts_find_the_same_anchors(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc") for _ in range(n)).encode() for n in (5000, 100, 19, 20, 0, 3000)]

    def windows():
        doc, h, p, lo, hi = s.anchors(texts, 20, 6)
        return {(d, w): (x, a) for d, x, a, f, g in zip(doc.tolist(), h.tolist(), p.tolist(), lo.tolist(), hi.tolist(), strict=True) for w in range(f, g + 1)}

    whole = windows()
    assert len(whole) == sum(max(0, len(t) - 19) for t in texts)
    monkeypatch.setattr(s, "_PIECE", 64)
    assert windows() == whole


def test_sorting():
    rng = random.Random(7)
    texts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    order = s.multikey_order(texts, 30)
    assert sorted(order.tolist()) == list(range(3000))
    padded = [texts[i].ljust(32, b"\0") for i in order]
    assert padded == sorted(padded)
    assert np.all(s.common_prefixes(texts, order, 30) >= 0)
