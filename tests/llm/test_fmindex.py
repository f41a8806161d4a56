import random
import re

import numpy as np
from quantloom.llm import fmindex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    out = []
    for _, text in docs:
        w, hit, found = words(text), set(), set()
        for item, said in items:
            x = words(said)
            n = min(window, len(x))
            for i in range(len(x) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == x[i : i + n]:
                        hit.update(range(j, j + n))
                        if item is not None:
                            found.add(str(item))
        out.append((text, len(w), sorted(hit), sorted(found)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    alphabet = ["a", "b", "É", "ß9", "0", "Zed"]
    phrase = lambda n: " ".join(rng.choice(alphabet) for _ in range(n))
    items = [(i, phrase(rng.choice([2, 3, 5, 9, 10, 12, 30]))) for i in range(25)] + [(40, None), (41, "!!"), (42, "unseen-word"), (None, "lonely item"), (2, "a b a b a")]
    docs = [(i, ("-" if i % 2 else " , ").join(rng.choice(alphabet + ["x", "y"]) for _ in range(rng.choice([0, 1, 5, 80, 300])))) for i in range(60)]
    docs += [(90, items[5][1] + " q " + items[6][1]), (91, None), (92, ""), (92, ""), (None, "the LONELY  Item"), (93, items[24][1] * 3)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'z' as hits")
    b = spark.createDataFrame(items, "item_id long, text string")
    for size in (8 << 20, 120):
        got = fmindex.find_contamination(d, b, 10, size).collect()
        mine = [(r.text, r.n_words, [k for s in r.hit_spans for k in range(s.start, s.end)], list(r.hit_items)) for r in got]
        assert sorted(mine, key=repr) == sorted(brute(docs, items), key=repr)
    for text, n, hit, _ in brute(docs, items):
        if hit:
            spans = [(k, k + 1) for k in hit]
            a, e = fmindex._merged(*np.array(spans).T)
            left = fmindex.cut_spans(text.encode(), list(zip(a.tolist(), e.tolist(), strict=True))).decode()
            assert words(left) == [w for k, w in enumerate(words(text)) if k not in set(hit)]


def test_each_document_alone_gives_what_all_together_give():
    """A shard with fewer words than the benchmark has different ones."""
    rng = random.Random(9)
    wide = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(wide) for _ in range(30)).encode()) for i in range(40)]
    texts = [b" x ".join(rng.choice(items)[1][: rng.randint(40, 200)] for _ in range(rng.randint(0, 2))) for _ in range(40)]
    phrases = fmindex.Phrases.of(items, 10)
    whole = fmindex.search_shard(texts, phrases)
    want = [(n, hit, found) for _, n, hit, found in brute([(i, t.decode()) for i, t in enumerate(texts)], [(i, t.decode()) for i, t in items])]
    assert [(n, [k for a, b in s for k in range(a, b)], i) for n, s, i in whole] == want
    assert [fmindex.search_shard([t], phrases)[0] for t in texts] == whole
    assert any(s for _, s, _ in whole)


def test_small_blocks_and_samples_agree():
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 200))).encode() for _ in range(30)]
    phrases = fmindex.Phrases.of([(1, b"a b a"), (2, b"c c"), (3, b"b")], 10)
    whole = fmindex.search_shard(texts, phrases)
    assert whole == fmindex.search_shard(texts, phrases, sample=3, most=50)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert {(r.doc_id, r.n_words, len(r.hit_spans)) for r in fmindex.find_contamination(docs, none).collect()} == {(1, 2, 0), (2, 0, 0)}
    assert fmindex.find_contamination(docs.limit(0), none).count() == 0


def test_cutting_keeps_clean_rows_and_drops_what_is_all_benchmark(spark):
    docs = spark.createDataFrame([(1, "keep  this, as it is"), (2, "x y z"), (3, "start x y z end"), (4, None)], "doc_id long, text string").selectExpr("*", "cast(length(text) as bigint) n_chars", "'k' as hit_items")
    bench = spark.createDataFrame([(1, "X y, z")], "item_id long, text string")
    rows = fmindex.without_contamination(docs, bench).collect()
    assert {r.hit_items for r in rows} == {"k"}
    got = {(r.doc_id, r.text, r.n_chars) for r in rows}
    assert got == {(1, "keep  this, as it is", 20), (3, "start end", 9), (4, None, None)}
