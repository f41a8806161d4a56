import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from quantloom.llm import decisionlist, gam, queries

TEXTS = [
    None, "", "   \n ", "one", "a b c d e f g h", "a b c d e f g h " * 2, "x y\nx y\n\n\nx y \nx y", "été *** $$ | <b> A!B!!", "w " * 40,
    "a b c d e f g h i j k a b c d e f g h q r a b c d e f g h i j", "\x0bq\x0c\r\n z", "same same same line\n" * 30,
]


def counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    again = {k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_statistics_against_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "'q' as n_words")
    got = {r.doc_id: r for r in decisionlist.judge(docs, []).collect()}
    for i, text in enumerate(TEXTS):
        r = got[i]
        want = counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r.kept == (not r.base_failed)


def corpus(spark, n=600):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        w = list(rng.choice(words, int(rng.integers(30, 90))))
        bad = i % 5 == 0
        if bad:
            w = [x + "!!" for x in w] if i % 2 else [x.upper() + "$" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, 0 if bad else 1))
    labels += [(None, 1), (5, None), (10_000, 1), (0, 0)]
    docs = spark.createDataFrame([*rows, (None, None), (9000, "")], "doc_id long, text string").selectExpr("*", "1 as quality")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int")


def test_learned_rules_find_the_bad_rows(spark):
    docs, labels = corpus(spark)
    rules = decisionlist.fit(docs, labels)
    assert rules and rules == decisionlist.fit(docs, labels)
    got = {r.doc_id: r.kept for r in decisionlist.judge(docs, rules).collect()}
    assert all(got[i] == (i % 5 != 0) for i in range(600))
    assert got[None] is False and got[9000] is False


def first_rule(rules, stats):
    """The first rule whose conditions all hold, from 1, or 0, in plain Python."""
    rate = lambda a, b: stats[a] / stats[b] if stats[b] else 0.0
    x = {
        "words": stats["n_words"], "word_length": rate("word_chars", "n_words"), "symbol_rate": rate("n_symbols", "n_words"), "dup_line_rate": rate("n_dup_lines", "n_lines"),
        "repeat_rate": rate("n_repeat_words", "n_words"), "same_as_last_rate": rate("n_same_as_last", "n_words"), "capital_rate": rate("n_capitals", "word_chars"), "bang_rate": rate("n_bangs", "n_words"),
    }
    for k, rule in enumerate(rules, 1):
        if all((x[c.feature] > c.threshold) == c.above for c in rule):
            return k
    return 0


def test_rules_of_the_given_labels(spark):
    """At the scale of the correctness check, rules are learned, find the bad rows that pass the base and spare the good."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rules = decisionlist.fit(docs, labels)
    assert rules
    judged = {r.doc_id: r for r in decisionlist.judge(docs, rules).collect()}
    for r in judged.values():
        assert r.rule == first_rule(rules, r.asDict())
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and not r.rule)
    quality = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in judged}
    bad = [i for i, q in quality.items() if q == 0 and not judged[i].base_failed]
    good = [i for i, q in quality.items() if q == 1 and not judged[i].base_failed]
    assert sum(not judged[i].kept for i in bad) >= 0.9 * len(bad)
    assert sum(judged[i].kept for i in good) >= 0.99 * len(good)


def test_a_first_condition_that_fails_is_set_aside():
    """The condition that gains most covers good rows that no other tells apart; a pure one comes next."""
    rows = [((1, 0), 39, 3), ((0, 1), 12, 0), ((0, 0), 0, 300)]
    bins, bad, good = np.array([r[0] for r in rows]), np.array([float(r[1]) for r in rows]), np.array([float(r[2]) for r in rows])
    learn = lambda **more: decisionlist.learn_rules(bins, [1, 1], bad, good, np.zeros(3, bool), **more)
    assert learn() == [[(1, True, 0)]]
    assert learn(purity=0.9) == [[(0, True, 0)], [(1, True, 0)]]
    assert learn(least_bad=60) == []


def test_a_rule_grows_until_it_is_pure():
    rows = [((1, 0), 39, 3), ((1, 1), 20, 0), ((0, 0), 0, 300)]
    bins, bad, good = np.array([r[0] for r in rows]), np.array([float(r[1]) for r in rows]), np.array([float(r[2]) for r in rows])
    assert decisionlist.learn_rules(bins, [1, 1], bad, good, np.zeros(3, bool)) == [[(0, True, 0), (1, True, 0)]]


def test_repeated_rows_tied_labels_and_long_texts(spark):
    docs, labels = corpus(spark, 200)
    both = labels.unionByName(labels.where("doc_id < 40").selectExpr("doc_id", "1 - quality as quality"))
    long = "word and other things " * 200_000
    more = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(7777, long)], "doc_id long, text string").selectExpr("*", "1 as quality"))
    rules = decisionlist.fit(more, both)
    judged = {r.doc_id: r for r in decisionlist.judge(more, rules).collect()}
    assert judged[7777].n_words == 800_000 and judged[7777].base_failed
    model = gam.fit(more, both)
    assert gam.score_documents(more, model).count() == 206


def test_without_labels_no_rule_is_learned(spark):
    docs, labels = corpus(spark, 20)
    assert decisionlist.fit(docs, labels.limit(0)) == []
    assert decisionlist.judge(docs.limit(0), []).count() == 0


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    model = gam.fit(docs, labels)
    scored = gam.score_documents(docs, model).withColumn("out", gam.held_out(F.col("doc_id"))).collect()
    assert len(scored) == 602 and all(0 <= r.score <= 1 for r in scored)
    out = [r for r in scored if r.out and r.doc_id < 600]
    assert len(out) > 80 and all((r.score >= 0.3) == (r.doc_id % 5 != 0) for r in out)
    again = gam.score_documents(docs, gam.fit(docs, labels)).collect()
    assert sorted((str(r.doc_id), r.score) for r in again) == sorted((str(r.doc_id), r.score) for r in scored)


def plain_score(model, x):
    total = model.base
    at = [sum(e < v for e in edges) for edges, v in zip(model.edges, x, strict=False)]
    for f, table in enumerate(model.tables):
        total += table[at[f]]
    for (f, g), table in model.pairs.items():
        total += table[at[f]][at[g]]
    return 1 / (1 + math.exp(-max(-30, min(30, total))))


def test_query_against_plain_python(spark):
    """op8 on the given tables: scores added up one by one, held-out rows by zlib, and their ranking."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in queries.op8_quality_classifier(spark, sf).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    model = gam.fit(docs, labels)
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert r.score == pytest.approx(plain_score(model, gam.text_numbers(texts[i])), abs=1e-12)
        assert r.predicted == int(r.score >= 0.3)
    out = [(got[r.doc_id].score, r.quality) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out]
    good, bad = [s for s, q in out if q == 1], [s for s, q in out if q == 0]
    assert len(good) > 30 and len(bad) > 5
    assert sum(g > b for g in good for b in bad) >= 0.98 * len(good) * len(bad)
    assert sum((s >= 0.3) == q for s, q in out) >= 0.95 * len(out)


def test_pairs_learn_what_single_tables_cannot():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (4000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = gam.fit_model(x[:3000], y[:3000], rounds=20, pairs=1)
    assert list(model.pairs) == [(0, 1)]
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)]])
def test_constant_without_both_kinds(spark, labels):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    model = gam.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert len({r.score for r in gam.score_documents(docs, model).collect()}) == 1
    assert gam.score_documents(docs.limit(0), model).count() == 0
    clash = gam.score_documents(docs.selectExpr("*", "'x' as score"), model)
    assert clash.columns == ["doc_id", "text", "score"] and dict(clash.dtypes)["score"] == "double"
