"""The pipeline against plain Python, stage by stage, on the smallest tables."""

import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from quantloom.llm import gam
from quantloom.llm.vocabularies import tokenizer_file
from test_fmindex import brute as brute_hits
from test_fmindex import words
from test_mixing import brute as brute_mix
from test_simhash import brute as brute_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    # A copy, an empty text and rows that repeat an id must pass through every stage.
    more = docs.limit(2).withColumn("doc_id", F.col("doc_id") + 100_000).unionByName(docs.limit(1))
    docs = docs.unionByName(more).cache()
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_names_and_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    for s in stages[1:-1]:
        assert s.columns == stages[0].columns


def test_quality(spark, stages):
    model = gam.fit(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    rows = stages[0].collect()
    score = model.score(np.array([gam.text_numbers((r.text or "").encode()) for r in rows]))
    assert sorted(stages[1].collect(), key=repr) == sorted((r for r, s in zip(rows, score, strict=True) if s >= 0.3), key=repr)
    assert stages[1].count() > 80


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    low = {c for _, _, c in brute_groups(rows)}
    assert sorted(str(r.doc_id) for r in stages[2].collect()) == sorted(low)
    assert stages[2].count() < stages[1].count()


def test_benchmark_words_go(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = stages[2].select("doc_id", "text").collect()
    after = {r.doc_id: r.text for r in stages[3].collect()}
    for r, (_, n, hit, _) in zip(rows, brute_hits([tuple(r) for r in rows], items), strict=True):
        if n and len(hit) == n:
            assert r.doc_id not in after
        elif not hit:
            assert after[r.doc_id] == r.text
        else:
            gone = set(hit)
            assert words(after[r.doc_id]) == [w for k, w in enumerate(words(r.text)) if k not in gone]


def test_mix(stages):
    rows = [(r.doc_id, r.source, r.text) for r in stages[3].collect()]
    size, _, _, taken = brute_mix(rows)
    want = {i: t // n for (i, _, _), n, t in zip(rows, size, taken, strict=True) if t}
    got = {r.doc_id: r["count"] for r in stages[4].groupBy("doc_id").count().collect()}
    assert got == want


def test_tokens(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    rows = sorted(((r.doc_id, r.text or "") for r in stages[4].collect()))
    want, start = [], 0
    for i, text in rows:
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, stages[5].collect()), key=lambda r: r[1]) == want


CLASHES = [
    "__size", "__rank", "__time", "__place", "__tie", "__passes", "__done", "__start", "__target", "__bucket", "__source", "__id", "__nth", "__quality", "__own_n_words",
    "quality_score", "n_words", "hit_spans", "hit_items", "own_n_words", "row", "time", "nth", "id", "tie", "own_id", "own_tie", "fp", "low", "root", "score", "size", "slice",
]


@pytest.fixture(scope="module")
def clashing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string"))).unionByName(docs.limit(1).withColumn("text", F.lit("")))
    docs = docs.unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.limit(2).withColumn("source", F.lit(None).cast("string")))
    docs = docs.unionByName(docs.limit(1).selectExpr("doc_id + 500000 as doc_id", "repeat(text || ' ', 3000) as text", "lang", "source", "n_chars"))
    more = {c: F.concat(F.lit(f"{c} "), F.col("lang")) for c in CLASHES}
    return docs.withColumns({**more, "m": F.create_map(F.lit("k"), F.col("lang")), "a": F.array(F.struct(F.col("n_chars").alias("x")))}).cache()


@pytest.mark.parametrize("k", range(4))
def test_clashing_columns_stay_as_they_are(spark, clashing, k):
    """Names that the stages use themselves, maps, null ids, null and empty texts and a very long one."""
    out = corpus_pipeline.STAGES[k][1](spark, clashing, SF)
    assert out.columns == clashing.columns
    rows = out.collect()
    assert rows
    for r in rows:
        assert all(r[c] == f"{c} {r['lang']}" for c in CLASHES) and r["m"] == {"k": r["lang"]} and len(r["a"]) == 1


def test_last_stage_with_clashing_columns(spark, clashing):
    out = corpus_pipeline.STAGES[4][1](spark, clashing, SF).collect()
    assert len(out) == clashing.count() and sum(r.doc_id is None for r in out) == 2


@pytest.mark.parametrize("k", range(5))
def test_empty_table(spark, k):
    """Each stage gives an empty result for one, with the same columns but for the last."""
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    out = corpus_pipeline.STAGES[k][1](spark, none, SF)
    assert out.count() == 0
    assert k == 4 or out.columns == none.columns


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 100
