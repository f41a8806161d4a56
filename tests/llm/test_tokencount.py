import pytest
from quantloom.llm import tokencount
from quantloom.llm.vocabularies import tokenizer_file

TEXTS = ["", "a", " a", "a ", "  a  b\n\n c\t\td ", "don't I'll we've 's 12ab", "x\n", "\n\n\nx", "É  ß\u00a0 \u00a0y", "\u2003 z \u2003", "<|endoftext|> a <|endoftext|>", "日本語 テキスト", "\x1c\x1d a\x85b", "a\r\n b", "   ", "🙂🙂 🙂", "word " * 3000]


@pytest.fixture(scope="module")
def path():
    return tokenizer_file("byte_bpe_50k.json")


def library(path, texts):
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_pieces_count_as_the_library_does(path):
    assert tokencount.Counter(path).counts(TEXTS) == library(path, TEXTS)


def test_counts_through_the_cache(spark, path, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, "a"), (50, "a"), (50, "b b"), (None, "a"), (None, "q"), (60, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as digest")
    want = sorted((str(i), len((t or "").encode()), n, n > 5) for (i, t), n in zip(rows, library(path, [t or "" for _, t in rows]), strict=True))
    cache = str(tmp_path / "cache")
    for _ in range(2):
        got = tokencount.token_counts(docs, path, cache, limit=5)
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want
        stored = spark.read.parquet(cache)
        assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t in rows})


def test_another_tokenizer_counts_as_the_library_does():
    other = tokenizer_file("word_bpe_49k.json")
    counter = tokencount.Counter(other)
    assert not counter.pieces and counter.counts(TEXTS) == library(other, TEXTS)


def test_memory_is_bounded_in_bytes(path, monkeypatch):
    monkeypatch.setattr(tokencount, "_MEMORY", 2000)
    counter = tokencount.Counter(path)
    texts = [" ".join(f"w{i}x{k}" for k in range(50)) + " " + "y" * 200 for i in range(30)]
    assert [counter.counts([t])[0] for t in texts] == library(path, texts)
    assert counter.bytes < 12_000 and max(map(len, counter.known)) <= 64


def test_a_later_run_encodes_only_what_is_new(spark, path, tmp_path):
    """Of changed documents, texts whose counts are stored are not encoded again; other versions of a tokenizer are not mixed up."""
    cache = str(tmp_path / "cache")
    first = spark.createDataFrame([(i, f"text {i % 7}") for i in range(40)], "doc_id long, text string")
    tokencount.token_counts(first, path, cache).count()
    assert spark.read.parquet(cache).count() == 7
    later = spark.createDataFrame([(i, f"text {i % 7}" if i < 30 else f"new {i % 3}") for i in range(40)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokencount.token_counts(later, path, cache).collect()}
    assert spark.read.parquet(cache).count() == 7 + 3
    assert [got[i] for i in range(40)] == library(path, [r.text for r in later.orderBy("doc_id").collect()])
    other = tokenizer_file("word_bpe_49k.json")
    tokencount.token_counts(later, other, cache).count()
    assert spark.read.parquet(cache).groupBy("tokenizer").count().count() == 2 and spark.read.parquet(cache).count() == 20


def test_empty_table(spark, path):
    assert tokencount.token_counts(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0
