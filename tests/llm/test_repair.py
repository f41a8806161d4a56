import zlib

import numpy as np
from quantloom.llm import repair
from quantloom.llm.encoder import Encoder
from quantloom.llm.vocabularies import tokenizer_file

TEXTS = [
    "", None, "Hello, World!", "  a\tb \n c", "it's I'LL <|endoftext|> x", "<|ENDOFTEXT|> y", "J̌ J̌x", "Été İstanbul", "é É", "ΣΣ Σ.", "a b c \x1c d",
    "12 345", "日本語 テキスト", "the cat sat on the mat " * 200, "🙂🙂", "x" * 5000, "ß ẞ ﬁ",
]


def library(texts, name="word_bpe_49k.json"):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file(name))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


AWKWARD = [
    "don't can't'll ''s !'s 's'some x's'", "a×b÷c ª º µ", "ÀÉÎÕÜÞ ÿß Ÿ", "caf\u00e9 cafe\u0301", "x\u00a0y\u0085z", "tab\x1cs\x1fq", "³²½ 12ab34", "&&&a,***b.%%%",
    "é's l'été d'Île", "’s a’s", "<|x|> <|startoftext|>abc", "a" * 70 + "," * 70, "\u0130stanbul İ", "ǅ ﬁne ﬀ", "한국어 텍스트, 日本", "a_b__c", "A\nB\r\nC\u2028D",
]


def same_as_library(texts, name, **more):
    ids, lengths = Encoder(tokenizer_file(name), **more).encode(texts)
    want = library(texts, name)
    assert lengths.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_encoder_gives_the_librarys_ids():
    same_as_library([t or "" for t in TEXTS] + AWKWARD, "word_bpe_49k.json")
    same_as_library([], "word_bpe_49k.json")


def test_encoder_of_another_tokenizer_gives_the_librarys_ids():
    same_as_library(["Hello  world foo", *[t or "" for t in TEXTS], *AWKWARD], "byte_bpe_50k.json")


def test_encoder_of_random_texts_gives_the_librarys_ids():
    rng = np.random.default_rng(5)
    signs = np.array(list("abcdefgstmlrv ABCS \t\n''..,,!&*<>|0123éèÀß×ñ\u0301’"))
    texts = ["".join(rng.choice(signs, rng.integers(0, 60))) for _ in range(3000)]
    same_as_library(texts, "word_bpe_49k.json")
    plain = np.array(list("abest  '.,7éÉ"))
    same_as_library(["".join(rng.choice(plain, rng.integers(0, 60))) for _ in range(3000)], "word_bpe_49k.json")


def test_encoder_forgets_and_stays_right():
    rng = np.random.default_rng(6)
    e = Encoder(tokenizer_file("word_bpe_49k.json"), memory=100_000, longest=8)
    for _ in range(10):
        texts = [" ".join("".join(rng.choice(list("abcdefgh"), rng.integers(1, 12))) for _ in range(200)) for _ in range(5)]
        ids, lengths = e.encode(texts)
        want = library(texts)
        assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        assert e.bytes < 400_000 and max(map(len, e.known)) <= 8


def test_shards_round_trip():
    rng = np.random.default_rng(2)
    for n, sigma in ((1, 5), (40, 3), (3000, 4), (50_000, 300)):
        lengths = rng.integers(1, 60, n)
        ids = rng.zipf(1.6, int(lengths.sum())) % sigma
        if n == 3000:
            ids = np.tile(ids[:97], len(ids) // 97 + 1)[: len(ids)]
        docs = [None if i % 7 == 3 else i for i in range(n)]
        payload = repair.pack_shard(docs, lengths, ids, sigma)
        shard = repair.Shard(payload)
        assert shard.doc_ids == docs and (shard.lengths == lengths).all()
        assert (shard.all_ids() == ids).all()
        stop = np.cumsum(lengths)
        for k in {0, n // 2, n - 1}:
            assert (shard.document(k) == ids[stop[k] - lengths[k] : stop[k]]).all()
        if n == 3000:
            assert len(shard.sequence) < len(ids) / 3


def pairs_left(g, last_ids):
    """How often each pair of neighbours could still be replaced."""
    x = repair.Expansions(g.base, g.left, g.right, repair._rule_lengths(g))
    ends = np.cumsum(x.length[g.sequence])
    inner = ~np.isin(ends, last_ids)
    found = {}
    was = None
    for a, b, ok in zip(g.sequence[:-1].tolist(), g.sequence[1:].tolist(), inner[:-1].tolist(), strict=True):
        if ok and not (a == b and was == (a, b)):
            found[a, b] = found.get((a, b), 0) + 1
            was = (a, b)
        else:
            was = None
    return found


def test_rules_repeat_and_never_cross_documents():
    ids = np.array([1, 2, 1, 2, 1, 2, 1, 2, 3] * 50)
    last = np.zeros(len(ids), bool)
    last[8::9] = True
    g = repair.compress(ids, last, 10)
    assert len(g.sequence) < 100
    x = repair.Expansions(10, g.left, g.right, repair._rule_lengths(g))
    assert (x.of(g.sequence) == ids).all()


def test_no_pair_that_pays_is_left():
    rng = np.random.default_rng(3)
    for n, sigma in ((400, 2), (5000, 7), (20_000, 60)):
        lengths = rng.integers(1, 80, n // 20)
        ids = rng.zipf(1.4, int(lengths.sum())) % sigma
        last = np.zeros(len(ids), bool)
        last[np.cumsum(lengths) - 1] = True
        g = repair.compress(ids, last, sigma)
        x = repair.Expansions(sigma, g.left, g.right, repair._rule_lengths(g))
        assert (x.of(g.sequence) == ids).all()
        assert max(pairs_left(g, np.cumsum(lengths)).values()) < 8  # 4, but for those given up as overlapping
        assert len(g.sequence) < len(ids)


def test_shard_stops_where_its_symbols_have_no_room():
    rng = np.random.default_rng(4)
    ids = np.tile(rng.integers(0, 60_000, 30_000), 5)
    last = np.zeros(len(ids), bool)
    last[29_999::30_000] = True
    g = repair.compress(ids, last, 60_000)
    assert len(g.left) == repair.symbol_room(60_000) == 5536
    wide = repair.compress(ids, last, 62_000)
    assert repair.symbol_room(62_000) > 1 << 30 and len(wide.sequence) == 5
    payload = repair.pack_shard(list(range(5)), np.full(5, 30_000), ids, 62_000)
    assert (repair.Shard(payload).document(3) == ids[:30_000]).all()


def test_long_expansions():
    ids = np.zeros(300_000, np.int64)
    shard = repair.Shard(repair.pack_shard([7], np.array([300_000]), ids, 3))
    assert len(shard.sequence) < 100 and (shard.document(0) == 0).all() and len(shard.document(0)) == 300_000


def test_written_and_read_back(spark, tmp_path):
    rows = [(90 - i, t) for i, t in enumerate(TEXTS)] + [(None, "q"), (5, "b"), (5, "a"), (5, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as part")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    ids = [[*x, 1] for x in library([t for _, t in order])]
    want, start = [], 0
    for (d, _), x in zip(order, ids, strict=True):
        want.append((d, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    for size in (1 << 20, 50):
        path = str(tmp_path / f"t{size}")
        repair.write_tokens(docs, path, tokenizer_file("word_bpe_49k.json"), shard_tokens=size)
        got = [tuple(r) for r in repair.read_documents(spark, path).collect()]
        assert sorted(got, key=lambda r: r[1]) == want


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    repair.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, tokenizer_file("word_bpe_49k.json"))
    assert repair.read_documents(spark, path).count() == 0
