"""Token counts through a cache keyed by digests of the content and of the tokenizer.

A text is counted once per tokenizer version, however many documents and runs
share it: documents are reduced to digests, joined to the stored counts, and
only the distinct digests without a count send one text each to the tokenizer;
their counts are then appended to the cache and every document reads its count
from there.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.columns import arrow_map, narrowed
from quantloom.shared import bound_arrow_batches, new_path, stage_table

#: Whatever a byte-level tokenizer cuts at ASCII white space may be cut here too: a word with the
#: one space before it, a run of white space but for its last character, or one such character.
_PIECES = re.compile(r" ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]")
#: White space beyond ASCII: a run of it may join with its neighbours, so such texts go to the library whole.
_WIDE = re.compile("[%s]" % "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))))
# Fixed value: the pre-tokenizer for which pieces may be counted by themselves.
_PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: Bytes of pieces and their counts that a worker remembers, about; beyond that it forgets all and starts anew.
_MEMORY = 128 << 20
#: Longer pieces are counted each time.
_LONGEST = 64

_loaded: dict[str, Counter] = {}

SCHEMA = "digest binary, tokenizer string, n_tokens long"


class Counter:
    """Counts tokens as the library does, and remembers the counts of single words."""

    def __init__(self, path: str, pieces: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, int] = {}
        self.bytes = 0
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = spec["normalizer"] is None and spec["model"]["type"] == "BPE" and not any(t["normalized"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens") or [])
        self.pieces = pieces and plain and {"trim_offsets": True, "use_regex": True, **spec["pre_tokenizer"]} == _PRE_TOKENIZER

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, text: str) -> bool:
        return not self.pieces or _WIDE.search(text) is not None or any(s in text for s in self.special)

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        whole = [i for i, t in enumerate(texts) if self._whole(t)]
        for i, n in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
            out[i] = n
        skip = set(whole)
        for i, text in enumerate(texts):
            if i not in skip:
                cut = _PIECES.findall(text)
                if self.bytes > _MEMORY:
                    self.known.clear()
                    self.bytes = 0
                long: dict[str, int] = {}
                if new := list(set(cut).difference(self.known)):
                    for piece, n in zip(new, self._encode(new), strict=True):
                        (self.known if len(piece) <= _LONGEST else long)[piece] = n
                    self.bytes += sum(len(p) + 130 for p in new if len(p) <= _LONGEST)
                out[i] = sum(map(self.known.__getitem__, cut)) if not long else sum(long[p] if p in long else self.known[p] for p in cut)
        return out


def _counter(path: str, version: str, pieces: bool) -> Counter:
    if version not in _loaded:
        _loaded[version] = Counter(path, pieces)
    return _loaded[version]


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_cache(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version; a digest that two runs have appended counts once."""
    if not _exists(spark, cache_path):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    stored = spark.read.schema(SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 512, pieces: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; over_limit: n_tokens > limit.

    ``tokenizer_path``: a .json file of the tokenizers library, at the same
    place on every machine. ``cache_path``: a Parquet folder in shared storage,
    made if missing; by default a new one for this call. ``pieces``: count word
    by word where the tokenizer's file says that it is byte-level and cuts at
    white space; texts go to it whole for any other file.
    Null text is empty (0 tokens). Rows with null or repeated doc_id come back
    each; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    cache_path = cache_path or new_path(spark, "token-cache")
    version = tokenizer_version(tokenizer_path)
    bound_arrow_batches(spark)
    text = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    plain = narrowed(docs, "doc_id", "text")
    keyed, _ = stage_table(plain.select("doc_id", digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")), "digests")

    # One row to encode for each digest, found before any copies meet; the text itself is dealt by
    # doc_id, which copies do not share.
    ask = keyed.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("r"))
    ask = ask.join(read_cache(spark, cache_path, version), "digest", "left_anti").select(F.col("r.doc_id").alias("ask_id"), "digest")
    misses = plain.join(ask.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("ask_id")) & (digest == F.col("digest"))).select("digest", text.alias("text"))

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = _counter(tokenizer_path, version, pieces).counts(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(np.array(n, np.int64))], ["digest", "n_tokens"])

    counted = misses.mapInArrow(arrow_map(encode), "digest binary, n_tokens long")
    counted.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    # Written first, so that the join below is on two plain exchanges, whose hot digests Spark can split.
    known, _ = stage_table(read_cache(spark, cache_path, version), "token-counts")
    return keyed.join(known, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
