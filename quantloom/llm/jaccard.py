"""Links of texts whose sets of word shingles have a Jaccard similarity of at least a given figure.

Texts with one set are collapsed first. Sets meet by MinHash: 32 bands of 5
minima, so two sets at a similarity of 0.8 share no band in 3 of a million
cases, and less often above it. Bands only find candidates: sets that bands
connect are gathered once, by their component, and compared exactly there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.columns import arrow_map, texts, tidy
from quantloom.llm.components import connected_components
from quantloom.shared import bound_arrow_batches, stage_table

BANDS, ROWS = 32, 5
_RNG = np.random.default_rng(42)
_XOR = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_TIMES = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_MIX = _RNG.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)
_BAND = _RNG.integers(0, 1 << 64, BANDS, np.uint64)


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the word shingles of a UTF-8 text; a shorter text is one shingle."""
    w = text.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    k = min(words, len(w))
    each = map(b" ".join, zip(*[w[i:] for i in range(k)], strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, each, repeat(7)), np.uint64, len(w) - k + 1))


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key for each band of a set that is not empty."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(found), 2048):
        low = np.minimum(low, ((found[a : a + 2048] ^ _XOR[:, None]) * _TIMES[:, None]).min(1))
    return (low.reshape(BANDS, ROWS) * _MIX).sum(1, dtype=np.uint64) ^ _BAND


def sketches(docs: DataFrame, fingerprint: Callable[[bytes], int], words: int) -> DataFrame:
    """(doc_id, tie, fp, sig, keys): sig is a digest of the set, keys are those of its bands; null for a text without words."""
    bound_arrow_batches(docs.sparkSession)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        given = texts(batch)
        sets = [shingles(t, words) for t in given]
        fp = pa.array(np.array([fingerprint(t) for t in given], np.uint64).view(np.int64), pa.int64())
        sig = pa.array([xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets], pa.int64())
        keys = pa.array([band_keys(s).view(np.int64) if len(s) else None for s in sets], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), fp, sig, keys], ["doc_id", "tie", "fp", "sig", "keys"])

    tied = docs.select(docs["doc_id"], docs["text"], F.xxhash64(docs["text"]).alias("tie"))
    return tied.mapInArrow(arrow_map(rows), "doc_id long, tie long, fp long, sig long, keys array<long>")


class _Postings:
    """Which of some sets have which element."""

    def __init__(self, ids: np.ndarray, start: np.ndarray, among: np.ndarray, n_ids: int) -> None:
        size = start[among + 1] - start[among]
        at = np.repeat(start[among] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        own = ids[at]
        order = np.argsort(own, kind="stable")
        self.sets = np.repeat(among.astype(np.int32), size)[order]
        self.ends = np.cumsum(np.bincount(own, minlength=n_ids))
        self.count = len(among)

    def shared(self, own: np.ndarray, n: int) -> np.ndarray:
        """How many of the elements ``own`` each of n sets has."""
        begin = np.where(own > 0, self.ends[own - 1], 0)
        size = self.ends[own] - begin
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return np.bincount(self.sets[at], minlength=n)


def set_stars(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (positions) that join each group of similar sets to its first member; compares exactly.

    A set is compared with those that share an element with it and belong to no
    group yet; the lists of elements are made anew when half of their sets have found one.
    """
    n, size = len(sets), np.array([len(s) for s in sets])
    # Numbers of 32 bits in place of the hashes, looked up set by set: an inverse of all at once holds far more.
    known = np.unique(np.concatenate(sets))
    ids = np.concatenate([np.searchsorted(known, s).astype(np.int32) for s in sets])
    n_ids, start = len(known), np.concatenate([[0], np.cumsum(size)])
    del known
    left = np.ones(n, bool)
    postings = _Postings(ids, start, np.arange(n), n_ids)
    out: list[tuple[int, int]] = []
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        front = [root]
        while front and left.any():
            if 2 * int(left.sum()) <= postings.count:
                postings = _Postings(ids, start, np.flatnonzero(left), n_ids)
            at = front.pop()
            both = postings.shared(ids[start[at] : start[at + 1]], n)
            near = np.flatnonzero(left & (both >= similarity * (size + size[at] - both)))
            left[near] = False
            front += near.tolist()
            out += zip(repeat(root), near.tolist(), strict=False)
    return out


def similar_links(docs: DataFrame, own: DataFrame, similarity: float, words: int = 5) -> DataFrame:
    """(a, b) of fingerprints whose texts have a Jaccard similarity of at least ``similarity``.

    ``own``: the sketches of ``docs``. Each component of the bands' candidates
    is compared in one task, which holds its sets.
    """
    # Every text of a set has the set's shingles, so any of them stands for it.
    one = F.min(F.struct("fp", "doc_id", "tie")).alias("one")
    sets, _ = stage_table(own.where("sig is not null").groupBy("sig").agg(one, F.first("keys").alias("keys")), "minhash-sets")
    same = own.join(sets.select("sig", F.col("one.fp").alias("low")), "sig").where("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b"))

    banded = sets.select("sig", F.explode("keys").alias("key"))
    met = banded.groupBy("key").agg(F.min("sig").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = banded.join(met.hint("shuffle_hash"), "key").where("sig <> low").select(F.col("sig").alias("a"), F.col("low").alias("b")).distinct()
    roots = connected_components(stage_table(stars, "minhash-stars")[0])

    asked = sets.join(roots, sets["sig"] == roots["node"]).select("sig", F.col("one.doc_id").alias("__id"), F.col("one.tie").alias("__tie"), F.col("one.fp").alias("low"), "root")
    tied = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    found = tied.join(asked.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("tie") == F.col("__tie"))).dropDuplicates(["root", "sig"])
    dealt = found.select("root", "sig", "low", "text").repartition("root").sortWithinPartitions("root", "sig")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lows, sets = None, [], []

        def ended() -> pa.RecordBatch:
            near = set_stars(sets, similarity) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([lows[p[i]] for p in near], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for root, low, text in zip(batch.column("root").to_pylist(), batch.column("low").to_pylist(), texts(batch), strict=True):
                if root != now and sets:
                    yield ended()
                    lows, sets = [], []
                now = root
                lows.append(low)
                sets.append(shingles(text, words))
        if sets:
            yield ended()

    return dealt.mapInArrow(tidy(links), "a long, b long").where("a <> b").unionAll(same)
