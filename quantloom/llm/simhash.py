"""Near-duplicate documents by SimHash fingerprints and pigeonhole blocks.

A fingerprint has 64 bits. Cut into ``blocks`` blocks, two fingerprints that
differ in at most ``distance`` bits agree in at least ``blocks - distance`` of
them; so every such pair meets in the bucket of some choice of that many blocks
and is verified there by its Hamming distance. Documents with one fingerprint
are collapsed first, so groups of exact copies of any size cost one row.

A bucket never emits its pairs: it emits a star for each of its own connected
groups, which keeps every component and grows with the rows. Inside a bucket,
neighbours are found by comparing all members while that is cheaper, and above
that by looking up every bit pattern within the distance, so the work per
member is bounded whatever the bucket's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm import jaccard
from quantloom.llm.columns import arrow_map, row_of, texts, tidy, unpacked
from quantloom.llm.components import connected_components
from quantloom.shared import bound_arrow_batches, stage_table

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_OFFSETS = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of a UTF-8 text; 0 for a text without words."""
    w = text.lower().split()
    if not w:
        return 0
    k = min(words, len(w))
    n = len(w) - k + 1
    shingles = map(b" ".join, zip(*[w[i:] for i in range(k)], strict=False))
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, n)
    each = np.bincount((h.view(np.uint8).reshape(n, 8) + _OFFSETS).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits((2 * each > n).ravel(), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, tie, fp): fp as a signed long, tie a digest of the text. Null text counts as empty."""
    bound_arrow_batches(docs.sparkSession)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, words, seed) for t in texts(batch)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(fps, pa.int64())], ["doc_id", "tie", "fp"])

    tied = docs.select(docs["doc_id"], docs["text"], F.xxhash64(docs["text"]).alias("tie"))
    return tied.mapInArrow(arrow_map(rows), "doc_id long, tie long, fp long")


def block_masks(distance: int, blocks: int) -> list[int]:
    """The masks of every choice of blocks - distance of the blocks, as signed longs."""
    if not 0 <= distance < blocks <= 64:
        raise ValueError("need 0 <= distance < blocks <= 64")
    edges = [64 * i // blocks for i in range(blocks + 1)]
    single = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(c) for c in combinations(single, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _flips(free: int, distance: int) -> np.ndarray:
    bits = [1 << i for i in range(64) if free >> i & 1]
    return np.array([sum(c) for d in range(1, distance + 1) for c in combinations(bits, d)], np.uint64)


def bucket_stars(fps: np.ndarray, free: int, distance: int) -> list[tuple[int, int]]:
    """Links (positions) that join each connected group of the distinct, sorted ``fps`` to its first member."""
    m = len(fps)
    flips = _flips(free, distance) if m > 4096 else None
    flips = None if flips is not None and len(flips) > m else flips
    left = np.ones(m, bool)
    out: list[tuple[int, int]] = []
    for root in range(m):
        if not left[root]:
            continue
        left[root] = False
        front = np.array([root])
        while len(front):
            found = []
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            for part in np.array_split(front, -(-len(front) * (len(rest) if flips is None else len(flips)) // 4_000_000)):
                if flips is None:
                    hit = (np.bitwise_count(fps[part][:, None] ^ fps[rest][None, :]) <= distance).any(axis=0)
                    found.append(rest[hit])
                else:
                    near = (fps[part][:, None] ^ flips[None, :]).ravel()
                    at = np.minimum(np.searchsorted(fps, near), m - 1)
                    at = at[fps[at] == near]
                    found.append(at[left[at]])
            front = np.unique(np.concatenate(found)) if found else np.empty(0, int)
            left[front] = False
            out += zip(repeat(root), front.tolist(), strict=False)
    return out


def _links_of_sorted(masks: list[int], distance: int):
    frees = [~m & (1 << 64) - 1 for m in masks]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def ended(k: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero((k[1:] != k[:-1]) | (key[1:] != key[:-1])) + 1
        first = np.concatenate([[0], cut])
        size = np.diff(np.concatenate([first, [len(k)]]))
        two = first[size == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
        a, b = [fp[two]], [fp[two + 1]]
        for at, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own = fp[at : at + n]
            if stars := bucket_stars(own, frees[int(k[at])], distance):
                x, y = np.array(stars).T
                a.append(own[x])
                b.append(own[y])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in (a, b)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = tuple(batch.column(n).to_numpy(zero_copy_only=False) for n in ("k", "key", "fp"))
            part = part[0], part[1], part[2].view(np.uint64)
            last = np.flatnonzero((part[0] != part[0][-1]) | (part[1] != part[1][-1]))
            start = last[-1] + 1 if len(last) else 0  # where the bucket that may go on begins
            if held and (start or held[-1][0][-1] != part[0][0] or held[-1][1][-1] != part[1][0]):
                done = [*held, tuple(x[:start] for x in part)]
                yield ended(*(np.concatenate(c) for c in zip(*done, strict=True)))
                held = []
            elif start:
                yield ended(*(x[:start] for x in part))
            held.append(tuple(x[start:] for x in part))
        if held:
            yield ended(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def near_links(fps: DataFrame, distance: int = 3, blocks: int = 6) -> DataFrame:
    """(a, b) of the distinct fingerprints in column fp: a spanning forest of every bucket's links."""
    masks = block_masks(distance, blocks)
    bound_arrow_batches(fps.sparkSession)
    keys = fps.select("fp").distinct().select(
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("k", "key"), "fp"
    )
    # Unsigned order of fp, which the lookups in a bucket rely on.
    dealt = keys.repartition("k", "key").sortWithinPartitions("k", "key", F.col("fp").bitwiseXOR(F.lit(-(1 << 63))))
    return dealt.mapInArrow(tidy(_links_of_sorted(masks, distance)), "a long, b long")


def _with_lowest(docs: DataFrame, words: int, seed: int, distance: int, blocks: int, similarity: float | None = None, shingle: int = 5) -> tuple[DataFrame, DataFrame]:
    """The fingerprints, and (fp, low): low is the first row of the fingerprint's component as (no id, doc_id, tie).

    With ``similarity``, texts with that Jaccard similarity of their shingles of ``shingle`` words are linked as well.
    """
    if similarity is None:
        fps, _ = stage_table(fingerprints(docs, words, seed), "simhash")
    else:
        fps, _ = stage_table(jaccard.sketches(docs, partial(fingerprint, words=words, seed=seed), shingle), "simhash")
    each = fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("low"))
    found = near_links(fps, distance, blocks)
    if similarity is not None:
        found = found.unionAll(jaccard.similar_links(docs, fps, similarity, shingle))
    links, _ = stage_table(found.distinct(), "simhash-links")
    roots = connected_components(links)
    rooted = each.join(roots, each.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("low"))
    return fps, rooted.select("fp", "root").join(lowest, "root").select("fp", "low")


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, distance: int = 3, blocks: int = 6) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links of close fingerprints reach.

    Null text is an empty text, with fingerprint 0, linked like any other.
    Repeated rows come back once each. A null doc_id keeps its row and never
    becomes a component_id unless its whole component has none (then null). An
    empty table gives an empty result; other columns are ignored.
    """
    fps, known = _with_lowest(docs, words, seed, distance, blocks)
    return fps.join(known, "fp").select("doc_id", "fp", F.col("low.doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 3, seed: int = 42, distance: int = 3, blocks: int = 6, similarity: float | None = None, shingle: int = 5) -> DataFrame:
    """``docs`` with one row of each component of near_duplicates: that with the smallest doc_id.

    With ``similarity``, texts with that Jaccard similarity of their shingles of ``shingle`` words are in one component too.
    Of rows that share that doc_id, one text stays, and of rows that share that
    too the first by their other columns; rows without a doc_id stay only if
    their component has no other. Null text is an empty text. Columns of any
    name and type stay as they are; an empty table gives an empty result.
    """
    _, known = _with_lowest(docs, words, seed, distance, blocks, similarity, shingle)
    kept = known.select("low.*").distinct().select(F.col("doc_id").alias("id"), "tie")
    # The row itself is one column, so none of its names can clash with those used here.
    rows = docs.select(row_of(docs), docs["doc_id"].alias("own_id"), F.xxhash64(docs["text"]).alias("own_tie"))
    stay = rows.join(kept.hint("shuffle_hash"), F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_tie") == F.col("tie")), "left_semi")
    # Rows that repeat a kept doc_id and text meet in one small group each. Maps have no order, but text forms of them have.
    simple = lambda f: F.col("row").getField(f.name) if not isinstance(f.dataType, T.MapType | T.StructType | T.ArrayType) else F.to_json(F.struct(F.col("row").getField(f.name)))
    order = [simple(f).asc_nulls_first() for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    nth = F.row_number().over(Window.partitionBy("own_id", "own_tie").orderBy(*order or [F.lit(0)]))
    return unpacked(stay.withColumn("nth", nth).where("nth = 1"), docs.columns)
