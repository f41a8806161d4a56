"""Token ids in binary shards, compressed by a Re-Pair grammar.

Documents are dealt to ranges of ascending doc_id and encoded; the ids of a
range fill shards of bounded length. In a shard, frequent pairs of neighbouring
ids are replaced by new ids (nonterminals) again and again; a round replaces
many pairs at once, each where no more frequent pair overlaps it. A shard
stores its rules, the lengths that symbols expand to, the remaining sequence
with the offsets of its documents, and decodes as a whole or by document.

A dataset of shards is a Parquet folder with one row a shard: part and nth give
the order, n_docs and n_tokens are read without the payload.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.columns import narrowed, tidy
from quantloom.llm.encoder import _gather, encoder
from quantloom.shared import bound_arrow_batches, stage_table

MAGIC = b"RPR2"
_HEAD = struct.Struct("<4sIQQQQBB")


# --- the grammar -----------------------------------------------------------


@dataclass
class Grammar:
    """Symbols from ``base`` on are rules: symbol base + k expands to left[k], right[k]."""

    base: int
    left: np.ndarray
    right: np.ndarray
    sequence: np.ndarray


#: Stands where a symbol was taken by its neighbour's rule, and beyond the last symbol.
_GONE = np.uint32(0xFFFFFFFF)


def _grouped(key: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys that ``least`` positions or more have: (key, how many, their ascending positions)."""
    if not len(key):
        return key, np.empty(0, np.int64), at
    bits = max(int(at[-1]).bit_length(), 1)
    if int(key.max()).bit_length() + bits <= 64:  # one sort of both in one number
        both = (key << np.uint64(bits)) | at.view(np.uint64)
        both.sort()
        key, at = both >> np.uint64(bits), (both & np.uint64((1 << bits) - 1)).view(np.int64)
    else:
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(first, append=len(key))
    use = count >= least
    return key[first[use]], count[use], at[np.repeat(use, count)]


def _picks(at: np.ndarray, rank: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which pairs at the ascending positions ``at`` to replace: no two share a symbol, and none that could be is left out.

    Where two share one the lower rank goes first, and every second of a run of
    one pair; after three turns what is left goes from left to right.
    """
    out = np.ones(len(at), bool)
    meets = after[:-1] == at[1:]
    out[1:] &= ~meets
    out[:-1] &= ~meets
    i, turn = np.flatnonzero(~out), 0
    while len(i):
        meets = after[i[:-1]] == at[i[1:]]
        lose = np.zeros(len(i), bool)
        if turn < 3:
            lose[1:] |= meets & (rank[i[:-1]] < rank[i[1:]])
            lose[:-1] |= meets & (rank[i[1:]] < rank[i[:-1]])
        chain = np.concatenate([[False], meets & ~lose[1:] & ~lose[:-1]])
        place = np.arange(len(i))
        pick = ~lose & ((place - np.maximum.accumulate(np.where(chain, 0, place))) % 2 == 0)
        out[i[pick]] = True
        gone = pick.copy()
        gone[1:] |= meets & pick[:-1]
        gone[:-1] |= meets & pick[1:]
        i, turn = i[~gone], turn + 1
    return out


def symbol_room(base: int) -> int:
    """How many rules a shard has room for: symbols have 16 bits where that leaves 4,096 rules or more, else 32."""
    return (1 << 16) - base if base <= (1 << 16) - 4096 else (1 << 31) - base


def compress(ids: np.ndarray, last: np.ndarray, base: int, least: int = 4, falloff: float = 0.35) -> Grammar:
    """Re-Pair over ``ids`` (all below ``base``); ``last`` marks ends of documents, which no rule crosses.

    A rule costs two symbols and a length, and saves a symbol wherever it is
    used, so it pays from ``least`` uses on. Ends when no pair is left that
    would be used so often, or when ``symbol_room`` is full: another rule would
    widen every symbol of the shard. Pairs are taken in turns, the most
    frequent first: a turn takes all that occur at least ``falloff`` times as
    often as the most frequent of the turn before. Positions of pairs are kept
    in groups; a turn reads only the groups that may be frequent enough, and
    new pairs are looked for only beside new symbols.
    """
    n, room = len(ids), symbol_room(base)
    shift = np.uint64(max(int(base + room - 1).bit_length(), 16))
    low = np.uint64((1 << int(shift)) - 1)
    # Position n is beyond: what follows a document's last symbol and precedes its first.
    seq = np.append(ids.astype(np.uint32), _GONE)
    following, preceding = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    ends = np.flatnonzero(last)
    following[ends], preceding[ends + 1] = n, n
    following[n] = preceding[0] = n

    def keys(at: np.ndarray) -> np.ndarray:
        return seq[at].astype(np.uint64) << shift | seq[following[at]]

    at = np.flatnonzero(following[:-1] != n)
    key, count, own = _grouped(keys(at), at, least)
    start, filled = np.cumsum(count) - count, len(own)
    pool = np.empty(filled + 2 * n, np.int32)  # each replacement ends a symbol and makes two pairs at most
    pool[:filled] = own
    left, right, made = [], [], 0
    often = int(count.max()) if len(count) else 0
    while len(count) and made < room:
        often = max(least, min(int(often * falloff), int(count.max())))
        some = np.flatnonzero(count >= often)
        held, begin = count[some], start[some]
        of = np.repeat(np.arange(len(some)), held)
        at = pool[np.arange(len(of)) + np.repeat(begin - (np.cumsum(held) - held), held)].astype(np.int64)
        a, b = (key[some] >> shift).astype(np.uint32), (key[some] & low).astype(np.uint32)
        # A position is out of date where another rule has taken one of the pair's symbols.
        live = (seq[at] == a[of]) & (seq[following[at]] == b[of])
        at, of = at[live], of[live]
        now = np.bincount(of, minlength=len(some))
        pool[np.arange(len(of)) + np.repeat(begin - (np.cumsum(now) - now), now)] = at
        count[some] = now
        order = np.argsort(-now, kind="stable")
        chosen = now >= often
        chosen[order[room - made :]] = False
        if chosen.any():
            rank = np.empty(len(some), np.int64)
            rank[order] = np.arange(len(some))
            inside = chosen[of]
            both = at[inside] << 31 | of[inside]
            both.sort()
            at, of = both >> 31, both & 0x7FFFFFFF
            pick = _picks(at, rank[of], following[at])
            used = np.bincount(of[pick], minlength=len(some))
            count[some[chosen]] = 0  # either it becomes a rule, or too few of it would be used
            ruled = chosen & (used >= least)
            pick &= ruled[of]
            at, of = at[pick], of[pick]
            left.append(a[ruled])
            right.append(b[ruled])
            taken = following[at]
            after = following[taken]
            seq[at] = (np.cumsum(ruled) - 1 + base + made).astype(np.uint32)[of]
            seq[taken] = _GONE
            following[at], preceding[after] = after, at
            before = preceding[at].astype(np.int64)
            # A pair of two new symbols is found at the first of them.
            beside = np.concatenate([at[after != n], before[(before != n) & (seq[before] < base + made)]])
            beside.sort()
            made += int(ruled.sum())
            new_key, new_count, own = _grouped(keys(beside), beside, least)
            pool[filled : filled + len(own)] = own
            stay = count >= least
            key, start = np.concatenate([key[stay], new_key]), np.concatenate([start[stay], filled + np.cumsum(new_count) - new_count])
            count, filled = np.concatenate([count[stay], new_count]), filled + len(own)
        else:
            stay = count >= least
            key, start, count = key[stay], start[stay], count[stay]
    none = np.empty(0, np.uint32)
    return Grammar(base, *(np.concatenate([none, *c]).astype(np.int64) for c in (left, right)), seq[seq != _GONE].astype(np.int64))


class Expansions:
    """What symbols expand to, as slices of one array: ids by themselves, then the rules."""

    def __init__(self, base: int, left: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> None:
        self.length = np.concatenate([np.ones(base, np.int64), lengths])
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.empty(int(self.length.sum()), np.uint32)
        self.flat[:base] = np.arange(base)
        k = 0
        while k < len(left):
            # Rules up to here refer to earlier ones only; take all that refer to nothing later than k.
            deep = np.maximum(left[k:], right[k:]) >= base + k
            end = k + int(deep.argmax()) if deep.any() else len(left)
            both = np.stack([left[k:end], right[k:end]], axis=1).ravel()
            own = self.of(both)
            at = self.start[base + k]
            self.flat[at : at + len(own)] = own
            k = end

    def of(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that the symbols expand to."""
        return _gather(self.flat, self.start[symbols], self.length[symbols])


def _rule_lengths(g: Grammar) -> np.ndarray:
    out = np.ones(len(g.left), np.int64)
    k = 0
    size = lambda s: np.where(s >= g.base, out[np.maximum(s - g.base, 0)], 1) if len(out) else np.ones(len(s), np.int64)
    while k < len(g.left):
        deep = np.maximum(g.left[k:], g.right[k:]) >= g.base + k
        end = k + int(deep.argmax()) if deep.any() else len(g.left)
        out[k:end] = size(g.left[k:end]) + size(g.right[k:end])
        k = end
    return out


# --- the shard's bytes -----------------------------------------------------


def _kind(wide: int) -> str:
    return "<u4" if wide else "<u2"


def pack_shard(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, base: int) -> bytes:
    """A shard of documents with these ids; every document has at least one."""
    last = np.zeros(len(ids), bool)
    last[np.cumsum(lengths) - 1] = True
    g = compress(ids, last, base)
    sizes = _rule_lengths(g)
    wide, long = base + len(g.left) > 1 << 16, bool(len(sizes)) and int(sizes.max()) >= 1 << 16
    # Where each document begins in the sequence: rules never cross documents.
    expanded = np.cumsum(np.where(g.sequence >= base, sizes[np.maximum(g.sequence - base, 0)], 1) if len(sizes) else np.ones(len(g.sequence), np.int64))
    begin = np.searchsorted(expanded, np.cumsum(lengths) - lengths, side="right")
    parts = [
        _HEAD.pack(MAGIC, base, len(doc_ids), len(ids), len(g.left), len(g.sequence), wide, long),
        np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        lengths.astype("<u4").tobytes(),
        begin.astype("<u4").tobytes(),
        g.left.astype(_kind(wide)).tobytes(),
        g.right.astype(_kind(wide)).tobytes(),
        sizes.astype(_kind(long)).tobytes(),
        g.sequence.astype(_kind(wide)).tobytes(),
    ]
    return b"".join(parts)


class Shard:
    """Reads a shard's bytes; ``document`` decodes one without the others."""

    def __init__(self, payload: bytes) -> None:
        magic, self.base, n, self.n_tokens, rules, symbols, wide, long = _HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, count, at)
            at += out.nbytes
            return out

        valid, raw = take("u1", n), take("<i8", n)
        self.doc_ids = [int(d) if v else None for d, v in zip(raw, valid, strict=True)]
        self.lengths = take("<u4", n).astype(np.int64)
        self.begin = np.append(take("<u4", n).astype(np.int64), symbols)
        left, right = take(_kind(wide), rules).astype(np.int64), take(_kind(wide), rules).astype(np.int64)
        sizes = take(_kind(long), rules).astype(np.int64)
        self.sequence = take(_kind(wide), symbols)
        self.expansions = Expansions(self.base, left, right, sizes)

    def all_ids(self) -> np.ndarray:
        return self.expansions.of(self.sequence)

    def document(self, k: int) -> np.ndarray:
        """The ids of document ``k`` alone."""
        return self.expansions.of(self.sequence[self.begin[k] : self.begin[k + 1]])


# --- writing and reading ---------------------------------------------------

SCHEMA = "part int, nth int, n_docs long, n_tokens long, payload binary"
_ARROW = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])


#: Characters that are encoded at a time: runs that repeat among them are looked up once.
_AT_ONCE = 2 << 20


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, shard_tokens: int = 1 << 20, memory: int = 64 << 20) -> None:
    """Encode every text, end it with ``end_id`` and write the shards to ``path``, in ascending doc_id order.

    The ids are those of the tokenizers library for any file that it loads; a
    worker remembers ids of about ``memory`` bytes of text at most. Null text
    is empty: its document is the end id alone. Null doc_id comes first; rows
    that share a doc_id are ordered by their text. A shard closes when it has
    ``shard_tokens`` ids, so only a longer document makes a longer shard. An
    empty table writes no shard; other columns are ignored.
    """
    from pyspark import TaskContext

    bound_arrow_batches(docs.sparkSession)
    plain = narrowed(docs, "doc_id", "text")
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    dealt = plain.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, nth = encoder(tokenizer_path, memory), TaskContext.get().partitionId(), 0
        held: list[tuple[list[int | None], np.ndarray, np.ndarray]] = []
        size = 0

        def shard() -> pa.RecordBatch:
            doc_ids = [d for ds, _, _ in held for d in ds]
            lengths, ids = (np.concatenate([h[k] for h in held]) for k in (1, 2))
            payload = pack_shard(doc_ids, lengths, ids, encode.size)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((part, nth, len(doc_ids), len(ids), payload), _ARROW.types, strict=True)], schema=_ARROW)

        for doc_ids, texts in _together(batches):
            ids, lengths = encode.encode(texts)
            # Room for the end id after each document.
            lengths = lengths + 1
            ended = np.full(int(lengths.sum()), end_id, np.int32)
            slot = np.ones(len(ended), bool)
            slot[np.cumsum(lengths) - 1] = False
            ended[slot] = ids
            at = 0
            stops = np.cumsum(lengths)
            while at < len(texts):
                done = int(stops[at - 1]) if at else 0
                end = int(np.searchsorted(stops, done + shard_tokens - size, side="left")) + 1
                end = min(end, len(texts))
                held.append((doc_ids[at:end], lengths[at:end], ended[done : stops[end - 1]]))
                size += int(stops[end - 1]) - done
                at = end
                if size >= shard_tokens:
                    yield shard()
                    held, size, nth = [], 0, nth + 1
        if held:
            yield shard()

    dealt.mapInArrow(tidy(run), SCHEMA).write.parquet(path)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str]]]:
    """(doc_ids, texts) of several batches, until they have some characters."""
    doc_ids: list[int | None] = []
    texts: list[str] = []
    size = 0
    for b in batches:
        new = [t or "" for t in b.column("text").to_pylist()]
        doc_ids += b.column("doc_id").to_pylist()
        texts += new
        size += sum(map(len, new))
        if size >= _AT_ONCE:
            yield doc_ids, texts
            doc_ids, texts, size = [], [], 0
    if texts:
        yield doc_ids, texts


def _starts(shards: DataFrame) -> DataFrame:
    """(part, nth, start): ids of all shards before each; summed by part first, so that no task sees all shards."""
    sizes = shards.select("part", "nth", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.join(parts, "part").select("part", "nth", (F.col("part_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the shards at ``path``, each decoded by itself.

    start: ids of all documents before it; ids_crc32: of its ids as
    little-endian unsigned 32-bit integers.
    """
    bound_arrow_batches(spark)
    shards = spark.read.schema(SCHEMA).parquet(path)
    # Written first, so that its size is known when the join with the payloads is planned.
    starts, _ = stage_table(_starts(shards), "shard-starts")
    placed = shards.join(starts, ["part", "nth"]).select("start", "payload")
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, payload in zip(b.column("start").to_pylist(), b.column("payload"), strict=True):
                shard = Shard(payload.as_py())
                found = [shard.document(k) for k in range(len(shard.doc_ids))]
                crc = [zlib.crc32(ids.astype("<u4", copy=False)) for ids in found]
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                cols = [shard.doc_ids, start + np.cumsum(sizes) - sizes, sizes, crc]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, out.types, strict=True)], schema=out)

    return placed.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")
