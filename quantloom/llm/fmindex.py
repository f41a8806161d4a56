"""Benchmark decontamination by an FM-index per shard of training documents.

Words of the benchmark get numbers; all other words of a document, and its end,
are separators, since no benchmark phrase can cross them. Runs between
separators that are shorter than the shortest phrase are left out for the same
reason. What remains of a shard is indexed: suffixes are sorted by prefix
doubling, the Burrows-Wheeler transform goes into a wavelet matrix, every
phrase is searched backwards through its ranks, and its occurrences are located
by walking back to sampled suffix positions. The occurrences of a document are
merged to spans of words to remove.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.columns import free_name, tidy
from quantloom.shared import bound_arrow_batches, drop_table, stage_table

#: Bytes of words (digits, letters and whatever is not ASCII), A-Z lower-cased; all others become spaces.
_TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where the words begin and end."""
    inside = np.frombuffer(b" " + text.translate(_TO_WORDS) + b" ", np.uint8) != 0x20
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


@dataclass
class Phrases:
    """A block of the benchmark: distinct windows as rows of word numbers, and the items that hold them."""

    vocabulary: dict[bytes, int]
    by_length: dict[int, np.ndarray]
    owners: dict[int, list[list[str]]]
    shortest: int

    @staticmethod
    def of(items: list[tuple[object, bytes]], window: int) -> Phrases:
        vocabulary: dict[bytes, int] = {}
        held: dict[tuple[int, ...], list[str]] = {}
        for item, text in items:
            w = [vocabulary.setdefault(x, len(vocabulary) + 1) for x in words_of(text)]
            n = min(window, len(w))
            for i in range(len(w) - n + 1 if n else 0):
                own = held.setdefault(tuple(w[i : i + n]), [])
                if item is not None and str(item) not in own[-1:]:
                    own.append(str(item))
        by_length: dict[int, np.ndarray] = {}
        owners: dict[int, list[list[str]]] = {}
        for n in sorted({len(k) for k in held}):
            keys = [k for k in held if len(k) == n]
            by_length[n] = np.array(keys, np.int64)
            owners[n] = [held[k] for k in keys]
        return Phrases(vocabulary, by_length, owners, min(by_length, default=0))


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector for each binary digit, from the highest."""

    def __init__(self, seq: np.ndarray, sigma: int) -> None:
        self.levels = max(1, int(sigma - 1).bit_length())
        self.n = len(seq)
        self.packed, self.before, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level & 1).astype(bool)
            padded = np.zeros(-(-(self.n + 1) // 64) * 64, bool)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.packed.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
            self.zeros.append(int(self.n - bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def _ones(self, depth: int, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[depth][at] + np.bitwise_count(self.packed[depth][at] & low)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i."""
        start = np.zeros_like(i)
        for depth in range(self.levels):
            one = (symbol >> (self.levels - 1 - depth) & 1).astype(bool)
            a, b = self._ones(depth, start), self._ones(depth, i)
            start = np.where(one, self.zeros[depth] + a, start - a)
            i = np.where(one, self.zeros[depth] + b, i - b)
        return i - start


class FMIndex:
    """Over a sequence of symbols where each 0 is a separator unlike any other; it begins and ends with one."""

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = 16) -> None:
        n = len(seq)
        self.n = n
        order = self._suffixes(seq)
        before = seq[order - 1]  # the first suffix is preceded by the last separator
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))]).astype(np.int64)
        self.bwt = WaveletMatrix(before, sigma)
        self.symbol = before
        # Positions at the start of a run are always sampled, so walking back never meets a separator.
        kept = (order % sample == 0) | (before == 0)
        self.sampled = np.where(kept, order, -1)

    @staticmethod
    def _suffixes(seq: np.ndarray) -> np.ndarray:
        n = len(seq)
        gaps = np.flatnonzero(seq == 0)
        rank = seq + len(gaps)
        rank[gaps] = np.arange(len(gaps))
        step = 1
        while True:
            key = rank * (int(rank.max()) + 2)
            key[:-step] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            new = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1:
                return order
            step *= 2

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of the suffixes that begin with each phrase (all of one length)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for c in phrases.T[::-1]:
            low = self.counts[c] + self.bwt.rank(c, low)
            high = self.counts[c] + self.bwt.rank(c, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions of the suffixes in these rows."""
        at, walked, out = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        left = np.arange(len(rows))
        while len(left):
            found = self.sampled[at[left]]
            done = found >= 0
            out[left[done]] = found[done] + walked[left[done]]
            left = left[~done]
            c = self.symbol[at[left]]
            at[left] = self.counts[c] + self.bwt.rank(c, at[left])
            walked[left] += 1
        return out


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching intervals as one."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]]) if len(start) else np.empty(0, bool)
    last = np.concatenate([new[1:], [True]]) if len(start) else new
    return start[new], end[last]


Found = tuple[int, list[tuple[int, int]], list[str]]


def search_shard(texts: list[bytes], phrases: Phrases, sample: int = 16, most: int = 1 << 21) -> list[Found]:
    """For each text: its number of words, the spans of words that benchmark windows cover, and the items found.

    Texts are indexed together until their kept words reach ``most``.
    """
    out: list[Found] = []
    kept: list[np.ndarray] = []
    where: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    size = 0
    for k, text in enumerate(texts):
        words = words_of(text)
        out.append((len(words), [], []))
        ids = np.fromiter(map(phrases.vocabulary.get, words, repeat(0)), np.int64, len(words))
        inside = np.concatenate([[False], ids > 0, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = edge[::2], edge[1::2]
        long = last - first >= phrases.shortest
        first, last = first[long], last[long]
        if len(first):
            n = int((last - first).sum())
            shift = np.repeat(first - np.concatenate([[0], np.cumsum(last - first)[:-1]]), last - first)
            at = np.arange(n) + shift
            gap = np.cumsum(last - first)
            kept.append(np.insert(ids[at], gap, 0))
            where.append(np.insert(at, gap, -1))
            owner.append(np.full(n + len(first), k, np.int64))
            size += n + len(first)
        if size > most or k == len(texts) - 1:
            if size:
                _search(np.concatenate(kept), np.concatenate(where), np.concatenate(owner), phrases, sample, out)
            kept, where, owner, size = [], [], [], 0
    return out


def _search(seq: np.ndarray, where: np.ndarray, owner: np.ndarray, phrases: Phrases, sample: int, out: list[Found]) -> None:
    seq = np.concatenate([[0], seq])  # it begins with a separator, and ends with one already
    index = FMIndex(seq, len(phrases.vocabulary) + 1, sample)
    docs, starts, ends, ids, lengths = [], [], [], [], []
    for n, rows in phrases.by_length.items():
        for part in range(0, len(rows), 1 << 16):
            low, high = index.search(rows[part : part + (1 << 16)])
            hits = high - low
            which = np.repeat(np.arange(len(low)), hits)
            at = np.arange(int(hits.sum())) + np.repeat(low - np.concatenate([[0], np.cumsum(hits)[:-1]]), hits)
            place = index.locate(at) - 1
            docs.append(owner[place])
            starts.append(where[place])
            ends.append(where[place] + n)
            ids.append(which + part)
            lengths.append(np.full(len(which), n))
    doc, start, end, which, length = (np.concatenate(c) for c in (docs, starts, ends, ids, lengths))
    order = np.argsort(doc, kind="stable")
    doc, start, end, which, length = (c[order] for c in (doc, start, end, which, length))
    cut = np.flatnonzero(np.diff(doc)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(doc)], strict=True):
        if a == b:
            continue
        s, e = _merged(start[a:b], end[a:b])
        items = {x for n, w in set(zip(length[a:b].tolist(), which[a:b].tolist(), strict=True)) for x in phrases.owners[n][w]}
        k = int(doc[a])
        out[k] = out[k][0], list(zip(s.tolist(), e.tolist(), strict=True)), sorted(items)


SPANS = "array<struct<start:long,end:long>>"


def _blocks(benchmark: DataFrame, size: int) -> Iterator[list[tuple[object, bytes]]]:
    """The items in blocks of about ``size`` bytes of text."""
    held, n = [], 0
    for r in benchmark.select(benchmark["item_id"], benchmark["text"]).toLocalIterator():
        held.append((r[0], (r[1] or "").encode()))
        n += len(held[-1][1]) + 100
        if n > size:
            yield held
            held, n = [], 0
    if held:
        yield held


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with n_words, hit_spans and hit_items: where windows of benchmark items occur.

    A window is ``window`` consecutive words of an item, or all words of a
    shorter one. hit_spans are the merged ranges of word numbers that
    occurrences cover; hit_items the sorted ids, as strings, of the items found
    (an item without an id is found, but not listed). The benchmark is read in
    blocks of ``block_bytes``: one block at a time is on the driver, is sent to
    the executors and passes over the documents; before the next one comes, what
    it found is written to the shared folder and it is freed. Null text has no
    words. Columns named n_words, hit_spans or hit_items are replaced; repeated
    rows and all other columns stay as they are; an empty table gives an empty
    result, an empty benchmark no hits.
    """
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    out = docs.withColumns({"n_words": F.lit(None).cast("long"), "hit_spans": F.lit(None).cast(SPANS), "hit_items": F.lit(None).cast("array<string>")})
    blocks = _blocks(benchmark, block_bytes)
    items, shared, path = next(blocks, []), None, None
    while items is not None:
        if shared is not None:  # another block follows: the passes so far end here
            (out, done), before = stage_table(out, "contamination"), path
            shared.unpersist()
            if before:
                drop_table(spark, before)
            path = done
        shared = spark.sparkContext.broadcast(Phrases.of(items, window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for group in _grouped(batches):
                found = search_shard([t or b"" for b in group for t in b.column("text").cast(pa.binary()).to_pylist()], shared.value)
                at = 0
                for b in group:
                    own = found[at : at + b.num_rows]
                    at += b.num_rows
                    yield _with_found(b, own)

        out = out.mapInArrow(tidy(run), out.schema)
        items = next(blocks, None)
    return out


def _grouped(batches: Iterator[pa.RecordBatch], size: int = 24 << 20) -> Iterator[list[pa.RecordBatch]]:
    """Batches that make one shard's index, of about ``size`` bytes."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.nbytes
        if n > size:
            yield held
            held, n = [], 0
    if held:
        yield held


def _with_found(batch: pa.RecordBatch, found: list[Found]) -> pa.RecordBatch:
    spans_before, items_before = batch.column("hit_spans").to_pylist(), batch.column("hit_items").to_pylist()
    spans, items = [], []
    for (_, own, ids), s, i in zip(found, spans_before, items_before, strict=True):
        if s:
            a, b = np.array([*own, *((x["start"], x["end"]) for x in s)]).T
            own = list(zip(*(c.tolist() for c in _merged(a, b)), strict=True))
        spans.append([{"start": a, "end": b} for a, b in own])
        items.append(sorted({*ids, *i}) if i else ids)
    new = {
        "n_words": pa.array([n for n, _, _ in found], pa.int64()),
        "hit_spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        "hit_items": pa.array(items, pa.list_(pa.string())),
    }
    names = batch.schema.names
    return pa.RecordBatch.from_arrays([new.get(n, c) for n, c in zip(names, batch.columns, strict=True)], names)


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words in the spans and what stands between them; one space joins the rest."""
    first, last = word_bounds(text)
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : first[a]])
        at = int(last[b - 1])
    return b" ".join(x for x in (p.strip(b" ") for p in (*out, text[at:])) if x)


def without_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` with the spans that find_contamination reports cut out of their texts, and n_chars, if there, counted anew.

    Documents without a hit stay as they are, null and empty texts among them;
    those of which no word is left go. Repeated rows and columns of any other
    name stay as they are; an empty table gives an empty result.
    """
    columns = docs.columns
    # Columns of these names, if there are any, step aside and come back.
    own = {c: free_name(docs, f"own_{c}") for c in columns if c.lower() in ("n_words", "hit_spans", "hit_items")}
    found = find_contamination(docs.withColumnsRenamed(own), benchmark, window).where("n_words = 0 or size(hit_spans) = 0 or aggregate(hit_spans, 0L, (a, x) -> a + x.end - x.start) < n_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column("hit_spans").to_pylist()
            if any(spans):
                text = b.column("text").to_pylist()
                for i, s in enumerate(spans):
                    if s:
                        text[i] = cut_spans(text[i].encode(), [(x["start"], x["end"]) for x in s]).decode()
                b = b.set_column(b.schema.get_field_index("text"), "text", pa.array(text, pa.string()))
            yield b.select([own.get(c, c) for c in columns]).rename_columns(columns)

    out = found.mapInArrow(tidy(run), T.StructType([docs.schema[c] for c in columns]))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out
