"""Removal of byte strings that stand twice anywhere in the corpus, by a sparse suffix array.

A string of ``length`` bytes that starts at two places is found through the
suffixes that begin at anchors. In every window of ``length`` bytes the smallest
hash of its ``gram``-byte strings picks one position, its anchor (winnowing);
equal windows pick the same one, so they meet at suffixes that share at least
``gram`` bytes, whatever surrounds them. One position in about
(length - gram + 1) / 2 is an anchor.

Anchors whose gram stands nowhere else cannot belong to a repeated window and
are left out. The others go out with the bytes of their windows: range
partitions by the leading bytes of the suffix, with splitters that Spark
samples, so suffixes with equal leading bytes are never apart and no comparison
across a boundary is missed. A bucket is sorted by multikey quicksort, once by the
bytes from the anchor on and once by the bytes before it, backwards. From the
common prefixes of neighbours in both orders, each window is compared exactly:
two are equal if they have the same phase, agree from the anchor to their end
and agree from the anchor back to their beginning.

Whole texts that are equal are one class, compared once; and within a batch,
equal windows go out as one row with all their places. So large groups of
copies and very common passages are collapsed before any shuffle of theirs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.shared import bound_arrow_batches, stage_table

#: Window starts that are hashed at once; positions in such a piece fit in _POSITION bits.
_PIECE = 1 << 20
_POSITION = 24
_LEAD = 16
_ROWS_AT_ONCE = 16_384

_MULTIPLIER = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each position, by doubling of polynomial hashes."""
    total, done, h = None, 0, _BYTES[data]
    step, factor = 1, _MULTIPLIER
    left = gram
    while True:
        if left & step:
            part = h[done:]
            if total is None:
                total = part.copy()
            else:
                n = min(len(total), len(part))
                total = total[:n] * np.uint64(factor) + part[:n]
            done += step
            left -= step
        if not left:
            break
        h = h[:-step] * np.uint64(factor) + h[step:] if len(h) > step else h[:0]
        step, factor = 2 * step, factor * factor % (1 << 64)
    total = total[: max(0, len(data) - gram + 1)]
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xD6E8FEB86659FD93)
    total ^= total >> np.uint64(32)
    return total


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    n = len(a) - width + 1
    span = 1
    while 2 * span <= width:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    return np.minimum(a[:n], a[width - span : width - span + n])


def anchors(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For all windows of all texts: (text, gram hash, anchor, first window, last window), a row for each anchor.

    A long text is hashed in pieces; where an anchor's windows cross from one
    piece to the next, it has a row in each.
    """
    width = length - gram + 1
    pieces = [(k, s) for k, t in enumerate(texts) for s in range(0, len(t) - length + 1, _PIECE)]
    out: list[tuple[np.ndarray, ...]] = []
    at = 0
    while at < len(pieces):
        held, size = [], 0
        while at < len(pieces) and size < _PIECE:
            k, s = pieces[at]
            held.append((k, s, texts[k][s : s + _PIECE + length - 1] if s or len(texts[k]) > _PIECE + length - 1 else texts[k]))
            size += len(held[-1][2])
            at += 1
        h = gram_hashes(np.frombuffer(b"".join(x for _, _, x in held), np.uint8), gram)
        low = np.uint64((1 << _POSITION) - 1)
        best = _sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), width) & low
        begin = np.cumsum([0, *(len(x) for _, _, x in held)])
        starts = np.concatenate([np.arange(b, b + len(x) - length + 1) for b, (_, _, x) in zip(begin, held, strict=False)])
        owner = np.repeat(np.arange(len(held)), [len(x) - length + 1 for _, _, x in held])
        best = best[starts].astype(np.int64)
        new = np.concatenate([[True], (best[1:] != best[:-1]) | (owner[1:] != owner[:-1])])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(best)]]) - 1
        own = owner[first]
        shift = np.array([s for _, s, _ in held], np.int64)[own] - begin[own]
        doc = np.array([k for k, _, _ in held], np.int64)[own]
        p = best[first]
        out.append((doc, h[p], p + shift, starts[first] + shift, starts[last] + shift))
    if not out:
        none = np.empty(0, np.int64)
        return none, none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


# --- a bucket of suffixes --------------------------------------------------


def _words(texts: list[bytes], width: int) -> np.ndarray:
    """The texts, padded with zero bytes, as rows of big-endian 8-byte words."""
    padded = -(-width // 8) * 8
    flat = np.frombuffer(b"".join(t.ljust(padded, b"\0") for t in texts), np.uint8).reshape(len(texts), padded)
    return flat.view(">u8").astype(np.uint64)


def multikey_order(texts: list[bytes], width: int) -> np.ndarray:
    """Positions of the texts (none longer than ``width``) in sorted order, by multikey quicksort on 8-byte words."""
    words = _words(texts, width)
    order = np.arange(len(texts))
    todo = [(0, len(texts), 0)]
    while todo:
        a, b, depth = todo.pop()
        if depth == words.shape[1] or b - a < 2:
            continue
        if b - a <= 48:
            order[a:b] = sorted(order[a:b].tolist(), key=texts.__getitem__)
            continue
        own = order[a:b]
        w = words[own, depth]
        pivot = np.sort(w[:: max(1, len(w) // 31)])[min(len(w), 31) // 2 if len(w) < 31 else len(w[:: max(1, len(w) // 31)]) // 2]
        low, same = w < pivot, w == pivot
        parts = own[low], own[same], own[~(low | same)]
        order[a:b] = np.concatenate(parts)
        i, j = a + len(parts[0]), b - len(parts[2])
        todo += [(a, i, depth), (i, j, depth + 1), (j, b, depth)]
    return order


def common_prefixes(texts: list[bytes], order: np.ndarray, width: int) -> np.ndarray:
    """How many bytes each text in sorted order shares with the one before it; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2 or not width:
        return out
    size = np.array([len(t) for t in texts], np.int64)[order]
    flat = np.frombuffer(b"".join(texts[i].ljust(width, b"\0") for i in order.tolist()), np.uint8).reshape(len(order), width)
    differ = flat[1:] != flat[:-1]
    where = differ.argmax(axis=1)
    where[~differ.any(axis=1)] = width
    out[1:] = np.minimum(where, np.minimum(size[1:], size[:-1]))
    return out


def repeated_phases(contexts: list[bytes], back: np.ndarray, copies: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Which windows of each context stand in another, or in a context with more than one copy.

    A context holds all windows of one anchor, which is ``back`` bytes into it.
    Column t is the window that begins t bytes before the anchor.
    """
    n, most = len(contexts), length - gram
    ahead = [c[b:] for c, b in zip(contexts, back.tolist(), strict=True)]
    behind = [c[:b][::-1] for c, b in zip(contexts, back.tolist(), strict=True)]
    size = np.array([len(c) for c in contexts], np.int64)
    order, order_back = multikey_order(ahead, length), multikey_order(behind, most)
    same, same_back = common_prefixes(ahead, order, length), common_prefixes(behind, order_back, most)
    out = np.zeros((n, most + 1), bool)
    after, before = np.empty(n, np.int64), np.empty(n, np.int64)
    for t in range(most + 1):
        valid = np.flatnonzero((back >= t) & (size - back >= length - t))
        if not len(valid):
            continue
        after[order] = np.cumsum(same < length - t)
        before[order_back] = np.cumsum(same_back < t)
        _, which = np.unique(after[valid] * (n + 1) + before[valid], return_inverse=True)
        out[valid, t] = np.bincount(which, copies[valid])[which] > 1
    return out


def _spans(repeated: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, end) from the anchor, of every run of neighbouring repeated windows."""
    edge = np.diff(np.pad(repeated, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    return row, -(high - 1), length - low


def _bucket(rows: list[tuple], length: int, gram: int) -> pa.RecordBatch:
    """Spans of the rows (context, back, members) of whole groups of leading bytes."""
    contexts = [r[0] for r in rows]
    back = np.array([r[1] for r in rows], np.int64)
    copies = np.array([len(r[2]) for r in rows], np.int64)
    row, low, high = _spans(repeated_phases(contexts, back, copies, length, gram), length)
    doc, nth, start, end = [], [], [], []
    for i, a, b in zip(row.tolist(), low.tolist(), high.tolist(), strict=True):
        for m in rows[i][2]:
            doc.append(m["doc"])
            nth.append(m["nth"])
            start.append(m["pos"] + a)
            end.append(m["pos"] + b)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (doc, nth, start, end)], ["doc", "nth", "start", "end"])


# --- the plan --------------------------------------------------------------

_CONTEXTS = pa.schema(
    [("lead", pa.binary()), ("context", pa.binary()), ("back", pa.int32()), ("members", pa.list_(pa.struct([("doc", pa.int64()), ("nth", pa.int64()), ("pos", pa.int64())])))]
)


def _context_batch(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """The windows' bytes of each anchor; equal ones of the batch as one row."""
    held: dict[tuple[bytes, int], list[dict]] = {}
    for doc, nth, text, own in zip(*(batch.column(c).to_pylist() for c in ("doc", "nth", "text", "own")), strict=True):
        for code in own:
            rest, span = divmod(code, length)
            pos, back = divmod(rest, length)
            first = pos - back
            held.setdefault((text[first : first + span + length], back), []).append({"doc": doc, "nth": nth, "pos": pos})
    cols = [[c[b : b + _LEAD] for c, b in held], [c for c, _ in held], [b for _, b in held], list(held.values())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _CONTEXTS.types, strict=True)], schema=_CONTEXTS)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


_SPANS = "array<struct<start:long,end:long>>"


def repeated_bytes(docs: DataFrame, length: int = 200, gram: int = 64) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept_sha256) of every row; spans are the maximal removed runs of bytes.

    A byte goes if a string of ``length`` bytes that covers it also starts
    elsewhere, in the same or another document; all strings are judged on the
    input. Null text is empty; texts shorter than ``length`` lose nothing.
    Repeated rows are copies of each other. Rows with null or repeated doc_id
    come back each; an empty table gives an empty result; other columns are
    ignored.
    """
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    text = F.coalesce(docs["text"], F.lit(""))
    key = F.coalesce(docs["doc_id"], F.xxhash64(text))
    keyed, _ = stage_table(docs.select("doc_id", key.alias("doc"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha")), "texts")
    # A class of equal texts is named by the smallest key of its rows, and by nth where classes share that.
    first = keyed.groupBy("sha").agg(F.min("doc").alias("doc"), F.count("*").alias("copies"), F.max("n_bytes").alias("size"))
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("sha")) - 1
    classes, _ = stage_table(first.withColumn("nth", nth.cast("long")), "text-classes")

    # The texts go out once, by key: this exchange is used three times below. So each join is on the key
    # alone, and what tells the texts of one key apart is compared afterwards.
    by_key = docs.select(key.alias("doc"), text.alias("text")).repartition("doc")
    named = classes.where(F.col("size") >= length).select(F.col("doc").alias("c_doc"), "nth", F.col("sha").alias("c_sha"))
    chosen = by_key.join(named.hint("shuffle_hash"), F.col("doc") == F.col("c_doc")).where(F.startswith(F.sha2("text", 256), F.col("c_sha")))
    chosen = chosen.select("doc", "nth", F.col("text").cast("binary").alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, h, p, low, high = anchors(b.column("text").to_pylist(), length, gram)
            doc, n = (b.column(c).to_numpy(zero_copy_only=False)[row] for c in ("doc", "nth"))
            code = (p * length + (p - low)) * length + (high - low)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (h.view(np.int64), doc, n, code)], ["h", "doc", "nth", "code"])

    # Counted before the shuffle, and joined so that Spark can split the rows of a very common gram.
    found = chosen.mapInArrow(find, "h long, doc long, nth long, code long")
    common = found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    common = common.repartition("h", F.lit(0))  # so that both sides of the join have an exchange of their own, as a skewed join needs
    again = found.join(common, "h", "left_semi")
    candidates = again.groupBy(F.col("doc").alias("a_doc")).agg(F.collect_list(F.struct("nth", "code")).alias("all"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (_context_batch(b, length) for b in batches)

    own = F.transform(F.filter("all", lambda x: x["nth"] == F.col("nth")), lambda x: x["code"])
    asked = chosen.join(candidates.hint("shuffle_hash"), F.col("doc") == F.col("a_doc")).select("doc", "nth", "text", own.alias("own"))
    suffixes = asked.mapInArrow(contexts, "lead binary, context binary, back int, members array<struct<doc:long,nth:long,pos:long>>")
    buckets = suffixes.repartitionByRange("lead").sortWithinPartitions("lead")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        lead = None
        for b in batches:
            for start, context, back, members in zip(*(b.column(c).to_pylist() for c in ("lead", "context", "back", "members")), strict=True):
                if start != lead and len(held) >= _ROWS_AT_ONCE:
                    yield _bucket(held, length, gram)
                    held = []
                lead = start
                held.append((context, back, members))
        if held:
            yield _bucket(held, length, gram)

    spans = buckets.mapInArrow(compare, "doc long, nth long, start long, end long")
    spans = spans.groupBy(F.col("doc").alias("a_doc")).agg(F.collect_list(F.struct("nth", "start", "end")).alias("all"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            merged = [_merge([(s["start"], s["end"]) for s in own]) for own in b.column("own").to_pylist()]
            kept = []
            for data, own in zip(b.column("text").to_pylist(), merged, strict=True):
                digest, at = hashlib.sha256(), 0
                for x, y in own:
                    digest.update(data[at:x])
                    at = y
                digest.update(data[at:])
                kept.append(digest.hexdigest())
            runs = pa.array([[{"start": x, "end": y} for x, y in own] for own in merged], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("nth"), runs, pa.array(kept, pa.string())], ["doc", "nth", "cut", "kept"])

    mine = F.filter("all", lambda x: x["nth"] == F.col("nth"))
    cuts = chosen.join(spans.hint("shuffle_hash"), F.col("doc") == F.col("a_doc")).select("doc", "nth", "text", mine.alias("own"))
    cuts = cuts.mapInArrow(cut, f"doc long, nth long, cut {_SPANS}, kept string").withColumnsRenamed({"doc": "x_doc", "nth": "x_nth"})
    # A class with copies needs no cut: all of it goes, and rows that repeat one id would cut it twice.
    single = (F.col("doc") == F.col("x_doc")) & (F.col("nth") == F.col("x_nth")) & (F.col("copies") == 1)
    known = classes.join(cuts, single, "left").select("sha", "copies", "cut", "kept")
    joined = keyed.join(known, "sha")
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    removed = F.when(copied, whole).otherwise(F.coalesce("cut", F.array().cast(_SPANS)))
    kept = F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha"))
    out = joined.select("doc_id", "n_bytes", removed.alias("spans"), kept.alias("kept_sha256"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", n_removed.alias("n_removed"), "spans", "kept_sha256")
