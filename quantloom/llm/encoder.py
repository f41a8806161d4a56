"""Token ids of texts as the tokenizers library gives them, with a memory for pieces that occur again.

Texts go to the library whole unless the tokenizer's own file says that it cuts
them at white space without looking across it and at each step from a letter to
something else. For such a tokenizer the runs of letters, of white space and of
other characters of many texts are found at once, equal runs are numbered by a
dictionary encoding, and only runs that are not remembered go to the library.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa

# The tokenizer parts for which runs may be encoded by themselves.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_CUTS = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}

_SPACES = b"\t\n\x0b\x0c\r "
_ASCII = bytes(range(128))
#: A-Z lower-cased; in texts whose characters beyond ASCII are all letters of Latin-1, also theirs (the second byte of two).
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A or 0x80 <= b <= 0x9E else b for b in range(256))
_LOWER_ASCII = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Kinds of bytes: 0 white space, 1 letters, 2 others.
_RUNS = bytes(0 if b in _SPACES else 1 if 0x61 <= b <= 0x7A or b >= 0x80 else 2 for b in range(256))
_WORDS = bytes(0 if b in _SPACES else 1 for b in range(256))
_LETTERS = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")
#: An apostrophe before a letter may be cut together with it.
_SUFFIX = re.compile(rb"'[A-Za-z\xc3]")


def _gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices [start, start + length) of ``flat``, one after another."""
    total = int(length.sum())
    shift = start - (np.cumsum(length) - length)
    return flat[np.repeat(shift, length) + np.arange(total)]


def _pieces(found: pa.BinaryArray) -> list[bytes]:
    """The array's values; far cheaper than one Arrow scalar each."""
    _, ends, data = found.buffers()
    raw, at = data.to_pybytes(), np.frombuffer(ends, np.int32, len(found) + 1).tolist()
    return [raw[i:j] for i, j in pairwise(at)]


class Encoder:
    """Encodes as the library does; remembers ids of at most about ``memory`` bytes of runs.

    Runs over ``longest`` bytes are never remembered. When the memory is full,
    the half that was asked for least often goes.
    """

    def __init__(self, path: str, memory: int = 48 << 20, longest: int = 64) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = max(self.tokenizer.get_vocab_size(True), 2)
        self.memory, self.longest = memory, longest
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        self.marks = [t["content"] for t in added]
        special = [(t["id"], t["content"]) for t in added if t["special"] and not t["normalized"]]
        model = spec["model"]
        plain = len(special) == len(added) and model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>"
        self.in_runs = bool(special) and plain and spec["normalizer"] == _NORMALIZER and spec["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [_CUTS, _BYTES]}
        if self.in_runs:
            self.border, self.between = min(special)
            # Runs of lower-case letters pass the normalizer and the cuts unchanged: only the model is left to apply.
            bare = {"type": "Sequence", "pretokenizers": [{"type": "CharDelimiterSplit", "delimiter": " "}, _BYTES]}
            self.bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": bare, "truncation": None, "padding": None}))
            self.is_end = np.zeros(self.size, bool)
            self.is_end[[k for t, k in model["vocab"].items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, int] = {}
        self.flat = np.empty(1 << 16, np.int32)
        self.start, self.length, self.hits = (np.empty(1 << 14, np.int64) for _ in range(3))
        self.used = self.bytes = 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs, one after another, and how many each has."""
        texts = [r.decode() for r in runs]
        n = np.zeros(len(texts), np.int64)
        parts: list[np.ndarray] = []
        letters = [k for k, t in enumerate(texts) if _LETTERS.fullmatch(t)]
        joined = [" ".join([texts[k] for k in letters[i : i + 128]]) for i in range(0, len(letters), 128)]
        for e in self.bare.encode_batch_fast(joined, add_special_tokens=False):
            parts.append(np.array(e.ids, np.int32))
        if letters:
            n[letters] = np.diff(np.flatnonzero(self.is_end[np.concatenate(parts)]), prepend=-1)
        is_letters = np.zeros(len(texts), bool)
        is_letters[letters] = True
        others = np.flatnonzero(~is_letters).tolist()
        joined = [self.between.join([texts[k] for k in others[i : i + 128]]) + self.between for i in range(0, len(others), 128)]
        ids = np.fromiter(chain.from_iterable(self._encode(joined)), np.int32)
        ends = np.flatnonzero(ids == self.border)
        n[others] = np.diff(ends, prepend=-1) - 1
        flat = np.concatenate([*parts, ids[ids != self.border]])
        order = np.array(letters + others, np.int64)
        start = np.empty(len(texts), np.int64)
        start[order] = np.cumsum(n[order]) - n[order]
        return _gather(flat, start, n), n

    def _forget_half(self) -> None:
        runs, total = list(self.known), len(self.known)
        cost = np.fromiter(map(len, runs), np.int64, total) + 4 * self.length[:total] + 150
        order = np.argsort(-self.hits[:total], kind="stable")
        keep = np.sort(order[np.cumsum(cost[order]) <= self.memory // 2])
        self.flat = _gather(self.flat, self.start[keep], self.length[keep])
        self.length = self.length[keep]
        self.start = np.cumsum(self.length) - self.length
        self.hits = np.zeros(len(keep), np.int64)
        self.known = {runs[k]: i for i, k in enumerate(keep.tolist())}
        self.used, self.bytes = len(self.flat), int(cost[keep].sum())

    def _learn(self, runs: list[bytes], ids: np.ndarray, n: np.ndarray) -> None:
        k = len(self.known)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(len(self.flat) // 2, len(ids)), np.int32)])
        while k + len(runs) > len(self.start):
            more = np.empty(max(len(self.start) // 2, len(runs)), np.int64)
            self.start, self.length, self.hits = (np.concatenate([a, more]) for a in (self.start, self.length, self.hits))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[k : k + len(runs)] = self.used + np.cumsum(n) - n
        self.length[k : k + len(runs)] = n
        self.hits[k : k + len(runs)] = 0
        self.known.update(zip(runs, range(k, k + len(runs)), strict=True))
        self.used += len(ids)
        self.bytes += sum(map(len, runs)) + 4 * len(ids) + 150 * len(runs)

    def _distinct(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where in a flat array the ids of distinct runs are: (flat, start, length)."""
        if self.bytes > self.memory:
            self._forget_half()
        number = np.array([*map(self.known.get, runs, repeat(-1))], np.int64)
        new = [k for k in np.flatnonzero(number < 0).tolist() if runs[k][0] not in _SPACES]
        short = [k for k in new if len(runs[k]) <= self.longest]
        if short:
            number[short] = np.arange(len(self.known), len(self.known) + len(short))
            words = [runs[k] for k in short]
            self._learn(words, *self._runs(words))
        known = number >= 0
        self.hits[number[known]] += 1
        start, length = np.zeros(len(runs), np.int64), np.zeros(len(runs), np.int64)
        start[known], length[known] = self.start[number[known]], self.length[number[known]]
        if len(short) == len(new):
            return self.flat, start, length
        long = [k for k in new if len(runs[k]) > self.longest]
        ids, n = self._runs([runs[k] for k in long])
        start[long], length[long] = self.used + np.cumsum(n) - n, n
        return np.concatenate([self.flat[: self.used], ids]), start, length

    def _by_runs(self, texts: list[bytes], kinds: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of lower-cased texts and how many each has; runs are cut where the kind of byte changes."""
        data = b" ".join(texts) + b" "
        kind = np.frombuffer(data.translate(kinds), np.uint8)
        offsets = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(data)]]).astype(np.int32)
        runs = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        flat, start, length = self._distinct(_pieces(runs.dictionary))
        which = runs.indices.to_numpy()
        each = length[which]
        # White space has no ids, so it does not matter to which text the blank between two belongs.
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        first = np.searchsorted(offsets[:-1], np.cumsum(sizes) - sizes)
        before = np.concatenate([[0], np.cumsum(each)])
        return _gather(flat, start[which], each), np.diff(before[first], append=before[-1])

    def _kind(self, text: str) -> int:
        """0: only whole; 1: by words between white space; 2: by runs of letters and others."""
        if not self.in_runs or any(m in text for m in self.marks):
            return 0
        raw = text.encode()
        if not text.isascii():
            beyond = raw.translate(None, _ASCII)
            latin = len(beyond) == 2 * beyond[::2].count(0xC3) and 0x97 not in beyond and 0xB7 not in beyond
            if not latin:
                low = raw.lower().decode()
                return int(unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low))
        return 1 if b"'" in raw and _SUFFIX.search(raw) else 2

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        kinds = [self._kind(t) for t in texts]
        by_kind = [[i for i, k in enumerate(kinds) if k == want] for want in range(3)]
        lengths, start = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        parts: list[np.ndarray] = []
        done = 0
        for rows, table, cuts in ((by_kind[1], _LOWER_ASCII, _WORDS), (by_kind[2], _LOWER, _RUNS)):
            # Few bytes at a time: offsets are 32 bits wide.
            for some in _parts(rows, texts, 2 << 20):
                ids, n = self._by_runs([texts[i].encode().translate(table) for i in some], cuts)
                start[some], lengths[some] = done + np.cumsum(n) - n, n
                parts.append(ids)
                done += len(ids)
        for some in _parts(by_kind[0], texts, 1 << 20):
            found = self._encode([texts[i] for i in some])
            n = np.fromiter(map(len, found), np.int64, len(found))
            parts.append(np.fromiter(chain.from_iterable(found), np.int32, int(n.sum())))
            start[some], lengths[some] = done + np.cumsum(n) - n, n
            done += len(parts[-1])
        if not parts:
            return np.empty(0, np.int32), lengths
        return (parts[0] if len(parts) == 1 else _gather(np.concatenate(parts), start, lengths)), lengths


def _parts(rows: list[int], texts: list[str], size: int) -> list[list[int]]:
    """``rows`` in groups of about ``size`` characters; a longer text is a group of its own."""
    out: list[list[int]] = []
    held = 0
    for i in rows:
        if not out or held + len(texts[i]) > size:
            out.append([])
            held = 0
        out[-1].append(i)
        held += len(texts[i])
    return out


_loaded: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, memory: int) -> Encoder:
    """The worker's encoder for a file."""
    if (path, memory) not in _loaded:
        _loaded[path, memory] = Encoder(path, memory)
    return _loaded[path, memory]
