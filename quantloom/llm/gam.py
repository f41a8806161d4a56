"""Quality classifier: a generalised additive model with pairwise interactions.

Each text gives a few numbers; each number falls in a bin. The model is a sum
of lookup tables, one for each number and one for each of a few pairs, learned
by cyclic boosting: in turn, every table gets a small step of a shallow tree
fitted to what all tables together still miss. Scoring adds the tables' entries
for a whole batch at once.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.columns import texts, tidy
from quantloom.shared import bound_arrow_batches

_SYMBOLS = list(b"#*$%&|<>")
_STOPS = list(b".,;:?")
_BLANKS = [32, *range(9, 14)]

NAMES = ("words", "word_length", "long_words", "symbols", "stops", "bangs", "capitals", "digits", "wide", "distinct", "distinct_threes", "same_as_next", "dup_lines", "words_a_line")


def text_numbers(text: bytes) -> tuple[float, ...]:
    """The model's inputs, in the order of NAMES; all 0 for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(NAMES)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = len(text) - int(seen[_BLANKS].sum())
    threes = set(zip(words, words[1:], words[2:], strict=False))
    lines = [x for x in text.split(b"\n") if not x.isspace() and x]
    return (
        float(np.log1p(n)),
        chars / n,
        sum(map((12).__lt__, map(len, words))) / n,
        int(seen[_SYMBOLS].sum()) / n,
        int(seen[_STOPS].sum()) / n,
        int(seen[33]) / n,
        int(seen[65:91].sum()) / chars,
        int(seen[48:58].sum()) / chars,
        int(seen[128:].sum()) / chars,
        len(set(words)) / n,
        len(threes) / max(1, n - 2),
        sum(map(operator.eq, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
    )


@dataclass
class Model:
    """score = sigmoid(base + tables[f][bin of f] + pairs[(f, g)][bin of f, bin of g])."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[b[f]]
        for (f, g), table in self.pairs.items():
            total += table[b[f], b[g]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _step(g: np.ndarray, h: np.ndarray, leaves: int, damp: float) -> np.ndarray:
    """A tree over ordered bins: ``leaves`` intervals, each with its Newton step."""
    cuts = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + damp)
    for _ in range(leaves - 1):
        best, at = 1e-12, None
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                k = np.arange(a + 1, b)
                gain = worth(a, k) + worth(k, b) - worth(a, b)
                if gain.max() > best:
                    best, at = gain.max(), int(k[gain.argmax()])
        if at is None:
            break
        cuts = sorted([*cuts, at])
    out = np.empty(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + damp)
    return out


def _pair_step(g: np.ndarray, h: np.ndarray, damp: float) -> tuple[np.ndarray, float]:
    """The best cut of the plane of bins to four quadrants, and its gain."""
    cg, ch = (np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for m in (g, h))
    i, j = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None, :]

    def parts(c: np.ndarray) -> list[np.ndarray]:
        top, left = c[i, -1] + 0 * c[i, j], c[-1, j] + 0 * c[i, j]
        corner = c[i, j]
        return [corner, top - corner, left - corner, c[-1, -1] - top - left + corner]

    gs, hs = parts(cg), parts(ch)
    gain = sum(a * a / (b + damp) for a, b in zip(gs, hs, strict=True))
    a, b = np.unravel_index(int(gain.argmax()), gain.shape)
    values = [float(x[a, b] / (y[a, b] + damp)) for x, y in zip(gs, hs, strict=True)]
    out = np.empty(g.shape)
    out[: a + 1, : b + 1], out[: a + 1, b + 1 :], out[a + 1 :, : b + 1], out[a + 1 :, b + 1 :] = values
    return out, float(gain[a, b] - cg[-1, -1] ** 2 / (ch[-1, -1] + damp))


def fit_model(x: np.ndarray, y: np.ndarray, bins: int = 64, rounds: int = 120, pairs: int = 4, pair_rounds: int = 60, rate: float = 0.15, leaves: int = 3, damp: float = 2.0) -> Model:
    """Boost the single tables first, then the pairs that explain most of what is left.

    Without rows of both kinds the model is constant: the share of label 1, or 0.5.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    for f in range(x.shape[1]):
        model.edges.append(np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")))
        model.tables.append(np.zeros(len(model.edges[f]) + 1))
    at = model.bins(x)
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, b in enumerate(at):
            g, h = slopes()
            n = len(model.tables[f])
            step = rate * _step(np.bincount(b, g, n), np.bincount(b, h, n), leaves, damp)
            model.tables[f] += step
            total += step[b]

    def plane(f: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        shape = len(model.tables[f]), len(model.tables[k])
        flat = at[f] * shape[1] + at[k]
        return tuple(np.bincount(flat, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    wide = [f for f in range(len(at)) if len(model.tables[f]) > 1]
    ranked = sorted(((_pair_step(*plane(f, k), damp)[1], f, k) for i, f in enumerate(wide) for k in wide[i + 1 :]), reverse=True)
    for _, f, k in ranked[:pairs]:
        model.pairs[f, k] = np.zeros((len(model.tables[f]), len(model.tables[k])))
    for _ in range(pair_rounds):
        for (f, k), table in model.pairs.items():
            step = rate * _pair_step(*plane(f, k), damp)[0]
            table += step
            total += step[at[f], at[k]]
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the id as text is a multiple of 5 (a null id is none)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> Model:
    """A model from at most ``max_labelled`` labelled rows that are not held out.

    Inputs are numbers of the text alone. Rows without a label of 0 or 1 or
    without an id teach nothing.
    """
    own = labels.where(labels["doc_id"].isNotNull() & labels["quality"].isin(0, 1) & ~held_out(labels["doc_id"]))
    sample = own.select("doc_id", "quality").distinct().orderBy(F.xxhash64("doc_id", F.lit(23)), "doc_id", "quality").limit(max_labelled)
    # At most max_labelled rows of two numbers: a fixed bound, so it is broadcast.
    chosen = docs.select(docs["doc_id"], docs["text"]).join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")
    bound_arrow_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [list(text_numbers(t)) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality").cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    got = chosen.mapInArrow(tidy(rows), "doc_id long, quality int, x array<double>").collect()
    got.sort(key=lambda r: (r.doc_id, r.quality, r.x))
    return fit_model(np.array([r.x for r in got]).reshape(len(got), len(NAMES)), np.array([r.quality for r in got], float))


def score_documents(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` from 0 to 1, higher where label 1 is likelier; it replaces one of that name.

    Null text counts as empty, and empty texts get a score too. Repeated rows
    and other columns stay as they are; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    docs = docs.drop(name)
    shared = spark.sparkContext.broadcast(model)  # some thousand numbers, whatever the input

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([text_numbers(t) for t in texts(b)]).reshape(b.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.score(x), pa.float64())], [*b.schema.names, name])

    return docs.mapInArrow(tidy(rows), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
