"""Quality rules: decision lists learned by sequential covering, applied as Spark conditions.

Text statistics are DataFrame expressions. Thresholds come from their quantiles
over labelled rows; labelled rows are counted by the thresholds they pass, and
sequential covering reads only those counts: a rule grows by the condition with
the best information gain until it is pure, loses its last conditions where
that helps on rows kept back, and the rows that it covers are set aside for the
next. The rules come out as one ordered CASE expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.columns import SPACE

#: Counted as symbols.
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body's lambdas read it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _count_of(text: Column, chars: str) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")


def _repeat_words(words: Column, window: int) -> Column:
    """Words in windows found twice or more; texts whose windows all differ need no more than that to be seen.

    Else equal windows meet by sorting their digests, and the words that they cover are counted.
    """

    def meet(a: Column, b: Column, by: int) -> Column:
        """A digest of each element of a with that of b which is ``by`` places on, as far as b goes."""
        n = F.size(b) - by
        return F.zip_with(F.slice(a, 1, n), F.slice(b, by + 1, n), lambda x, y: F.xxhash64(x, y))

    def digests(d: Column, n: int) -> Column:
        """A digest of the n elements from each place on, made of digests of half as many."""
        if n == 1:
            return d
        return _let(digests(d, n // 2), lambda h: meet(h, h, n // 2)) if n % 2 == 0 else meet(digests(d, n - 1), d, n - 1)

    def covered(windows: Column) -> Column:
        def again(s: Column) -> Column:
            near = lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
            return F.filter(F.transform(s, lambda x, k: F.when(F.coalesce(near(x, k), F.lit(False)), x["i"])), lambda i: i.isNotNull())

        placed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        places = F.array_sort(_let(F.array_sort(placed), again))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        step = lambda a, i: F.struct(
            (a["n"] + (i + window - F.greatest(i, a["end"]))).cast("long").alias("n"), (i + window).alias("end")
        )
        found = F.aggregate(places, start, step)["n"]
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(found)

    own = _let(_let(F.transform(words, lambda w: F.xxhash64(w)), lambda d: digests(d, window)), covered)
    return F.when(F.size(words) >= window, own).otherwise(F.lit(0).cast("long"))


def text_statistics(docs: DataFrame, window: int = 8) -> DataFrame:
    """``doc_id`` and the counts that rules are made of; null text has none of anything."""
    text = F.coalesce(docs["text"], F.lit(""))
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.char_length(F.translate(x, _BLANKS, "")) > 0)

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.filter(w, lambda x, i: x == F.coalesce(F.get(w, i - 1), F.lit("")))).cast("long").alias("n_same_as_last"),
            _repeat_words(w, window).alias("n_repeat_words"),
        )

    def line_counts(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    return docs.select(
        docs["doc_id"],
        _let(words, counts).alias("w"),
        _let(lines, line_counts).alias("l"),
        F.char_length(F.translate(text, _BLANKS, "")).cast("long").alias("word_chars"),
        _count_of(text, SYMBOLS).alias("n_symbols"),
        _count_of(text, _CAPITALS).alias("n_capitals"),
        _count_of(text, "!").alias("n_bangs"),
    ).select("doc_id", "w.*", "word_chars", "n_symbols", "l.*", "n_capitals", "n_bangs")


def _rate(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


#: What a rule's conditions compare, by name.
FEATURES: dict[str, Column | Callable[[], Column]] = {
    "words": lambda: F.col("n_words").cast("double"),
    "word_length": lambda: _rate("word_chars", "n_words"),
    "symbol_rate": lambda: _rate("n_symbols", "n_words"),
    "dup_line_rate": lambda: _rate("n_dup_lines", "n_lines"),
    "repeat_rate": lambda: _rate("n_repeat_words", "n_words"),
    "same_as_last_rate": lambda: _rate("n_same_as_last", "n_words"),
    "capital_rate": lambda: _rate("n_capitals", "word_chars"),
    "bang_rate": lambda: _rate("n_bangs", "n_words"),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = FEATURES[self.feature]()
        return x > self.threshold if self.above else x <= self.threshold


Rule = tuple[Condition, ...]


def rule_columns(rules: list[Rule]) -> Column:
    """The number of the first rule that fits, from 1, or 0: one ordered CASE expression."""
    case = None
    for k, rule in enumerate(rules, 1):
        fits = reduce(lambda a, b: a & b, [c.column() for c in rule])
        case = F.when(fits, k) if case is None else case.when(fits, k)
    return F.lit(0) if case is None else case.otherwise(0)


def _gain(p: np.ndarray, n: np.ndarray, p0: float, n0: float) -> np.ndarray:
    """Information gained on the positives by going from (p0, n0) to (p, n)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        got = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
    return np.where(p > 0, got, -np.inf)


#: A condition of counted rows: (feature, above, k) compares with the k-th of the feature's cuts.
Cut = tuple[int, bool, int]


def _fits(bins: np.ndarray, cut: Cut) -> np.ndarray:
    """Which rows pass; ``bins`` says above how many cuts of each feature a row lies."""
    feature, above, k = cut
    return (bins[:, feature] > k) == above


def _best_cuts(bins: np.ndarray, cuts: list[int], bad: np.ndarray, good: np.ndarray) -> list[tuple[float, Cut]]:
    """All conditions that gain on rows of these counts, the best first; of equals the strictest."""
    p0, n0 = bad.sum(), good.sum()
    out: list[tuple[float, int, Cut]] = []
    for feature, n_cuts in enumerate(cuts):
        p, n = (np.cumsum(np.bincount(bins[:, feature], w, n_cuts + 1))[:-1] for w in (bad, good))  # rows not above each cut
        for above, x, y in ((True, p0 - p, n0 - n), (False, p, n)):
            gain = _gain(x, y, p0, n0)
            out += [(float(gain[k]), -k if above else k, (feature, above, int(k))) for k in np.flatnonzero(gain > 1e-9)]
    return [(g, c) for g, _, c in sorted(out, key=lambda x: (-x[0], x[2][0], not x[2][1], x[1]))]


def learn_rules(bins: np.ndarray, cuts: list[int], bad: np.ndarray, good: np.ndarray, held: np.ndarray, purity: float = 0.99, least_bad: int = 5) -> list[list[Cut]]:
    """Sequential covering over counted rows; each rule is a list of conditions.

    ``bins``: above how many of its cuts each feature (second axis) of each row
    lies; ``cuts``: how many each feature has; ``bad`` and ``good``: how many
    labelled rows of each kind a row stands for; ``held``: rows that only
    prune. A rule starts with the condition that gains most, grows until it
    covers no good row, and of its beginnings that cover ``least_bad`` bad rows,
    a share of ``purity`` of all, the one stays that is best on the rows kept
    back, the shortest of equals. Where none passes, the rule's first condition
    is set aside and the next best one starts a rule. The list is complete when
    no first condition is left.
    """
    open_ = np.ones(len(bad), bool)
    rules: list[list[Cut]] = []

    def grown(first: Cut) -> list[Cut]:
        rule, inside = [first], open_ & ~held & _fits(bins, first)
        while bad[inside].sum() and good[inside].sum():
            best = _best_cuts(bins[inside], cuts, bad[inside], good[inside])
            if not best:
                break
            rule.append(best[0][1])
            inside &= _fits(bins, rule[-1])
        return rule

    def passing(rule: list[Cut]) -> list[Cut] | None:
        best: tuple[float, list[Cut]] | None = None
        fits = open_.copy()
        for k, cut in enumerate(rule, 1):
            fits &= _fits(bins, cut)
            p, n = bad[fits].sum(), good[fits].sum()
            if p < least_bad:
                break
            if p >= purity * (p + n):
                out = fits & held
                x, y = bad[out].sum(), good[out].sum()
                worth = (x - y) / (x + y) if x + y else 0.0
                if best is None or worth > best[0]:
                    best = worth, rule[:k]
        return best[1] if best else None

    more = True
    while more:
        more = False
        inside = open_ & ~held
        for _, first in _best_cuts(bins[inside], cuts, bad[inside], good[inside]):
            rule = passing(grown(first))
            if rule:
                rules.append(rule)
                open_ &= ~np.logical_and.reduce([_fits(bins, c) for c in rule])
                more = True
                break
    return rules


def labelled_sample(labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows with a label, the same in each run."""
    own = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", "quality").distinct()
    return own.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "quality").limit(most)


def _bin(name: str, cuts: list[float]) -> Column:
    """How many of the sorted cuts a feature lies above."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda t: F.col(name) > t)).alias(name)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, thresholds: int = 40) -> list[Rule]:
    """Rules that find quality 0, from at most ``max_labelled`` labelled rows; none without rows of both kinds.

    A doc_id with both labels counts as one row of each.
    """
    sample = labelled_sample(labels, max_labelled)
    # 20,000 rows of two numbers at most: a fixed bound, so it is broadcast.
    chosen = docs.select(docs["doc_id"], docs["text"]).join(F.broadcast(sample), "doc_id")
    base = text_statistics(chosen).alias("s").join(F.broadcast(sample), "doc_id")
    names = list(FEATURES)
    table = base.select("doc_id", "quality", *[FEATURES[n]().alias(n) for n in names]).persist()
    try:
        share = [i / thresholds for i in range(1, thresholds)]
        cuts = table.where("quality = 0").agg(*[F.percentile_approx(n, share, 1000).alias(n) for n in names]).first()
        more = table.where("quality = 1").agg(*[F.percentile_approx(n, [*share, 0.99, 0.995, 1.0], 1000).alias(n) for n in names]).first()
        values = {n: sorted({*(cuts[n] or ()), *(more[n] or ())}) for n in names}
        columns = [_bin(n, values[n]) for n in names]
        held = (F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(3)) == 0).alias("held")
        counted = table.select(*columns, held, "quality").groupBy(*names, "held").agg(F.sum(1 - F.col("quality")).alias("bad"), F.sum("quality").alias("good")).orderBy(*names, "held")
        rows = counted.collect()
    finally:
        table.unpersist()
    bad, good = (np.array([r[k] for r in rows], float) for k in ("bad", "good"))
    if not bad.sum() or not good.sum():
        return []
    bins = np.array([[r[n] for n in names] for r in rows], np.int64)
    found = learn_rules(bins, [len(values[n]) for n in names], bad, good, np.array([r["held"] for r in rows]))
    return [tuple(Condition(names[f], above, values[names[f]][k]) for f, above, k in rule) for rule in found]


def judge(docs: DataFrame, rules: list[Rule], min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """doc_id, the statistics, base_failed, rule and kept of every row.

    base_failed: fewer than ``min_words`` words, or more than
    ``max_repeat_percent`` percent of them in repeated windows. rule: the
    first learned rule that fits, or 0. kept: neither. Null and empty texts
    have no words and fail. Repeated rows and null doc_id come back each; an
    empty table gives an empty result; other columns are ignored.
    """
    stats = text_statistics(docs)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("rule", rule_columns(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
