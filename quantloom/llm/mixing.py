"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source hands out its documents in a shuffled but repeatable order, as
often as the mix may repeat them. A document's virtual finish time is the
number of tokens its source has handed out by its end, divided by the source's
target; the mix is all hand-outs in the order of that time, cut where the total
budget is used up. So at any moment the sources stand in the proportion of
their targets.

No window runs over a whole source. The order is a hash, and the hash's leading
digits cut each source to buckets: tokens are summed inside a bucket, and a
bucket's start comes from the table of the buckets' totals. In the same way the
virtual time is cut to slices, of which only the one where the budget ends is
sorted to its exact end.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from quantloom.llm.columns import WORD, row_of, unpacked
from quantloom.shared import stage_table

#: Hexadecimal digits of the hash that name a bucket, and slices of one unit of virtual time.
BUCKET_DIGITS = 3
SLICES = 4096
#: Slices from this one on, far beyond the targets, are one.
_LAST_SLICE = 2 * SLICES


@dataclass(frozen=True)
class Mix:
    """What is needed to deal out documents: targets by source, starts by bucket, and where the budget ends."""

    targets: DataFrame
    starts: DataFrame
    end: Column
    passes: int


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id and source of ``docs`` with its size and place in the shuffled order; the text breaks ties of doc_id."""
    place = F.md5(F.coalesce(docs["doc_id"].cast("string"), F.lit("")))
    return docs.select(
        docs["doc_id"],
        docs["source"],
        *more,
        size_of(docs["text"]).alias("__size"),
        place.alias("__place"),
        F.md5(F.coalesce(docs["text"], F.lit(""))).alias("__tie"),
    )


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, passes: int) -> DataFrame:
    """(source, rank, source_size, target) from columns source and size.

    Weights repeat over the sources in order of code point, null last. The
    targets share ``share`` times all sizes by weight; a source whose part
    would exceed ``passes`` times its size gets that, and the others share
    the excess by weight.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = totals.select("source", "source_size", rank.alias("rank")).withColumn("weight", weight)
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(passes)))
    # In order of cap / weight, the sources that stop at their cap come first. The level that the
    # rest share rises with each of them and falls when one that could take more is counted in.
    filling = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "rank").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    left = budget - F.coalesce(F.sum("cap").over(filling), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filling), F.lit(0.0))
    filled = ranked.withColumn("level", left / open_weight)
    target = F.least(F.col("cap"), F.max("level").over(everything) * F.col("weight"))
    return filled.select("source", "rank", "source_size", target.alias("target"))


def _timed(keyed: DataFrame, targets: DataFrame, starts: DataFrame) -> DataFrame:
    """``keyed`` with rank, source_size, target and __done: the tokens its source hands out in a pass up to its end."""
    own = targets.select(F.col("source").alias("__source"), F.col("rank").alias("__rank"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    ranked = keyed.join(own, keyed["source"].eqNullSafe(own["__source"])).drop("__source")
    ranked = ranked.withColumn("__bucket", F.substring("__place", 1, BUCKET_DIGITS))
    inside = Window.partitionBy("__rank", "__bucket").orderBy("__place", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    summed = ranked.join(starts.hint("shuffle_hash"), ["__rank", "__bucket"])
    return summed.withColumn("__done", F.col("__start") + F.sum("__size").over(inside))


def _finish(nth: int) -> Column:
    """Virtual finish time in pass nth, from 0; null without a target."""
    return F.try_divide(F.col("__source_size") * F.lit(float(nth)) + F.col("__done"), F.col("__target"))


def _hand_out(nth: int) -> Column:
    """Sorts hand-outs: by virtual time, then source, pass and place."""
    return F.struct(_finish(nth).alias("time"), F.col("__rank").alias("rank"), F.lit(nth).alias("nth"), F.col("__place").alias("place"), F.col("__tie").alias("tie"))


def plan_mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, passes: int = 2) -> tuple[Mix, DataFrame]:
    """The mix, and the documents' (doc_id, source, keys) that it was planned from."""
    keyed, _ = stage_table(_keyed(docs), "mix-sizes")
    targets, _ = stage_table(source_targets(keyed.select("source", F.col("__size").alias("size")), weights, share, passes), "mix-targets")
    ranks = targets.select(F.col("source").alias("__source"), F.col("rank").alias("__rank"))
    sums = (
        keyed.join(ranks, keyed["source"].eqNullSafe(ranks["__source"]))
        .groupBy("__rank", F.substring("__place", 1, BUCKET_DIGITS).alias("__bucket"))
        .agg(F.sum("__size").alias("n"))
    )
    before = Window.partitionBy("__rank").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts, _ = stage_table(sums.select("__rank", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start")), "mix-starts")

    handed, _ = stage_table(
        _timed(keyed, targets, starts)
        .select(F.explode(F.array(*[_hand_out(k) for k in range(passes)])).alias("h"), "__size")
        .where("h.time is not null")
        .withColumn("slice", F.least(F.floor(F.col("h.time") * SLICES), F.lit(_LAST_SLICE))),
        "mix-times",
    )
    end = _end_of_budget(handed, targets.agg(F.sum("target")).first()[0] or 0.0)
    if end is None:  # nothing to hand out, or the budget is never used up
        return Mix(targets, starts, F.lit(None), passes), keyed
    literal = F.struct(*[F.lit(v).alias(k) for k, v in end.asDict().items()])
    return Mix(targets, starts, literal, passes), keyed


def _end_of_budget(handed: DataFrame, budget: float, most_rows: int = 200_000) -> Row | None:
    """The last hand-out that begins within the budget.

    The slice where the budget ends is cut to slices of its own until it has
    ``most_rows`` hand-outs or fewer, or no finer time tells them apart; only those are sorted.
    """
    scale, before, rows = SLICES, 0, handed
    while True:
        counted = rows.groupBy("slice").agg(F.sum("__size").alias("n"), F.count("*").alias("rows"))
        up_to = F.lit(before) + F.sum("n").over(Window.orderBy("slice"))
        last = counted.select("slice", "rows", up_to.alias("up_to"), (up_to - F.col("n")).alias("before")).where(F.col("up_to") >= budget).orderBy("slice").first()
        if last is None:
            return None
        before, rows = last["before"], rows.where(F.col("slice") == last["slice"])
        if last["rows"] <= most_rows or last["slice"] == _LAST_SLICE or scale >= 1 << 48:
            break
        scale *= 4096  # a power of two, so that finer slices lie within coarser ones exactly
        rows = rows.withColumn("slice", F.floor(F.col("h.time") * scale))
    place = Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.select("h", (F.lit(before) + F.coalesce(F.sum("__size").over(place), F.lit(0))).alias("before"))
    return inside.where(F.col("before") < budget).agg(F.max("h")).first()[0]


def deal(keyed: DataFrame, mix: Mix) -> DataFrame:
    """``keyed`` with __passes: the virtual times of the hand-outs that the mix takes of each row."""
    times = F.filter(
        F.array(*[F.when(_hand_out(k) <= mix.end, _finish(k)) for k in range(mix.passes)]),
        lambda t: t.isNotNull(),
    )
    return _timed(keyed, mix.targets, mix.starts).withColumn("__passes", times)


def mixed_sizes(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, passes: int = 2) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row; taken: the tokens the mix takes, repeats counted.

    Null text has size 0; null is a source of its own, the last; rows of size 0
    are taken 0. Repeated rows take their turns one after another. An empty
    table gives an empty result; other columns are ignored.
    """
    mix, keyed = plan_mix(docs, weights, share, passes)
    return deal(keyed, mix).select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.size("__passes") * F.col("__size")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, passes: int = 2, ordered: bool = True) -> DataFrame:
    """The mix itself: a row of ``docs`` for each time it is handed out, in order of virtual time if ``ordered``.

    Rows of null or empty text have size 0 and are never handed out; null is a
    source of its own. Repeated rows take their turns one after another.
    Columns of any name stay as they are; an empty table gives an empty result.
    """
    mix, _ = plan_mix(docs, weights, share, passes)
    # The row itself is one column, so none of its names can clash with those used here.
    out = deal(_keyed(docs, row_of(docs)), mix).select("row", F.explode("__passes").alias("time"), "__rank", "__place", "__tie")
    return unpacked(out.orderBy("time", "__rank", "__place", "__tie") if ordered else out, docs.columns)
