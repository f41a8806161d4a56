"""Text signals: aggregation of scored documents, as-of joins and upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight of each section type in the aggregate; others weigh 1.
SECTION_WEIGHTS = {
    "item_2_02": 1.6,
    "item_7_01": 1.1,
    "item_8_01": 0.7,
    "mda": 1.0,
    "forward_guidance": 1.5,
    "liquidity": 0.9,
    "risk_factors": 0.5,
}


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], left_on: str = "date", right_on: str = "date", tie: Sequence[Column] = ()) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` at or before its date, by ``keys``; null without one.

    Both sides meet in one shuffle by the keys: rows of the right come before
    rows of the left on the same date, and the last of them is carried on as a
    whole, nulls included. Of several on one date the last by ``tie`` wins.
    """
    carried = F.struct(*[F.col(c) for c in columns])
    facts = right.select(*keys, F.col(right_on).alias("__at"), carried.alias("__carried"), F.struct(*tie).alias("__tie") if tie else carried.alias("__tie"), F.lit(0).alias("__side"))
    kind = dict(facts.dtypes)
    whole = F.struct(*[left[c] for c in left.columns])
    asks = left.select(*keys, F.col(left_on).alias("__at"), F.lit(None).cast(kind["__carried"]).alias("__carried"), F.lit(None).cast(kind["__tie"]).alias("__tie"), F.lit(1).alias("__side"), whole.alias("__row"))
    both = facts.withColumn("__row", F.lit(None).cast(dict(asks.dtypes)["__row"])).unionByName(asks)
    w = Window.partitionBy(*keys).orderBy("__at", "__side", F.col("__tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__seen", F.last(F.when(F.col("__side") == 0, F.col("__carried")), ignorenulls=True).over(w))
    return seen.where("__side = 1").select("__row.*", *[F.col("__seen")[c].alias(c) for c in columns])


def load_scores(scores: DataFrame, horizon_bucket: str | None = None) -> DataFrame:
    """Scores of one horizon with a date, a ticker and a score; an error if the horizon has none."""
    out = scores.select(F.to_date("date").alias("date"), F.upper("ticker").alias("ticker"), F.col("llm_score").cast("double"), *[c for c in scores.columns if c not in ("date", "ticker", "llm_score")])
    if horizon_bucket is not None and "horizon_bucket" in out.columns:
        out = out.where(F.lower("horizon_bucket") == horizon_bucket.lower())
        if out.isEmpty():
            raise ValueError(f"no scores for horizon {horizon_bucket}")
    return out.dropna(subset=["date", "ticker", "llm_score"])


def attach_scores(features: DataFrame, scores: DataFrame, columns: Sequence[str] = ("llm_score",)) -> DataFrame:
    """Each feature row with the latest score at or before it: numbers 0 and texts empty without one."""
    out = asof_join(features.drop(*columns), scores, ["ticker"], list(columns))
    kinds = dict(scores.dtypes)
    return out.withColumns({c: F.coalesce(F.col(c), F.lit("") if kinds[c] == "string" else F.lit(0).cast(kinds[c])) for c in columns})


def section_weight(section: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SECTION_WEIGHTS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.coalesce(section, F.lit(""))), F.lit(1.0))


def normalise_scores(scored: DataFrame) -> DataFrame:
    """Scores clamped to their ranges, damped by risk and confidence, with a short summary."""
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("score")))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    risk = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("risk_flag")))
    out = scored.withColumns({"score": score, "confidence": confidence, "risk_flag": risk})
    out = out.withColumn("adjusted_score", F.col("score") * (1 - 0.5 * F.col("risk_flag")))
    out = out.withColumn("effective_score", F.col("adjusted_score") * F.greatest(F.col("confidence"), F.lit(0.05)))
    return out.withColumn("summary", F.left(F.trim("summary"), F.lit(240))) if "summary" in out.columns else out


def aggregate_scores(scored: DataFrame) -> DataFrame:
    """One score for each date, ticker and horizon: the mean weighted by confidence and section, else the plain mean."""
    weight = F.col("confidence") * section_weight(F.col("section_type"))
    mean = F.coalesce(F.try_divide(F.sum(F.col("adjusted_score") * weight), F.when(F.sum(weight) > 0, F.sum(weight))), F.avg("adjusted_score"))
    return scored.groupBy("date", "ticker", "horizon_bucket").agg(
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), mean)).alias("llm_score"),
        F.count_distinct("document_id").alias("document_count"),
        F.count_distinct("section_id").alias("section_count"),
        F.avg("confidence").alias("avg_confidence"),
        F.avg("risk_flag").alias("avg_risk_flag"),
    )


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both, by name; of rows with equal keys the new one, and of several new ones the last by its columns."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rest = [F.col(c).desc_nulls_last() for c in both.columns if c not in (*keys, "__new")]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("__new").desc(), *rest))
    return both.withColumn("__n", nth).where("__n = 1").drop("__n", "__new")
