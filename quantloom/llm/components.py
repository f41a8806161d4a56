"""Connected components of a graph of links, without gathering links anywhere.

Alternates the large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014): every step is a grouped minimum and
a join on one key, so the work per round is linear in the links and the number
of rounds is logarithmic in practice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.shared import drop_table, stage_table


def _signature(links: DataFrame) -> tuple[int, int]:
    got = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return int(got[0]), int(got[1] or 0)


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node that it reaches.

    ``links``: columns a and b of one ordered type. Nulls and self links are
    left out; repeated links count once; an empty input gives an empty result.
    Rounds go on until nothing changes, so a long chain only takes more of them.
    """
    spark = links.sparkSession
    now, path = stage_table(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    seen = _signature(now)
    while seen[0]:
        after, after_path = stage_table(_small_star(_large_star(now)), "links")
        drop_table(spark, path)
        now, path, before, seen = after, after_path, seen, _signature(after)
        if seen == before:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
