"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in links (a, b); component is the least id reachable.

    Union-find by rounds over tables: in each, every id hooks its larger, then its smaller neighbours to the least one it knows. Groups are only aggregated with min, so one with any share of the rows is no burden of one task; the joins have one row a key on one side. Rows with a null are left out, and a = b gives an id that stands alone.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    edges = checkpoint(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    nodes = edges.select(F.col("u").alias("id")).union(edges.select("v")).distinct()
    edges = edges.where("u <> v")
    before = None
    for _ in range(max_rounds):
        # Large star: all larger neighbours of an id go to the least of its neighbourhood.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: an id and its smaller neighbours go to the least of those.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u")
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = checkpoint(small)
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).collect()[0]
        if before == (now["n"], now["h"]):
            break
        before = (now["n"], now["h"])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))
    return nodes.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("component"))
