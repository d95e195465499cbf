"""Connected components of links held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut

#: A node with more than this share of all links (and HUB_LEAST of them) is a hub. There are no more than 2 / HUB_SHARE, whatever the number of links.
HUB_SHARE, HUB_LEAST = 1 / 512, 256
#: Tasks that a hub's links are dealt to.
SALTS = 64


def _met(edges: DataFrame, at: str, least: DataFrame, hubs: list[int]) -> DataFrame:
    """edges, and m of the node in column ``at``. least: (node, m). The links of hubs are dealt to many tasks."""
    if not hubs:
        return edges.join(least, F.col(at) == F.col("node"))
    salt: Column = F.when(F.col(at).isin(hubs), F.pmod(F.xxhash64("u", "v"), F.lit(SALTS))).otherwise(0)
    every = F.when(F.col("node").isin(hubs), F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    salted = least.withColumn("other_salt", F.explode(every))
    return edges.withColumn("salt", salt).join(salted, (F.col(at) == F.col("node")) & (F.col("salt") == F.col("other_salt")))


def components(links: DataFrame) -> DataFrame:
    """(a, b) bigint links -> (node, label): the least node of its component, for every node that has a link.

    Alternating large-star and small-star steps: each node's neighbours are re-linked to its least neighbour. Only
    minima are gathered by node, never lists, so a node with very many links is pre-aggregated in each task. Loops and
    repeated links are harmless; no links give no rows. The rounds are about the logarithm of the longest path.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen, total = None, edges.count()
    while True:
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        by_node = cut(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")))
        hub = F.when(F.col("n") > max(HUB_LEAST, int(total * HUB_SHARE)), F.col("node"))
        total, x, y, hubs = by_node.agg(F.coalesce(F.sum("n"), F.lit(0)), F.bit_xor("x"), F.sum(F.pmod(F.xxhash64("x", "node"), F.lit(1 << 30))), F.collect_list(hub)).first()
        if (total, x, y) == seen or not total:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        seen, total = (total, x, y), total // 2
        least = by_node.select("node", F.least("node", "least").alias("m"))
        large = _met(edges, "v", least, hubs).select("u", F.col("m").alias("v")).distinct()
        least = large.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
        small = _met(large, "u", least, hubs)
        linked = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = cut(linked.where("u <> v").distinct())
