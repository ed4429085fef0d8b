"""Connected components of a table of links, by alternating large-star and small-star rounds.

Links stay on the executors. Every round is written to the shared folder, so that its plan does not grow
and lost executors cost one round at most. A node with very many links is one key of a join whose other
side has one row per node; its links are pre-aggregated before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfseek.llm.common import written


def _large_star(links: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest of the node and its neighbours."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them; ``u`` > ``v`` in every link."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    joined = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.union(least.select("u", F.col("m").alias("v")))


def _state(links: DataFrame) -> tuple:
    mixed = F.xxhash64("u", "v")
    row = links.agg(
        F.count(F.lit(1)), F.bit_xor(mixed), F.sum(F.shiftright(mixed, 16)), F.sum(F.shiftright(F.xxhash64("v", "u"), 16))
    )
    return tuple(row.first())


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """(node, component) for every node that occurs in ``links`` (columns a, b: bigint).

    The component is the smallest node reachable. Nodes without a link to another node are left out, and
    links with a null end or to the node itself say nothing.
    """
    ends = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    current = written(ends.where("a <> b and a is not null and b is not null").distinct(), label)
    state = _state(current)
    while True:
        current = written(_small_star(_large_star(current).distinct()).distinct(), label)
        before, state = state, _state(current)
        if before == state:
            break
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
