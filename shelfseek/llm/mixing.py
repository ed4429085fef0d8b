"""Mixing sources to target weights under a token budget.

The budget flows down the tree domain - language - source. Each node deals its budget to its children in
proportion to their weights; a child that cannot use its share (its subtree has fewer tokens, counted once
per allowed epoch) gives the rest back to its siblings, and only what no sibling can use goes up to the
parent's siblings. Dealing top-down, with every child capped by the supply of its whole subtree, does this.

A leaf repeats all its documents as often as its budget allows and takes the rest as the shortest prefix of
the next epoch's seeded order that reaches it. The prefix is found without sorting a leaf: the order's
hash is cut into about sqrt(n) ranges, tokens are summed per range, ranges before the boundary are taken
whole and only the documents of the boundary range are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfseek.llm.common import written

KEYS = ["domain", "lang", "source"]
_TOP = 2.0**60


def estimated_tokens(text: Column) -> Column:
    """A token for every four bytes, rounded up; none for a null or empty text."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("bigint")


def _same_keys(rows: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the other side's keys go."""
    named = other.select(*[F.col(c).alias(f"_{c}" if c in keys else c) for c in other.columns])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(named, same, how).drop(*[f"_{k}" for k in keys])


def _deal(children: DataFrame, parent: list[str], key: str) -> DataFrame:
    """Add ``share``: the parent's ``budget`` dealt by ``weight``, none above ``cap``, shortages to siblings.

    In ascending order of cap / weight, the children that fill up are a prefix; the level that the others
    reach is what is left over their weights.
    """
    group = Window.partitionBy(*parent)
    earlier = group.orderBy("_ratio", key).rowsBetween(Window.unboundedPreceding, -1)
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)
    rows = children.withColumn("weight", weight).withColumn(
        "_ratio", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(float("inf"))
    )
    rows = rows.withColumn("_left", F.col("budget") - F.coalesce(F.sum("cap").over(earlier), F.lit(0)))
    rows = rows.withColumn("_weights", F.sum("weight").over(group) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
    level = F.when((F.col("weight") > 0) & (F.col("_weights") > 0), F.greatest(F.col("_left"), F.lit(0)) / F.col("_weights"))
    rows = rows.withColumn("_level", level)
    rows = rows.withColumn("_reached", F.max(F.when(F.col("_ratio") > F.col("_level"), F.col("_level"))).over(group))
    dealt = F.least(F.col("cap").cast("double"), F.coalesce(F.col("_reached"), F.lit(float("inf"))) * F.col("weight"))
    share = F.when(F.col("weight") > 0, dealt).otherwise(0.0)
    return rows.withColumn("share", share).drop(*[c for c in rows.columns if c.startswith("_")])


def leaf_budgets(
    leaves: DataFrame, weights: dict[str, Column], share_of_supply: float | None, tokens: int | None, max_epochs: int
) -> DataFrame:
    """``leaves`` (domain, lang, source, supply, n) with ``budget``: whole tokens for each leaf.

    The total is ``tokens`` or a share of the supply, and at most ``max_epochs`` times the supply. A weight
    is a column over the keys down to its level; null and negative ones count as 0, and such a subtree gets
    nothing.
    """
    capped = leaves.withColumn("cap", F.col("supply") * max_epochs)
    total = F.lit(tokens) if share_of_supply is None else F.floor(F.sum("supply") * share_of_supply)
    above = capped.agg(F.least(F.sum("cap"), total).cast("double").alias("budget"))
    for depth in range(1, len(KEYS) + 1):
        path, parent = KEYS[:depth], KEYS[: depth - 1]
        nodes = capped.groupBy(*path).agg(F.sum("cap").alias("cap"))
        nodes = nodes.withColumn("weight", F.coalesce(weights[path[-1]].cast("double"), F.lit(0.0)))
        if parent:
            nodes = _same_keys(nodes, above, parent)
        else:
            nodes = nodes.join(F.broadcast(above))  # one row
        dealt = _deal(nodes, parent or [F.lit(0)], path[-1])
        above = dealt.select(*path, F.col("share").alias("budget"))
    return _same_keys(leaves, above, KEYS).withColumn("budget", F.round("budget").cast("bigint"))


def _position(seed: int, epoch: Column, doc_id: Column) -> Column:
    """A place in [0, 2**60) from seed, epoch and doc_id."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), epoch, doc_id).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def mix(
    docs: DataFrame,
    weights: dict[str, Column],
    domain: Column,
    share_of_supply: float | None = None,
    tokens: int | None = None,
    max_epochs: int = 1,
    seed: int = 0,
    count: Column | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """The mixture: one row per document and epoch, (doc_id, epoch, domain, lang, source, n_tokens, budget).

    ``docs`` has doc_id, text, lang, source; ``domain`` is a column over them. A null key is a key of its
    own. ``budget`` is that of the row's leaf. ``count`` gives a document's tokens (default: a token for every
    four bytes). Documents without tokens cost nothing: they come with every whole epoch, and with a prefix
    as far as it reaches. Order within an epoch is by seeded hash of the doc_id, ties by doc_id and text;
    rows equal in both are interchangeable. The last document of a prefix may exceed the budget. ``columns``
    are handed through as the struct ``rest``. An empty table gives an empty mixture.
    """
    rest = F.struct(*columns) if columns else F.struct(F.lit(0).alias("_"))
    measured = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), domain.alias("domain"), "lang", "source",
        (estimated_tokens(F.col("text")) if count is None else count).alias("n_tokens"),
        F.xxhash64("text").alias("tie"), rest.alias("rest"),
    )
    leaves = measured.groupBy(*KEYS).agg(F.sum("n_tokens").alias("supply"), F.count(F.lit(1)).alias("n"))
    leaves = written(leaves, "mixing-leaves")
    plan = leaf_budgets(leaves, weights, share_of_supply, tokens, max_epochs)
    whole = F.when(F.col("supply") > 0, F.least(F.floor(F.col("budget") / F.col("supply")), F.lit(max_epochs)))
    plan = plan.withColumn("whole", F.coalesce(whole, F.lit(0)).cast("int"))
    plan = plan.withColumn("part", F.col("budget") - F.col("whole") * F.col("supply"))
    plan = plan.withColumn("ranges", F.ceil(F.sqrt("n")).cast("bigint"))
    plan = written(plan.select(*KEYS, "budget", "whole", "part", "ranges"), "mixing-plan")

    placed = _same_keys(measured, plan, KEYS)
    placed = placed.withColumn("place", _position(seed, F.col("whole"), F.col("doc_id")))
    placed = placed.withColumn("range", (F.col("place") / _TOP * F.col("ranges")).cast("bigint"))
    sums = placed.where("part > 0").groupBy(*KEYS, "range", "part").agg(F.sum("n_tokens").alias("t"))
    leaf = Window.partitionBy(*KEYS)
    reached = F.sum("t").over(leaf.orderBy("range"))
    ends = sums.withColumn("reached", reached).where("reached >= part")
    boundary = ends.groupBy(*KEYS).agg(F.min(F.struct("range", "reached", "t")).alias("b"))
    boundary = boundary.select(*KEYS, F.col("b.range").alias("edge"), (F.col("b.reached") - F.col("b.t")).alias("before"))
    marked = _same_keys(placed, written(boundary, "mixing-boundaries"), KEYS, "left")

    outright = F.col("whole") + F.coalesce((F.col("range") < F.col("edge")).cast("int"), F.lit(0))
    taken = marked.where(outright > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), outright - 1)))
    inner = leaf.orderBy("place", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    edge = marked.where("range = edge").withColumn("sum", F.col("before") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    edge = edge.where("sum < part").withColumn("epoch", F.col("whole"))
    out = ["doc_id", F.col("epoch").cast("int").alias("epoch"), *KEYS, "n_tokens", "budget", *(["rest"] if columns else [])]
    return taken.select(*out).unionByName(edge.select(*out))

