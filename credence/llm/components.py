"""Connected components of a graph given as a table of links.

Alternates large-star and small-star steps: each keeps the components and pulls every node towards
the smallest node of its component, in a number of rounds that grows with the logarithm of the
graph. Minima are taken with partial aggregation and joined back, so a node with very many links
does not gather them in one task. Lineage is cut at each round by a reliable checkpoint, and the
driver reads one row of counts a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import checkpointed

MAX_ROUNDS = 60


def _pairs(df: DataFrame, a, b) -> DataFrame:
    return df.select(a.alias("u"), b.alias("v"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return _pairs(both.where("v > u").join(least, "u"), F.col("v"), F.col("m")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = _pairs(links.join(least, "u").where("v <> m"), F.col("v"), F.col("m"))
    return moved.union(_pairs(least, F.col("u"), F.col("m"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links`` (two long columns ``u`` and ``v``): root is the
    smallest node of its component. Self-links and null ends count for nothing."""
    now = checkpointed(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    )
    seen = None
    for _ in range(MAX_ROUNDS):
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        now = checkpointed(_small_star(_large_star(now)))
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
