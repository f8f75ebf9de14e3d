"""Connected components of a graph given by its links, by repeated contraction.

Each round hooks every node to its smallest neighbour, halves the paths twice
and contracts what was joined, until no link is left. Rounds are written to the
shared folder; nothing but a count of links comes to the driver. Both sides of
the joins are plain exchanges, so a node with very many links is split by
adaptive execution, and minima are combined before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import stored


def _ordered(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _follow(labels: DataFrame, parents: DataFrame) -> DataFrame:
    """node, root with each root replaced by its parent, where it has one."""
    up = parents.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
    return labels.join(up, labels["root"] == up["n2"], "left").select("node", F.coalesce("r2", "root").alias("root"))


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """node, root of every node of links(a, b): two nodes are connected if their roots are equal."""
    links = stored(_ordered(links), name)
    found = None
    while found is None or links.count():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), f"{name}-hooks")
        for _ in range(2):
            parents = stored(_follow(parents, parents), f"{name}-roots")
        found = parents if found is None else stored(_follow(found, parents), f"{name}-labels")
        pa, pb = (parents.select(F.col("node").alias(f"n{x}"), F.col("root").alias(f"r{x}")) for x in "ab")
        moved = links.join(pa, F.col("a") == F.col("na")).select("ra", "b").join(pb, F.col("b") == F.col("nb")).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        links = stored(_ordered(moved), name)
    return found
