"""Connected components of a graph whose links are rows of a DataFrame.

Each round, every node picks its smallest neighbour (itself included) by a
hash that changes from round to round, and the graph is contracted by these
choices: the nodes that remain shrink by a constant factor in expectation,
whatever the shape of the graph.  Sums and distincts combine before they
shuffle; nodes with very many links meet only in joins that Spark can split.
Every round is written to the shared folder, so that lost executors cost one
round at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, discard


def local_components(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n indices over the pairs (p, q)."""
    lab = np.arange(n)
    while True:
        before = lab.copy()
        np.minimum.at(lab, p, lab[q])
        np.minimum.at(lab, q, lab[p])
        lab = lab[lab]
        if (lab == before).all():
            return lab


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of a link, and the smallest node that it reaches.

    Links may repeat and come in either or both directions; links with a null
    end and loops say nothing and are left out.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    first, chosen, n = edges, [], 0
    while not edges.isEmpty():
        n += 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(n), c).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        both = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))))
        best = both.groupBy("node").agg(F.min(rank("other")).alias("m"))
        step = cut(best.select("node", F.least(F.col("m"), rank("node"))["v"].alias("to")))
        chosen.append(step)
        left = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").select("ta", "b")
        left = left.join(step.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b").where("ta <> tb")
        after = cut(left.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        if edges is not first:
            discard(edges)
        edges = after
    if not chosen:
        return first.select(F.col("a").alias("node"), F.col("a").alias("component"))
    top = chosen[0]
    for step in chosen[1:]:
        top = top.join(step.select(F.col("node").alias("to"), F.col("to").alias("up")), "to", "left").select("node", F.coalesce("up", "to").alias("to"))
    top = cut(top)
    least = top.groupBy("to").agg(F.min("node").alias("component"))
    return top.join(least, "to").select("node", "component")


def named_components(links: DataFrame, names: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component, name), written to the shared folder: the components of links, and the least name of each.

    names: (node, name).  The least names are written before they are joined,
    so that Spark knows their size: few are broadcast, and a large component's
    rows are split where many aren't.
    """
    joined = cut(components(links, a, b))
    least = cut(joined.join(names, "node").groupBy("component").agg(F.min("name").alias("name")))
    return cut(joined.join(least, "component").select("node", "component", "name"))
