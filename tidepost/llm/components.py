"""Connected components of a table of links, in rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidepost.llm.store import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b); the root is one of the component's nodes.

    Each round hooks every node to its least neighbour and renames the links accordingly, which
    removes a share of the nodes (node names are digests, so their order is random). A hook may point at
    a node hooked in the same round; the renamed link then joins the two in a later round. Rounds go on
    until no link is left, however many they take. A node with very many links is folded before the shuffle;
    nothing is gathered.
    """
    links = links.select("a", "b").filter("a <> b")
    steps: list[DataFrame] = []
    while True:
        links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        if links.isEmpty():
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy("a").agg(F.min("b").alias("b"))
                       .select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "hooks")
        steps.append(step)
        to_a = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        to_b = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        links = (links.join(to_a, "a").join(to_b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
                 .filter("a <> b"))
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = steps[0]
    for step in steps[1:]:
        later = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        roots = roots.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return written(roots, "roots")
