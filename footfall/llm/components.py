"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import Scratch

JUMPS = 3


def connected_components(links: DataFrame, scratch: Scratch, jumps: int = JUMPS) -> DataFrame:
    """Label every node of ``links(a, b)`` with the smallest node it can reach: ``node, root``.

    A distributed union-find. In each round every node points at its smallest neighbour or itself, pointers are
    followed ``jumps`` times, and links are rewritten to the nodes pointed at; links inside one set vanish and repeated
    ones collapse. The graph shrinks by a constant factor at least, so the rounds follow the logarithm of its size.
    Every round's tables are written out. No node's neighbours are ever gathered: the smallest one is an aggregate
    with a map-side part, and all joins are plain equi-joins that adaptive execution can split.

    Loops and repeated links are allowed; a link with a null end is no link. No links give an empty result.
    """
    links = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    links = scratch.table(links.distinct(), "links-0")
    labels, level, held = None, 0, ""
    while True:
        level += 1
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
        points = scratch.table(points.select("node", F.least("node", "b").alias("root")), f"points-{level}-0")
        for jump in range(1, jumps + 1):
            further = points.select(F.col("node").alias("root"), F.col("root").alias("further"))
            points = points.join(further, "root").select("node", F.col("further").alias("root"))
            points = scratch.table(points, f"points-{level}-{jump}")
            scratch.drop(f"points-{level}-{jump - 1}")
        last = f"points-{level}-{jumps}"
        if labels is None:
            labels, held = points, last
        else:
            moved = points.select(F.col("node").alias("root"), F.col("root").alias("further"))
            labels = labels.join(moved, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
            labels = scratch.table(labels, f"labels-{level}")
            scratch.drop(held)
            held = f"labels-{level}"
        left = points.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = points.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        links = (
            links.join(left, "a")
            .join(right, "b")
            .filter("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
        links = scratch.table(links, f"links-{level}")
        scratch.drop(f"links-{level - 1}", *([last] if last != held else []))
        if links.isEmpty():
            return labels
