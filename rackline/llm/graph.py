"""Connected components of a link table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackline.llm.storage import Workspace


def components(links: DataFrame, work: Workspace) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node reachable.

    Each round lets every node point at its smallest neighbour, shortens the pointers to
    their ends by doubling, and keeps the links between different ends.  At least half of
    the nodes of every part vanish in a round, so the number of rounds is logarithmic,
    also for long chains.  Loops and repeated links do no harm; no links give no rows.
    """
    edges = work.save(_both_ways(links.select("a", "b")), "edges0")
    roots, step = None, 0
    while not edges.isEmpty():
        step += 1
        pointers = edges.groupBy("a").agg(F.min("b").alias("b"))
        pointers = pointers.select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
        pointers = _shortened(work.save(pointers, f"pointers{step}"), work, f"pointers{step}")
        if roots is None:
            roots = pointers
        else:
            ends = pointers.select(F.col("node").alias("root"), F.col("root").alias("end"))
            roots = work.save(
                roots.join(ends, "root", "left").select("node", F.coalesce("end", "root").alias("root")),
                f"roots{step}",
            )
        to_a = pointers.select(F.col("node").alias("a"), F.col("root").alias("x"))
        to_b = pointers.select(F.col("node").alias("b"), F.col("root").alias("y"))
        moved = edges.join(to_a, "a").join(to_b, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        edges = work.save(moved.where("a <> b").distinct(), f"edges{step}")
        work.drop(f"edges{step - 1}")
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return roots


def _both_ways(links: DataFrame) -> DataFrame:
    turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return links.unionByName(turned).where("a <> b").distinct()


def _shortened(pointers: DataFrame, work: Workspace, name: str) -> DataFrame:
    turn = 0
    while True:
        ends = pointers.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("end"))
        moved = pointers.join(ends, "root", "left").select(
            "node", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved")
        )
        turn += 1
        moved = work.save(moved, f"{name}_{turn}")
        pointers = moved.select("node", "root")
        if moved.where("moved").isEmpty():
            return pointers
