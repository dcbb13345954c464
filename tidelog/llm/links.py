"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.runtime import cut, discard


def _digest(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the smallest node that it reaches.

    Alternating large-star and small-star rounds; each takes the smallest neighbour by a
    partially aggregated minimum and joins it back. Both sides of these joins are written tables, so adaptive
    execution can split a node of any degree over tasks (a minimum computed in the join's own stage would prevent that).
    The rounds end when the edges no longer change. Loops and repeated edges are allowed; null nodes are left out.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = cut(e)
    nodes = e
    mark = _digest(e)
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(first, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = cut(large.distinct())
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a")
        before, e = e, cut(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(small.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        discard(first, large, low, *([before] if before is not nodes else []))
        was, mark = mark, _digest(e)
        if was == mark:
            break
    roots = nodes.select(F.col("b").alias("node")).union(nodes.select("a")).distinct()
    found = roots.join(e.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left")
    out = cut(found.select("node", F.coalesce("root", "node").alias("root")))
    discard(nodes, e)
    return out
