"""Connected components by contraction: every node points at its least neighbour, twice; edges move to what their ends point at, until none is left.

Of two linked nodes at least one gives up its place in a round, so the nodes left at least halve, whatever the shape of the links. All steps are joins and
grouped minima over written tables; nothing gathers a node's neighbours or a component, and nodes with a large share of the links are joined apart. No edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridor.llm.common import even_join, written


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long; nulls and loops are left out, repeats and either direction allowed). Returns node, component (its least node) for every linked node."""
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        first = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up")), "ups")
        second = first.select(F.col("node").alias("up"), F.col("up").alias("top"))
        step = written(even_join(first, second, ["up"]).select("node", "top"), "pointers")
        moved = step.select(F.col("node").alias("component"), "top")
        if found is None:
            found = step.select("node", F.col("top").alias("component"))
        else:
            found = written(even_join(found, moved, ["component"], "left").select("node", F.coalesce("top", "component").alias("component")), "components")
        a, b = step.toDF("a", "ta"), step.toDF("b", "tb")
        ends = even_join(written(even_join(edges, a, ["a"]), "ends"), b, ["b"]).where("ta <> tb")
        edges = written(ends.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
    return found if found is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
