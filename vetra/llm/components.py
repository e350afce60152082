"""Connected components of a graph with random vertex names, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of ``edges`` (u, v), labels being vertices.

    Each round hooks a vertex to its smallest neighbour and contracts the graph
    to the hooks.  Names are hashes, so in expectation a constant share of the
    vertices goes in each round.  Rounds are written tables; nothing but the
    number of edges left comes to the driver.
    """
    edges = written(edges.select("u", "v").where("u <> v").distinct(), "edges")
    maps = []
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("label")), "hooks")
        maps.append(hook)
        a = hook.select(F.col("v").alias("u"), F.col("label").alias("a"))
        b = hook.select("v", F.col("label").alias("b"))
        done, edges = edges, written(
            edges.join(a, "u").join(b, "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(),
            "edges",
        )
        discard(done)
    if not maps:
        return edges.select("v", F.col("u").alias("label"))
    out = maps[0]
    for m in maps[1:]:
        step = m.select(F.col("v").alias("label"), F.col("label").alias("next"))
        out = out.join(step, "label", "left").select("v", F.coalesce("next", "label").alias("label"))
    # a hook's label may itself be hooked in the same round
    while True:
        step = out.select(F.col("v").alias("label"), F.col("label").alias("next"))
        out = written(out.join(step, "label", "left").select("v", F.coalesce("next", "label").alias("label"), (F.col("next") != F.col("label")).alias("moved")), "labels")
        moved = out.where("moved").isEmpty()
        out = out.select("v", "label")
        if moved:
            return out
