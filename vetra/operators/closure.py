"""Summaries that travel along calls until nothing changes."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of our own only where none is set and all tasks run on this machine."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not place and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return place or "/tmp/vetra-checkpoints"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again, so that a loop's plan doesn't grow."""
    path = f"{shared_folder(df.sparkSession)}/vetra-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reach(edges: DataFrame, sources: DataFrame | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """Distinct (src, dst) pairs that paths of one edge or more join; one written table a round.

    There are as many pairs as paths have ends: without ``sources`` up to the
    square of the vertices, so only for graphs known to be small or shallow.
    :func:`summaries` carries facts along calls with one row a function.
    """
    e = cut(edges.select(F.col(src).alias("m"), F.col(dst).alias("dst")).distinct(), "edges")
    start = e.select(F.col("m").alias("src"), "dst")
    if sources is None:
        # paths double in length each round, so a deep graph takes few rounds; a shortest path of more than n edges goes on
        # from a vertex at n exactly, so pairs aren't made again at each vertex between their ends
        known, n = cut(start.withColumn("n", F.lit(1).cast("long")), "reach"), 1
        while True:
            first = known.where(F.col("n") == n).select("src", F.col("dst").alias("m"))
            longer = first.join(known.select(F.col("src").alias("m"), "dst", (F.col("n") + n).alias("n")), "m").select("src", "dst", "n")
            known = cut(known.unionAll(longer).groupBy("src", "dst").agg(F.min("n").alias("n")), "reach")
            if known.where(F.col("n") > n).isEmpty():
                return known.drop("n")
            n *= 2
    start = start.join(sources.select(F.col(src).alias("src")).distinct(), "src", "left_semi")
    known = delta = cut(start, "reach")
    while not delta.isEmpty():
        step = delta.withColumnRenamed("dst", "m").join(e, "m").select("src", "dst").distinct()
        delta = cut(step.join(known, ["src", "dst"], "left_anti"), "delta")
        known = known.unionAll(delta)
    return known


def summaries(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """functions (name, sinks, authorized, is_source) with what their callees add, for names defined once.

    ``sinks`` is a bit set and joins by or; ``authorized`` travels along every
    call, ``is_source`` along calls in return statements only.  The loop is
    monotone, so it ends on cycles too.  Only calls of functions that are known
    count, and only functions at an end of such a call take part in its rounds.
    """
    once = functions.groupBy("name").agg(F.count("*").alias("n"), F.max("sinks").alias("sinks"), F.max("authorized").alias("authorized"), F.max("is_source").alias("is_source")).where("n = 1").drop("n")
    once = cut(once, "summary")
    known = lambda name: once.select(F.col("name").alias(name))
    edges = calls.select(F.col("caller"), F.col("terminal").alias("callee"), "in_return").distinct().join(known("callee"), "callee", "left_semi").join(known("caller"), "caller", "left_semi")
    edges = cut(edges, "calls")
    ends = cut(edges.select(F.col("caller").alias("name")).union(edges.select("callee")).distinct(), "ends")
    state, others = cut(once.join(ends, "name", "left_semi"), "summary"), once.join(ends, "name", "left_anti")
    while True:
        seen = state.select(F.col("name").alias("callee"), F.col("sinks").alias("s"), F.col("authorized").alias("a"), F.col("is_source").alias("t"))
        got = edges.join(seen, "callee").groupBy(F.col("caller").alias("name")).agg(F.bit_or("s").alias("s"), F.max("a").alias("a"), F.max(F.col("t") & F.col("in_return")).alias("t"))
        new = state.join(got, "name", "left").select(
            "name", F.col("sinks").bitwiseOR(F.coalesce("s", F.lit(0))).alias("sinks"), (F.col("authorized") | F.coalesce("a", F.lit(False))).alias("authorized"), (F.col("is_source") | F.coalesce("t", F.lit(False))).alias("is_source"),
            ((F.col("sinks").bitwiseOR(F.coalesce("s", F.lit(0))) != F.col("sinks")) | (~F.col("authorized") & F.coalesce("a", F.lit(False))) | (~F.col("is_source") & F.coalesce("t", F.lit(False)))).alias("moved"),
        )
        new = cut(new, "summary")
        done = new.where("moved").isEmpty()
        state = new.drop("moved")
        if done:
            return state.unionByName(others)


def call_sites(calls: DataFrame, state: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls with their callee's summary, where the callee's name is local to the calling file."""
    local = symbols.where("class = 'local'").select("path", F.col("symbol").alias("terminal")).distinct()
    return calls.join(local, ["path", "terminal"], "left_semi").join(state.withColumnRenamed("name", "terminal"), "terminal")
