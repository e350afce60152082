"""Which rows touch a range of lines: a sweep in slices instead of a join of all pairs of a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A slice of a path has 2^SLICE_BITS lines, so at most as many different starts of ranges.
SLICE_BITS = 8


def touching(rows: DataFrame, scope: DataFrame, line: Column, end: Column, key: str = "path") -> DataFrame:
    """The rows whose lines from ``line`` to ``end`` overlap a range of ``scope`` (key, start_line, end_line); each row once.

    A row overlaps a range if the furthest end of all ranges that begin at
    ``end`` or before is ``line`` or more.  That end is the greatest of the
    earlier slices, carried on along the path's slices, and of the starts in the
    row's own slice, which are few.  So the work follows rows plus ranges, a hot
    path is many slices, and rows meet their slice in a plain equi-join.
    Nulls in any of the columns touch nothing.
    """
    of = lambda c: F.shiftright(c, SLICE_BITS)
    ranges = scope.where("start_line IS NOT NULL AND end_line IS NOT NULL").groupBy(key, "start_line").agg(F.max("end_line").alias("far"))
    starts = ranges.groupBy(key, of("start_line").alias("vetra_slice")).agg(F.collect_list(F.struct("start_line", "far")).alias("vetra_here"), F.max("far").alias("vetra_far"))
    rows = rows.withColumns({"vetra_line": line.cast("long"), "vetra_end": end.cast("long")}).withColumn("vetra_slice", of("vetra_end"))
    asked = rows.select(key, "vetra_slice").distinct().select("*", F.lit(None).cast(starts.schema["vetra_here"].dataType).alias("vetra_here"), F.lit(None).cast("long").alias("vetra_far"))
    slices = starts.unionByName(asked).groupBy(key, "vetra_slice").agg(F.first("vetra_here", ignorenulls=True).alias("vetra_here"), F.max("vetra_far").alias("vetra_far"))
    before = F.max("vetra_far").over(W.partitionBy(key).orderBy("vetra_slice").rowsBetween(W.unboundedPreceding, -1))
    slices = slices.select(key, "vetra_slice", "vetra_here", before.alias("vetra_before")).where("vetra_here IS NOT NULL OR vetra_before IS NOT NULL")
    here = F.array_max(F.transform(F.filter("vetra_here", lambda s: s["start_line"] <= F.col("vetra_end")), lambda s: s["far"]))
    joined = rows.join(slices, [key, "vetra_slice"]).where(F.greatest("vetra_before", here) >= F.col("vetra_line"))
    return joined.select(*(c for c in rows.columns if not c.startswith("vetra_")))


def islands(scope: DataFrame, key: str = "path") -> DataFrame:
    """(key, start_line, end_line): the ranges without overlaps; those that overlap or touch are one."""
    ranges = scope.where("start_line <= end_line").groupBy(key, "start_line").agg(F.max("end_line").alias("end_line"))
    ranges = ranges.withColumn("vetra_slice", F.shiftright("start_line", SLICE_BITS))
    ends = ranges.groupBy(key, "vetra_slice").agg(F.max("end_line").alias("far"))
    path = W.partitionBy(key).orderBy("vetra_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(key, "vetra_slice", F.max("far").over(path).alias("vetra_carried"))
    inside = W.partitionBy(key, "vetra_slice").orderBy("start_line")
    reached = F.greatest(F.max("end_line").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.col("vetra_carried"))
    fresh = (reached.isNull() | (F.col("start_line") - 1 > reached)).cast("int")
    marked = ranges.join(carried, [key, "vetra_slice"]).withColumn("vetra_new", fresh)
    # numbers of islands: those begun in earlier slices, and in this one up to here
    begun = marked.groupBy(key, "vetra_slice").agg(F.sum("vetra_new").alias("n"))
    earlier = begun.select(key, "vetra_slice", F.coalesce(F.sum("n").over(path), F.lit(0)).alias("vetra_earlier"))
    numbered = marked.join(earlier, [key, "vetra_slice"]).withColumn("vetra_island", F.col("vetra_earlier") + F.sum("vetra_new").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(key, "vetra_island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")).drop("vetra_island")
