"""Retry budgets, anchored replay windows and time-limited reuse, in batch form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def retry_budget(events: DataFrame, key: str, order: list[str], fingerprint: str, retries: int = 3, no_progress: int = 2) -> DataFrame:
    """attempts, stalled and exhausted of blocked stops: runs of one fingerprint count up."""
    w = W.partitionBy(key).orderBy(*order)
    new = (F.lag(fingerprint).over(w).isNull() | (F.lag(fingerprint).over(w) != F.col(fingerprint))).cast("int")
    runs = events.withColumn("vetra_new", new).withColumn("vetra_run", F.sum("vetra_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    attempts = F.row_number().over(W.partitionBy(key, "vetra_run").orderBy(*order)).cast("long")
    out = runs.withColumn("attempts", attempts).withColumn("stalled", F.col("attempts") - 1).drop("vetra_new", "vetra_run")
    return out.withColumn("exhausted", (F.col("attempts") > max(1, retries)) | (F.col("stalled") >= max(1, no_progress)))


def anchored(events: DataFrame, keys: list[str], at: str, tie: str, window: int) -> DataFrame:
    """recorded: an event is, unless the last recorded one of its keys is less than ``window`` back.

    ``at`` is a number.  The window is measured from the recorded event, which
    no gap to a neighbour tells, so a key's events are walked in order; only
    (keys, at, tie) go through Python.
    """
    schema = events.select(*keys, at, tie).schema.add("recorded", "boolean")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, None
        for pdf in batches:
            out = []
            for *key, t in zip(*(pdf[k].tolist() for k in keys), pdf[at].tolist()):
                new = key != now or t - last >= window
                now, last = key, t if new else last
                out.append(new)
            yield pdf.assign(recorded=out)

    rows = events.select(*keys, at, tie).repartition(*keys).sortWithinPartitions(*keys, at, tie)
    return rows.mapInPandas(walk, schema)


def sticky(events: DataFrame, key: str, order: list[str], value, name: str) -> DataFrame:
    """The last value that wasn't null so far."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return events.withColumn(name, F.last(value, ignorenulls=True).over(w))


def scope_drift(events: DataFrame, scopes: DataFrame, key: str, path: str) -> DataFrame:
    """Events whose path lies in none of their key's declared scopes."""
    e, s = events.alias("e"), scopes.alias("s")
    inside = (F.col("s.scope") == ".") | (F.col(f"e.{path}") == F.col("s.scope")) | F.startswith(f"e.{path}", F.concat(F.col("s.scope"), F.lit("/")))
    return e.join(s, (F.col(f"e.{key}") == F.col(f"s.{key}")) & inside, "left_anti")
