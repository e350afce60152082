"""Small helpers that the operators share: inputs, sizes, blobs."""

from __future__ import annotations

import os
import re
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Stands for a missing document id inside arrays: larger than any real one.
NO_ID = np.iinfo(np.int64).max


def workers_import(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator needs, whatever else the input has."""
    workers_import(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *(docs[c] for c in more))


def shuffle_width(spark: SparkSession) -> int:
    """The parallelism that the session declares for its shuffles."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def part_of(column: str | Column, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def id_array(column: pa.Array) -> np.ndarray:
    """int64 ids of an Arrow column; a null becomes :data:`NO_ID`."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def id_column(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def binary_column(values: Iterable[bytes]) -> pa.Array:
    return pa.array(list(values), pa.binary())


def ensure_checkpoints(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; one of our own only where it is unset and all tasks run on this machine."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        place = "/tmp/vetra-checkpoints"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(place)
    return place


class _Made(threading.local):
    """Folders of the tables that :func:`written` made and nothing has discarded, in order; each thread, so each run, has its own."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_made = _Made()


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame, written to the shared folder and read again: lost executors lose nothing of it."""
    path = f"{ensure_checkpoints(df.sparkSession)}/vetra-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.paths.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.vetra_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder, wherever the cluster keeps it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _made.paths:
        _made.paths.remove(path)


def discard(*frames: DataFrame) -> None:
    """Removes tables of :func:`written` that nothing will read again."""
    for df in frames:
        delete(df.sparkSession, df.vetra_path)


def tables_made() -> int:
    return len(_made.paths)


def discard_since(spark: SparkSession, mark: int) -> None:
    """Removes the tables made since :func:`tables_made` gave ``mark``; what was computed from them has to be written."""
    for path in _made.paths[mark:]:
        delete(spark, path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if it has at most ``rows`` rows (of fixed width), else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def in_runs(rows: DataFrame, keys: list[str], run: Callable[[tuple, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` over the rows of each key, as applyInArrow does, but with many small keys to one Python call.

    Rows are dealt and sorted by the key; a task holds the rows of one key at a time.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            marks = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            at = 0
            out = []
            for i, mark in enumerate(marks):
                if mark != last:
                    if i > at:
                        held.append(batch.slice(at, i - at))
                    if held:
                        out.append(run(last, pa.Table.from_batches(held)))
                    last, held, at = mark, [], i
            if at < len(marks):
                held.append(batch.slice(at))
            if out:
                yield from pa.concat_tables(out).combine_chunks().to_batches()
        if held:
            yield from run(last, pa.Table.from_batches(held)).to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(go, schema)
