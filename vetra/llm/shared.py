"""Which anchors occur more than once in the corpus, told to every part of it.

Documents are dealt into parts by a hash.  A part posts the distinct hashes of
its anchors, packed per bucket; a bucket answers each part with a bit mask.
What travels is 6 bytes for each distinct anchor of a part and a bit back, a
frequent anchor costs one entry a part (it is counted before the shuffle), and
no task holds more than one part or one bucket.  Both numbers follow
``spark.sql.shuffle.partitions`` and, beyond it, the planner's size of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import shuffle_width

U = np.uint64
#: Parts of the documents for each shuffle partition.
PARTS_PER_PARTITION = 2
#: Bytes of text that a part or bucket should have at most, and bytes of text for one of a file (columns are compressed).
PART_BYTES = 256 << 20
UNPACKED = 4
#: Counts of an anchor in one part stop here; any count that matters (of hot anchors) is lower.
MOST = 65535

POSTS = "bucket int, part int, a binary, b binary, c binary, d binary"
ANSWERS = "part int, bucket int, kind int, a binary, b binary, c binary, d binary"


def width(docs: DataFrame) -> int:
    """Shuffle partitions of the session, or more if the planner's size of the rows asks for more."""
    planned = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    asked = planned * UNPACKED // PART_BYTES if planned < 1 << 55 else 0  # the planner's size of rows it knows nothing about
    return max(shuffle_width(docs.sparkSession), asked)


def in_parts(docs: DataFrame, n: int) -> DataFrame:
    """(part, doc_id, text): rows dealt by a hash of both columns."""
    return docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("part"), "doc_id", "text")


def order_by_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Hashes, made to sort by bucket first: bucket above, other bits below."""
    return ((h >> U(40)) % U(buckets)) << U(32) | (h & U(0xFFFFFFFF))


def blob(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def table_of(schema: str, rows: list[tuple]) -> pa.Table:
    names, kinds = zip(*(f.strip().split() for f in schema.split(",")))
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.Table.from_arrays([pa.array(c, types[k]) for c, k in zip(cols, kinds)], names=list(names))


def cut(keys: np.ndarray, buckets: int) -> Iterable[tuple[int, int, int]]:
    """(bucket, first, last) of keys ordered by :func:`order_by_bucket`."""
    which = keys >> U(32)
    ends = np.searchsorted(which, np.arange(buckets + 1, dtype=U))
    for b in np.flatnonzero(np.diff(ends)).tolist():
        yield b, int(ends[b]), int(ends[b + 1])


def distinct(h: np.ndarray, owner: np.ndarray | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in bucket order and how often each occurs, at most MOST.

    With ``owner`` (a row number for each hash) rows are counted instead.
    """
    keys = order_by_bucket(h, buckets)
    if owner is None:
        keys, n = np.unique(keys, return_counts=True)
        return keys, np.minimum(n, MOST).astype(np.uint16)
    order = np.lexsort((owner, keys))
    keys, owner = keys[order], owner[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    fresh = first.copy()
    fresh[1:] |= owner[1:] != owner[:-1]
    at = np.flatnonzero(first)
    n = np.add.reduceat(fresh.astype(np.int64), at) if len(at) else np.empty(0, np.int64)
    return keys[at], np.minimum(n, MOST).astype(np.uint16)


def post(parts: DataFrame, anchors: Callable[[pa.Table], tuple[np.ndarray, np.ndarray | None]], buckets: int) -> DataFrame:
    def run(key: tuple, group: pa.Table) -> pa.Table:
        part = key[0].as_py()
        keys, n = distinct(*anchors(group), buckets)
        low = keys.astype(np.uint32)
        return table_of(POSTS, [(b, part, blob(low[s:e]), blob(n[s:e]), None, None) for b, s, e in cut(keys, buckets)])

    return parts.groupBy("part").applyInArrow(run, POSTS)


def tell(posts: DataFrame, hot: int, powers: bool = False) -> DataFrame:
    """Masks of shared anchors (``a``) and of those with ``hot`` or more occurrences (``b``).

    With ``powers``, ``c`` has the binary logarithm of each shared anchor's occurrences.
    """

    def run(key: tuple, group: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        lows = [np.frombuffer(x.as_py(), np.uint32) for x in group["a"]]
        counts = np.concatenate([np.frombuffer(x.as_py(), np.uint16) for x in group["b"]]).astype(np.int64)
        _, inverse = np.unique(np.concatenate(lows), return_inverse=True)
        total = np.bincount(inverse, weights=counts)[inverse]
        many, often = total >= 2, total >= hot
        out, at = [], 0
        for part, low in zip(group["part"].to_pylist(), lows):
            s = slice(at, at + len(low))
            out.append((part, bucket, 0, blob(np.packbits(many[s])), blob(np.packbits(often[s])) if often[s].any() else b"", blob(np.log2(total[s][many[s]]).astype(np.uint8)) if powers else None, None))
            at += len(low)
        return table_of(ANSWERS, out)

    return posts.groupBy("bucket").applyInArrow(run, ANSWERS)


def shared_masks(parts: DataFrame, anchors, buckets: int, hot: int = 1 << 62) -> DataFrame:
    return tell(post(parts, anchors, buckets), hot)


def read_masks(h: np.ndarray, owner: np.ndarray | None, buckets: int, masks: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(shared, hot) for every hash of a part, from the masks that the buckets sent it."""
    keys, _ = distinct(h, owner, buckets)
    many, often = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    sent = {b: (x, y) for b, x, y in zip(masks["bucket"].to_pylist(), masks["a"].to_pylist(), masks["b"].to_pylist())}
    for b, s, e in cut(keys, buckets):
        x, y = sent[b]
        many[s:e] = np.unpackbits(np.frombuffer(x, np.uint8), count=e - s).astype(bool)
        if y:
            often[s:e] = np.unpackbits(np.frombuffer(y, np.uint8), count=e - s).astype(bool)
    at = np.searchsorted(keys, order_by_bucket(h, buckets))
    return many[at], often[at]
