"""Two snapshots of files: changed ranges of lines without a version control's text, and the root that owns a file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

WHOLE = (1 << 63) - 1


def _furthest(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Each x moved on along its diagonal as long as the lines agree."""
    x, moving = x.copy(), np.ones(len(x), bool)
    gap = y - x
    while moving.any():
        at = np.flatnonzero(moving)
        inside = (x[at] < len(a)) & (x[at] + gap[at] < len(b)) & (x[at] >= 0) & (x[at] + gap[at] >= 0)
        same = np.zeros(len(at), bool)
        i = x[at][inside]
        same[inside] = a[i] == b[i + gap[at][inside]]
        x[at[same]] += 1
        moving[at[~same]] = False
    return x


def _meeting(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """A place on a shortest edit script, half of its edits from either end: both searches keep one number for each diagonal."""
    n, m = len(a), len(b)
    ra, rb, delta = a[::-1], b[::-1], n - m
    size = n + m + 3
    ahead, back = np.full(2 * size + 1, -1, np.int64), np.full(2 * size + 1, -1, np.int64)
    ahead[size + 1] = back[size + 1] = 0
    for d in range((n + m + 1) // 2 + 1):
        k = np.arange(-d, d + 1, 2)
        for v, s, t in ((ahead, a, b), (back, ra, rb)):
            down = (k == -d) | ((k != d) & (v[size + k - 1] < v[size + k + 1]))
            x = np.where(down, v[size + k + 1], v[size + k - 1] + 1)
            x = _furthest(s, t, x, x - k)
            v[size + k] = np.where((x <= n) & (x - k <= m), x, -1)  # beyond the edge there is nothing
            other = back if v is ahead else ahead
            mirror = delta - k
            known = np.abs(mirror) <= size - 2
            far = np.full(len(k), -1, np.int64)
            far[known] = other[size + mirror[known]]
            parity = (delta % 2 != 0) if v is ahead else (delta % 2 == 0)
            met = (v[size + k] >= 0) & (far >= 0) & (v[size + k] + far >= n)
            if parity and met.any():
                i = int(np.flatnonzero(met)[0])
                x, y = int(v[size + k[i]]), int(v[size + k[i]] - k[i])
                return (x, y) if v is ahead else (n - x, m - y)
    raise AssertionError("two texts always meet")


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which lines of ``b`` a shortest edit script from ``a`` adds; lines are numbers.

    Divide and conquer around the middle of the script, so space is linear.
    Equal ends and lines that the other side doesn't have at all are settled first.
    """
    out = np.ones(len(b), bool)
    todo = [(np.arange(len(a)), np.arange(len(b)))]
    first = True
    while todo:
        i, j = todo.pop()
        if not len(i) or not len(j):
            continue
        x, y = a[i], b[j]
        short = min(len(i), len(j))
        differs = np.flatnonzero(x[:short] != y[:short])
        head = int(differs[0]) if len(differs) else short
        out[j[:head]] = False
        i, j, x, y = i[head:], j[head:], x[head:], y[head:]
        short = min(len(i), len(j))
        differs = np.flatnonzero(x[::-1][:short] != y[::-1][:short])
        tail = int(differs[0]) if len(differs) else short
        out[j[len(j) - tail :]] = False
        i, j, x, y = i[: len(i) - tail], j[: len(j) - tail], x[: len(x) - tail], y[: len(y) - tail]
        if first:
            keep_i, keep_j = np.isin(x, y), np.isin(y, x)
            i, j, x, y, first = i[keep_i], j[keep_j], x[keep_i], y[keep_j], False
            todo.append((i, j))
            continue
        if not len(i) or not len(j):
            continue
        p, q = _meeting(x, y)
        if (p, q) in ((0, 0), (len(i), len(j))):
            # one edit is left: the longer side's line without a partner
            if len(j) <= len(i):
                out[j] = False
            elif len(i) and len(j) > len(i):
                gone = next((k for k in range(len(i)) if x[k] != y[k]), len(i))
                out[np.delete(j, gone)] = False
            continue
        todo += [(i[:p], j[:q]), (i[p:], j[q:])]
    return out


def runs(marks: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last numbers, from 1, of the runs of true marks."""
    edges = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return (np.flatnonzero(edges == 1) + 1).tolist(), np.flatnonzero(edges == -1).tolist()


def _lines(text: str) -> list[str]:
    """Lines with their breaks; only a line feed is one."""
    *whole, rest = text.split("\n")
    return [x + "\n" for x in whole] + ([rest] if rest else [])


def changed_ranges(files: DataFrame, previous: DataFrame) -> DataFrame:
    """scope (path, start_line, end_line): the lines of (path, content) that a shortest edit script from ``previous`` adds.

    Lines are compared as they are, a missing line break at the end included.
    A file that ``previous`` doesn't have is one whole range, as untracked files
    are; one that only loses lines has none, nor has one that went.  Files meet
    their earlier version by path; each pair is one row of a task.
    """
    both = files.select("path", "content").join(previous.select("path", F.col("content").alias("before")), "path", "left").where("before IS NULL OR content IS DISTINCT FROM before")
    new = both.where("before IS NULL").select("path", F.lit(1).cast("long").alias("start_line"), F.lit(WHOLE).alias("end_line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str, int, int]] = []
            for path, now, then in zip(*(batch.column(k).to_pylist() for k in range(3))):
                known: dict[str, int] = {}
                number = lambda s: np.array([known.setdefault(x, len(known)) for x in _lines(s or "")], np.int64)  # noqa: B023, E731
                a, b = number(then), number(now)
                rows += [(path, s, e) for s, e in zip(*runs(added(a, b)))]
            cols = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["path", "start_line", "end_line"])

    changed = both.where("before IS NOT NULL").mapInArrow(run, "path string, start_line long, end_line long")
    return new.unionByName(changed)


def owned(files: DataFrame, roots: DataFrame) -> DataFrame:
    """``files`` with ``repository``, the deepest of ``roots`` (path) that holds each, and ``inside``, its path there.

    A root is a directory, ``.`` that of the whole; files below none have null in
    both.  Each file asks for its own prefixes, so the join is on equal keys and
    what a file gets is decided by one aggregate that begins in its task; roots
    need not be small.  Repeated files stay repeated.
    """
    files = files.withColumn("vetra_path", T.portable_path(F.col("path")))
    parts = F.split("vetra_path", "/")
    prefixes = F.concat(F.array(F.lit(".")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k - 1), "/")))
    asked = files.select("vetra_path").distinct().select("vetra_path", F.explode(F.array_distinct(F.filter(prefixes, lambda p: p != ""))).alias("prefix"))
    known = roots.select(F.regexp_replace(T.portable_path(F.col("path")), "(?<=.)/+$", "").alias("prefix")).distinct()
    best = asked.join(known, "prefix").groupBy("vetra_path").agg(F.max_by("prefix", F.when(F.col("prefix") == ".", 0).otherwise(F.length("prefix"))).alias("repository"))
    out = files.join(best, "vetra_path", "left")
    inside = F.when(F.col("repository") == ".", F.col("vetra_path")).otherwise(F.expr("substring(vetra_path, length(repository) + 2)"))
    return out.withColumn("inside", inside).drop("vetra_path")


#: Directories that aren't searched for repositories (fixed values).
UNSEARCHED = [".git", ".vetra", "target", "node_modules", "vendor", ".venv", "venv", "dist", "build", ".next"]


def discovered_roots(files: DataFrame, marker: str = ".git", nested: bool = False) -> DataFrame:
    """(path) of the directories that hold a file or directory named ``marker``, ``.`` for the whole's own.

    A repository isn't searched for others, nor are the directories of
    UNSEARCHED (one that is a repository itself counts); with ``nested`` both are.
    """
    parts = F.split(T.portable_path(F.col("path")), "/")
    at = F.array_position(parts, marker)
    head = F.slice(parts, 1, (at - 1).cast("int"))
    roots = files.where(at > 0).select(F.when(at == 1, ".").otherwise(F.array_join(head, "/")).alias("path")).distinct()
    if nested:
        return roots
    above = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    roots = roots.where(~F.arrays_overlap(above, F.array(*(F.lit(x) for x in UNSEARCHED))))
    prefixes = F.concat(F.array(F.lit(".")), F.transform(F.sequence(F.lit(1), F.size(above)), lambda k: F.array_join(F.slice(above, 1, k), "/")))
    asked = roots.where("path <> '.'").select("path", F.explode(F.when(F.size(above) > 0, prefixes).otherwise(F.array(F.lit(".")))).alias("prefix"))
    return roots.join(asked.join(roots.select(F.col("path").alias("prefix")), "prefix").select("path").distinct(), "path", "left_anti")
