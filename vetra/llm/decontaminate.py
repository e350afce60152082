"""Benchmark decontamination by winnowed fingerprints."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import rolling as R
from .frames import table, texts, workers_import, written

#: Words of a shared span that is found for sure.
SPAN = 10
#: Words of a fingerprinted gram; the window then has SPAN - GRAM + 1 grams.
GRAM = 5
#: Bytes of benchmark text that go out to the tasks; the fingerprints and
#: windows of a larger benchmark are tables that are joined.
BLOCK_BYTES = 16 << 20

_SPAN = StructType([StructField("start", LongType()), StructField("end", LongType())])
_ADDED = [StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("items", ArrayType(StringType())), StructField("spans", ArrayType(_SPAN))]


def normal_words(data: np.ndarray, offsets: np.ndarray):
    low = R.LOWER[data]
    starts, ends, first = R.words(low, offsets, R.ALNUM_WORDS)
    return low, starts, ends, first


class Index:
    """Fingerprints, windows and their items of one block of the benchmark."""

    def __init__(self, items: list[tuple[str | None, str | None]], span: int, gram: int) -> None:
        self.span, self.gram = span, gram
        self.items = [i for i, _ in items]
        column = pa.array([t for _, t in items], pa.string())
        low, starts, ends, first = normal_words(*R.text_buffers(column))
        hashes = R.byte_ranges(R.byte_prefix(low), starts, ends)
        sums = R.word_prefix(hashes)
        windows: dict[int, list[tuple[int, int, bytes]]] = {}
        prints = []
        for item in range(len(items)):
            a, b = int(first[item]), int(first[item + 1])
            if a == b:
                continue
            size = min(span, b - a)
            at = np.arange(a, b - size + 1)
            for h, i in zip(R.word_ranges(sums, at, at + size).tolist(), at.tolist()):
                windows.setdefault(size, []).append((h, item, b" ".join(low[s:e].tobytes() for s, e in zip(starts[i : i + size], ends[i : i + size]))))
            if size == span:
                g = np.arange(a, b - gram + 1)
                grams = R.word_ranges(sums, g, g + gram)
                prints.append(grams[np.unique(R.sliding_argmin(grams, span - gram + 1))])
        self.prints = np.unique(np.concatenate(prints)) if prints else np.empty(0, R.U)
        self.sizes = {}
        for size, rows in windows.items():
            rows.sort()
            keys = np.array([r[0] for r in rows], R.U)
            self.sizes[size] = (keys, np.array([r[1] for r in rows], np.int64), [r[2] for r in rows])


def _member(sorted_keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_keys, h)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == h


def _scan(index: Index, column: pa.Array):
    """Per row: number of words, starts and ends of hit runs, items."""
    data, offsets = R.text_buffers(column)
    counts, spans, found = [], {}, {}
    for a, b in R.chunks(offsets):
        low, starts, ends, first = normal_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        counts.append(np.diff(first))
        n = len(starts)
        if not n:
            continue
        hashes = R.byte_ranges(R.byte_prefix(low), starts, ends)
        sums = R.word_prefix(hashes)
        limit = np.repeat(first[1:], np.diff(first))  # end of the row of each word
        for size, (keys, owners, forms) in index.sizes.items():
            at = np.arange(max(0, n - size + 1))
            at = at[at + size <= limit[at]]
            if size == index.span and len(at):
                # winnowing: the smallest gram of a window is among the fingerprints of both sides
                g = np.arange(n - index.gram + 1)
                grams = R.word_ranges(sums, g, g + index.gram)
                least = R.sliding_argmin(grams, size - index.gram + 1)
                at = at[_member(index.prints, grams)[least[at]]]
            if not len(at):
                continue
            h = R.word_ranges(sums, at, at + size)
            ok = _member(keys, h)
            for i, k in zip(at[ok].tolist(), h[ok]):
                lo, hi = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
                form = b" ".join(low[s:e].tobytes() for s, e in zip(starts[i : i + size], ends[i : i + size]))
                owner = [int(owners[j]) for j in range(lo, hi) if forms[j] == form]
                if owner:
                    row = int(np.searchsorted(first, i, "right")) - 1
                    spans.setdefault(a + row, []).append((i - int(first[row]), i - int(first[row]) + size))
                    found.setdefault(a + row, set()).update(owner)
    n_words = np.concatenate(counts) if counts else np.empty(0, np.int64)
    return n_words, spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


#: The index of the last benchmark that this worker has scanned with, by the name of its scan.
_last: tuple = (None, None)


def _index(name: str, block: list, span: int, gram: int) -> Index:
    """The index of a block, built once in a worker for all its tasks of one scan."""
    global _last
    if _last[0] != name:
        _last = (name, Index(block, span, gram))
    return _last[1]


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))


def _windows_of(benchmark: DataFrame, span: int, gram: int) -> DataFrame:
    """(item, size, print, words): every window of the benchmark, its fingerprint and its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, size, at, least, low, starts, ends in _runs(batch.column("text"), [], span, gram, whole=True):
                form = b" ".join(low[s:e].tobytes() for s, e in zip(starts[at : at + size], ends[at : at + size]))
                out.append((batch.column("item")[row].as_py(), size, least, form))
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.binary()))], names=["item", "size", "print", "words"])

    return _items(benchmark).mapInArrow(run, "item string, size int, print long, words binary").distinct()


def _runs(column: pa.Array, sizes: list[int], span: int, gram: int, whole: bool = False):
    """(row, size, first word, fingerprint, bytes, word starts, word ends) of windows.

    With ``whole`` the rows are items: all windows of ``span`` words, or the one
    of fewer.  Else all windows of ``span`` and of each of ``sizes``.  The
    fingerprint of a window of ``span`` is its smallest gram, of a shorter one
    its own hash.
    """
    data, offsets = R.text_buffers(column)
    for a, b in R.chunks(offsets):
        low, starts, ends, first = normal_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        if not len(starts):
            continue
        sums = R.word_prefix(R.byte_ranges(R.byte_prefix(low), starts, ends))
        grams = R.word_grams(sums, gram)
        least = grams[R.sliding_argmin(grams, span - gram + 1)] if len(starts) >= span else np.empty(0, R.U)
        for row in range(a, b):
            f, l = int(first[row - a]), int(first[row - a + 1])
            own = {min(span, l - f)} if whole else {span, *sizes}
            for size in sorted(own):
                if not 0 < size <= l - f:
                    continue
                at = np.arange(f, l - size + 1)
                prints = least[at] if size == span else R.word_ranges(sums, at, at + size)
                for i, h in zip(at.tolist(), prints.astype(np.int64).tolist()):
                    yield (row, size, i, h, low, starts, ends) if whole else (row, size, i - f, h)


def _joined(docs: DataFrame, benchmark: DataFrame, span: int, gram: int) -> DataFrame:
    """vetra_row, items, spans (not united) of the rows of ``docs`` (vetra_row, text) with a hit, by joins of fingerprints and then of words."""
    windows = written(_windows_of(benchmark, span, gram), "windows")
    sizes = [r["size"] for r in windows.select("size").distinct().collect() if r["size"] < span]  # at most span - 1 of them
    prints = windows.select("size", "print").distinct()

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("vetra_row").to_numpy()
            found: list[tuple] = []
            for row, size, at, h in _runs(batch.column("text"), sizes, span, gram):
                if found and found[-1][:3] == (row, size, h) and found[-1][4] == at - 1:
                    found[-1] = (row, size, h, found[-1][3], at)
                else:
                    found.append((row, size, h, at, at))
            cols = [np.array(c, np.int64) for c in zip(*found)] if found else [np.empty(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[cols[0]]), pa.array(cols[1].astype(np.int32)), pa.array(cols[2]), pa.array(cols[3]), pa.array(cols[4])], names=["vetra_row", "size", "print", "first", "last"]
            )

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            rows = batch.column("vetra_row").to_pylist()
            asked = batch.column("asked").to_pylist()
            data, offsets = R.text_buffers(batch.column("text"))
            for a, b in R.chunks(offsets):
                low, starts, ends, first = normal_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for row in range(a, b):
                    f = int(first[row - a])
                    for x in asked[row]:
                        for at in range(x["first"], x["last"] + 1):
                            i, j = f + at, f + at + x["size"]
                            out.append((rows[row], x["size"], at, b" ".join(low[s:e].tobytes() for s, e in zip(starts[i:j], ends[i:j]))))
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["vetra_row", "size", "at", "words"])

    met = docs.mapInArrow(fingerprints, "vetra_row long, size int, print long, first long, last long").join(prints, ["size", "print"], "left_semi")
    asked = met.groupBy("vetra_row").agg(F.collect_list(F.struct("size", "first", "last")).alias("asked"))
    seen = docs.join(asked, "vetra_row").mapInArrow(words, "vetra_row long, size int, at long, words binary")
    # a window is one row with all its items, so an occurrence meets one row whatever number of items shares it, and a hot window's occurrences can be split
    held = written(windows.groupBy("size", "words").agg(F.collect_set("item").alias("items")).withColumn("window", F.monotonically_increasing_id()), "held")
    hits = written(seen.join(held.select("size", "words", "window"), ["size", "words"]).select("vetra_row", "at", "size", "window"), "hits")
    span_ = F.struct(F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("end"))
    spans = hits.groupBy("vetra_row").agg(F.array_sort(F.collect_set(span_)).alias("spans"))
    items = hits.select("vetra_row", "window").distinct().join(held.select("window", "items"), "window").groupBy("vetra_row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return spans.join(items, "vetra_row")


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted strings), spans of hit words, for every row.

    A hit word lies in an occurrence of a window of ``span`` consecutive item
    words; an item of fewer words is one window; an item without words, or
    with a null text, has none.  Windows are found by winnowing (the smallest
    of the span - gram + 1 grams of each window is a fingerprint on both
    sides, so no shared window is missed), then compared word by word.  A null
    or empty document has no words.  Items with equal ids count once.  Rows
    with repeated or null doc_id are judged one by one.  A benchmark of
    ``block_bytes`` or less goes out to the scan of the documents as an index;
    of a larger one, fingerprints are joined with those of the documents, then
    the words of windows with a fingerprint in common.
    """
    return marked(texts(docs), benchmark, span, gram, block_bytes).drop("text")


def marked(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) and n_words, n_hit, items, spans; see :func:`contamination`.

    Columns of ``docs`` that have one of these four names give way.
    """
    workers_import(docs.sparkSession)
    docs = docs.drop(*(f.name for f in _ADDED))
    size = benchmark.agg(F.sum(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 32)).first()[0] or 0

    def scan(block):
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(name, block, span, gram)
            for batch in batches:
                n_words, spans, found = _scan(index, batch.column("text"))
                rows = range(batch.num_rows)
                runs = [merged(spans.get(i, [])) for i in rows]
                cols = [
                    pa.array(n_words, pa.int64()),
                    pa.array([sum(e - s for s, e in r) for r in runs], pa.int64()),
                    pa.array([sorted({index.items[k] for k in found.get(i, ()) if index.items[k] is not None}) for i in rows], pa.list_(pa.string())),
                    pa.array([[{"start": s, "end": e} for s, e in r] for r in runs], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, "n_words", "n_hit", "items", "spans"])

        return run

    if size <= block_bytes:
        block = [(r["item"], r["text"]) for r in _items(benchmark).orderBy("item", "text").collect()]
        return docs.mapInArrow(scan(block), StructType([*docs.schema.fields, *_ADDED]))
    theirs = "vetra_row" in docs.columns
    docs = docs.withColumnRenamed("vetra_row", "vetra_theirs") if theirs else docs
    counted = docs.withColumn("vetra_row", F.monotonically_increasing_id()).mapInArrow(scan([]), StructType([*docs.schema.fields, StructField("vetra_row", LongType()), *_ADDED]))
    counted = written(counted.drop("n_hit", "items", "spans"), "numbered")
    found = _joined(counted.select("vetra_row", "text"), benchmark, span, gram)
    united = """aggregate(spans, CAST(array() AS array<struct<start: bigint, end: bigint>>), (a, x) ->
        CASE WHEN size(a) > 0 AND x.start <= element_at(a, -1).end
             THEN concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end))))
             ELSE concat(a, array(x)) END)"""
    found = found.withColumn("spans", F.expr(united))
    out = counted.join(found, "vetra_row", "left")
    spans = F.coalesce("spans", F.expr("CAST(array() AS array<struct<start: bigint, end: bigint>>)"))
    return out.select(
        *(F.col(f.name).alias("vetra_row" if theirs and f.name == "vetra_theirs" else f.name) for f in docs.schema.fields), "n_words", F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), spans.alias("spans"),
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op9_decontaminate": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS ws FROM documents),
b AS (SELECT row_number() OVER () AS rid, CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOW}, '{_WORD}') AS ws FROM benchmark),
dw AS (SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM d),
bw AS (SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM b),
dg AS MATERIALIZED (SELECT rid, pos, list(w) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS g FROM dw),
bg AS (SELECT rid, pos, list(w) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS g FROM bw),
bk AS MATERIALIZED (SELECT DISTINCT item, len(g) AS size, md5(array_to_string(g, ' ')) AS k FROM bg JOIN b ON b.rid = bg.rid WHERE len(g) = 10 OR (len(b.ws) < 10 AND pos = 1)),
sz AS (SELECT DISTINCT size FROM bk),
dk AS MATERIALIZED (SELECT rid, pos, size, md5(array_to_string(g[1:size], ' ')) AS k FROM dg, sz WHERE len(g) >= size),
hit AS (SELECT dk.rid, dk.pos, bk.size, bk.item FROM dk JOIN bk ON bk.size = dk.size AND bk.k = dk.k),
hw AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(pos, pos + size)) AS p FROM (SELECT DISTINCT rid, pos, size FROM hit) x) y GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY rid)
SELECT doc_id, CAST(coalesce(len(ws), 0) AS BIGINT) AS n_words, coalesce(hw.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items, sha256(coalesce(it.s, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hw ON hw.rid = d.rid LEFT JOIN it ON it.rid = d.rid
"""
}
