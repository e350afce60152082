"""Phrases whose words belong together: level-wise counting with hashed buckets (PCY, DHP), then a score for the weakest cut.

The corpus is read once and kept as word codes in chunks.  Pass k counts phrases
of k words exactly, but only those that can be frequent: their bucket was full
when pass k - 1 counted all phrases of k words by a hash, and both phrases of
k - 1 words inside are frequent (Apriori).  Buckets and frequent phrases go out
as bitmaps of fixed size; a wrong bit costs a count, never a result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import shuffle_width, table, texts, workers_import, written

#: Least occurrences of a phrase, and most words.
LEAST = 100
LONGEST = 5
#: A phrase goes if one that holds it has this share of its occurrences, in hundredths.
INSIDE = 100
#: Phrases of each language in the report.
TOP = 2000
UNKNOWN = "und"
#: Codes of one chunk, and the mark between pieces.
CHUNK = 1 << 19
BREAK = -1
#: Buckets of a slice, and the bounds of the number of buckets: a bitmap takes 128 KB to 8 MB, the counts of a task 2 to 128 MB.
SLICE = 1 << 16
LEAST_BUCKETS, MOST_BUCKETS = 1 << 20, 1 << 26
#: Bytes of a packed input for each bucket: some 15 words, so a bucket gets a few dozen phrases at most unless its own are frequent.
BUCKET_BYTES = 64
#: Bytes of phrases and numbers that are broadcast at most.
BROADCAST_BYTES = 8 << 20

U = np.uint64
_HASHED = "array<struct<slice:int,at:binary,n:binary>>"
_COUNTED = f"lang string, phrases array<string>, n array<long>, hashed {_HASHED}"
_MARK = b"\xff"  # in no UTF-8 text
_MARKS = bytes(0xFF if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))


def pieces(text: str | None) -> list[bytes]:
    """The words of a text with _MARK between pieces; A-Z are lowered, other letters stay."""
    raw = (text or "").encode("utf-8", "replace").lower().translate(_MARKS)
    return raw.replace(_MARK, b" \xff ").split()


def word_hashes(lang: str, words: list[str]) -> np.ndarray:
    """One 64-bit hash for each word of a language."""
    head = lang.encode() + b"\x00"
    return np.array([xxhash.xxh64_intdigest(head + w.encode("utf-8", "replace")) for w in words], U)


def longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase and one more word."""
    return h * U(0x9E3779B97F4A7C15) + word


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a hash; ``buckets`` is a power of two."""
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return ((h ^ (h >> U(32))) & U(buckets - 1)).astype(np.int64)


class Buckets:
    """Occurrences by bucket, up to ``most``; what a task has counted goes out in slices."""

    def __init__(self, buckets: int, most: int) -> None:
        self.most = min(most, 65535)
        self.n = np.zeros(buckets, np.uint16)

    def add(self, at: np.ndarray) -> None:
        if len(at):
            found, n = np.unique(at, return_counts=True)
            self.n[found] = np.minimum(self.n[found] + np.minimum(n, self.most), self.most)

    def slices(self) -> list[dict]:
        """The slices with an occurrence: their counts in full (``at`` null), or the places and counts that aren't 0, whichever is shorter."""
        out = []
        for s, part in enumerate(self.n.reshape(-1, SLICE)):
            at = np.flatnonzero(part)
            if len(at):
                sparse = 2 * len(at) < SLICE
                out.append({"slice": s, "at": at.astype(np.uint16).tobytes() if sparse else None, "n": (part[at] if sparse else part).tobytes()})
        return out


def bitmap(hashed: DataFrame, buckets: int, least: int) -> bytes:
    """Bits of the buckets with ``least`` occurrences or more, from rows of slices: at most MOST_BUCKETS / 8 bytes reach the driver.

    A task adds up the slices it is dealt as they come, however many rows a slice has.
    """
    least = min(least, 65535)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, at, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
                sums = total.setdefault(s, np.zeros(SLICE, np.uint16))
                where = slice(None) if at is None else np.frombuffer(at, np.uint16)
                sums[where] = np.minimum(sums[where].astype(np.uint32) + np.frombuffer(n, np.uint16), least)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.packbits(v >= least).tobytes() for v in total.values()], pa.binary())], names=["slice", "bits"])

    rows = hashed.select(F.explode("hashed").alias("s")).select("s.slice", "s.at", "s.n")
    n = min(buckets // SLICE, shuffle_width(hashed.sparkSession))
    out = bytearray(buckets // 8)
    for r in rows.repartition(n, "slice").mapInArrow(run, "slice int, bits binary").collect():
        out[r["slice"] * SLICE // 8 : (r["slice"] + 1) * SLICE // 8] = r["bits"]
    return bytes(out)


def marked(bits: bytes, at: np.ndarray) -> np.ndarray:
    """Whether the bits of the buckets are set."""
    return (np.frombuffer(bits, np.uint8)[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def pairs(codes: np.ndarray) -> np.ndarray:
    """Starts of two words beside each other in a piece."""
    return np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0))


def chunks(docs: DataFrame, buckets: int, least: int) -> DataFrame:
    """lang, phrases (distinct words), n (their occurrences), codes and hashed of parts of the corpus, some CHUNK codes each.

    ``codes`` are the words of the part in order (int32 into ``phrases``, BREAK
    between pieces); ``hashed`` counts the pairs of words by bucket, in the last row of a task.
    """
    rows = texts(docs, "lang").select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = Buckets(buckets, least)
        held: dict[str, tuple[defaultdict, list[np.ndarray]]] = {}
        size: dict[str, int] = defaultdict(int)

        def row(lang: str, last: bool = False) -> pa.RecordBatch:
            known, parts = held.pop(lang, ({}, []))
            size.pop(lang, None)
            codes = np.concatenate(parts) if parts else np.empty(0, np.int32)
            words = [w.decode("utf-8", "replace") for w in known if w != _MARK]
            h = word_hashes(lang, words)
            at = pairs(codes)
            filled.add(bucket_of(longer(h[codes[at]], h[codes[at + 1]]), buckets))
            n = np.bincount(codes[codes >= 0], minlength=len(words))
            kind = pa.list_(pa.struct([("slice", pa.int32()), ("at", pa.binary()), ("n", pa.binary())]))
            cells = [pa.array([lang]), pa.array([words], pa.list_(pa.string())), pa.array([n], pa.list_(pa.int64())), pa.array([codes.tobytes()], pa.binary()), pa.array([filled.slices() if last else []], kind)]
            return pa.RecordBatch.from_arrays(cells, names=["lang", "phrases", "n", "codes", "hashed"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                words = pieces(text.as_py())
                if not words:
                    continue
                if lang not in held:
                    known: defaultdict = defaultdict(count(BREAK).__next__)
                    known[_MARK]  # gets BREAK
                    held[lang] = (known, [])
                known, parts = held[lang]
                parts.append(np.array([known[w] for w in words] + [BREAK], np.int32))
                size[lang] += len(words)
                if size[lang] >= CHUNK or sum(size.values()) >= 4 * CHUNK:
                    yield row(max(size, key=size.get))
        for lang in list(held):
            yield row(lang)
        yield row(UNKNOWN, last=True)

    return rows.mapInArrow(run, f"lang string, phrases array<string>, n array<long>, codes binary, hashed {_HASHED}")


def counted(parts: DataFrame, k: int, buckets: int, least: int, full: Broadcast, inner: Broadcast, more: bool) -> DataFrame:
    """Pass k over the chunks: each chunk's candidates of k words with their occurrences and, with ``more``, the phrases of k + 1 words by bucket.

    ``full``: bits of the buckets of k words that are full; ``inner``: bits of
    the frequent phrases of k - 1 words.  A phrase of k + 1 words goes to a bucket only if both phrases of k words in it are candidates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = Buckets(buckets, least) if more else None
        kind = pa.list_(pa.struct([("slice", pa.int32()), ("at", pa.binary()), ("n", pa.binary())]))

        def row(lang: str, phrases: list[str], n: np.ndarray | list, hashed: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([phrases], pa.list_(pa.string())), pa.array([n], pa.list_(pa.int64())), pa.array([hashed], kind)], names=["lang", "phrases", "n", "hashed"])

        for batch in batches:
            for lang, words, raw in zip(batch.column("lang").to_pylist(), batch.column("phrases"), batch.column("codes")):
                codes = np.frombuffer(raw.as_py(), np.int32).astype(np.int64)
                words = words.as_py()
                if len(codes) < k or not words:
                    continue
                word = word_hashes(lang, words)
                h = word[codes]  # a BREAK gets some hash; windows with one are left out below
                whole = codes >= 0
                for j in range(1, k - 1):
                    h = longer(h[:-1], word[codes[j:]])
                    whole = whole[:-1] & (codes[j:] >= 0)
                known = whole.copy()
                known[whole] = marked(inner.value, bucket_of(h[whole], buckets))
                able = known[:-1] & known[1:]  # both phrases of k - 1 words may be frequent
                at = np.flatnonzero(able)
                h = longer(h[at], word[codes[at + k - 1]])
                stays = marked(full.value, bucket_of(h, buckets))
                at, h = at[stays], h[stays]
                if filled is not None:
                    able[:] = False
                    able[at] = True
                    both = able[at + 1 - (at + 1 == len(able))] & (at + 1 < len(able))
                    filled.add(bucket_of(longer(h[both], word[codes[at[both] + k]]), buckets))
                # exact names for the candidates: ranks of (rank, next word)
                rank = codes[at]
                for j in range(1, k):
                    found, first, rank = np.unique(rank * len(words) + codes[at + j], return_index=True, return_inverse=True)
                if len(at):
                    yield row(lang, [" ".join([words[c] for c in codes[i : i + k].tolist()]) for i in at[first].tolist()], np.bincount(rank), [])
        if filled is not None:
            yield row(UNKNOWN, [], [], filled.slices())

    return parts.select("lang", "phrases", "codes").mapInArrow(run, _COUNTED)


def summed(parts: DataFrame, least: int) -> DataFrame:
    """lang, phrase, a: phrases with ``least`` occurrences or more, from the counts of the chunks."""
    each = parts.select("lang", F.explode(F.arrays_zip("phrases", "n")).alias("x")).select("lang", F.col("x.phrases").alias("phrase"), F.col("x.n").alias("n"))
    return each.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= least)


def hashed_phrases(phrases: DataFrame, k: int, buckets: int) -> DataFrame:
    """The buckets of phrases of k words, in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Buckets(buckets, 1)
        for batch in batches:
            rows = [(lang, phrase.split(" ")) for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist())]
            h = None
            for j in range(k):
                word = np.array([xxhash.xxh64_intdigest(lang.encode() + b"\x00" + p[j].encode("utf-8", "replace")) for lang, p in rows], U)
                h = word if h is None else longer(h, word)
            if rows:
                seen.add(bucket_of(h, buckets))
        kind = pa.list_(pa.struct([("slice", pa.int32()), ("at", pa.binary()), ("n", pa.binary())]))
        yield pa.RecordBatch.from_arrays([pa.array([seen.slices()], kind)], names=["hashed"])

    return phrases.select("lang", "phrase").mapInArrow(run, f"hashed {_HASHED}")


def bucket_number(docs: DataFrame) -> int:
    """A power of two that follows the planner's size of the rows, within the bounds."""
    planned = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << max(0, planned // BUCKET_BYTES - 1).bit_length()))


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, a) of all phrases of 1 to ``longest`` words with ``least`` occurrences, and (lang, n) of all words; written."""
    workers_import(docs.sparkSession)
    buckets = buckets or bucket_number(docs)
    sc = docs.sparkSession.sparkContext
    parts = written(chunks(docs, buckets, least), "chunks")
    totals = parts.groupBy("lang").agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda x, y: x + y)).alias("n")).where("n > 0")
    out = None
    last = parts
    for k in range(1, longest + 1):
        found = written(summed(last, least), f"phrases{k}")
        out = found.withColumn("k", F.lit(k)) if out is None else out.unionAll(found.withColumn("k", F.lit(k)))
        if k == longest:
            break
        full, inner = sc.broadcast(bitmap(last, buckets, least)), sc.broadcast(bitmap(hashed_phrases(found, k, buckets), buckets, 1))
        last = written(counted(parts, k + 1, buckets, least, full, inner, k + 1 < longest), "counted")
    return out, totals


def light(rows: DataFrame, text: str) -> DataFrame:
    """Marked for broadcast if the texts of the column and 48 bytes for each row come to BROADCAST_BYTES at most, else as it is."""
    size = rows.agg(F.sum(F.octet_length(text) + 48)).first()[0] or 0
    return F.broadcast(rows) if size <= BROADCAST_BYTES else rows


def scored(phrases: DataFrame, totals: DataFrame, inside: int = INSIDE) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases of two words or more that no longer one with ``inside`` hundredths of their occurrences holds."""
    words = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    many = phrases.where("k > 1")
    cuts = many.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)"))).select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.size(words)).alias("rest"))
    known = light(phrases.select("lang", "phrase", "a"), "phrase")
    c = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"]).join(known.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    c = c.join(light(totals, "lang"), "lang")
    whole = "CAST({} AS decimal(19,0))".format
    score = F.expr(f"(CAST(1000 AS decimal(4,0)) * {whole('a')} * {whole('n')}) div ({whole('l')} * {whole('r')})")
    weakest = c.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a", "n")).alias("w"))
    # of the phrases that hold one, those with one word more decide: further ones are no more frequent
    sub = phrases.where("k > 2").select("lang", "a", F.explode(F.array(part(F.lit(1), F.size(words) - 1), part(F.lit(2), F.size(words) - 1))).alias("phrase"))
    longer_ = sub.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    held = weakest.join(longer_, ["lang", "phrase"], "left").where(F.expr(f"coalesce(100 * longer < {inside} * w.a, true)"))
    return held.select("lang", "phrase", "w.a", "w.l", "w.r", "w.n", "w.score")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, inside: int = INSIDE, top: int = TOP, buckets: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases by score and a, descending, then by phrase.

    Counts cover all of ``docs``: n all words of the language, a, l and r the
    occurrences of the phrase and of the two parts of its weakest cut.  A null
    lang is ``und``, with the rows of that name; a null or empty text has no
    words; repeated rows count each; an empty table gives an empty table;
    further columns are left out.  A phrase is unique in its language, so ranks have no ties.
    """
    out = scored(*frequent(docs, least, longest, buckets), inside)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each slice of a language, then the first of those
    dealt = F.pmod(F.xxhash64("phrase"), F.lit(shuffle_width(docs.sparkSession)))
    first = out.withColumn("slice", dealt).withColumn("rank", F.row_number().over(W.partitionBy("lang", "slice").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op13_collocations": r"""WITH pc AS (SELECT row_number() OVER () AS piece, lang, words FROM (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents) a) b WHERE len(words) > 0),
tot AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM pc GROUP BY lang),
g AS (SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM (SELECT lang, words, unnest([1, 2, 3, 4, 5]) AS k FROM pc) x WHERE len(words) >= k) y),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
cut AS (SELECT lang, phrase, a, k, j, array_to_string(string_split(phrase, ' ')[:j], ' ') AS one, array_to_string(string_split(phrase, ' ')[j + 1:], ' ') AS two FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1) x),
sc AS (SELECT cut.*, x.a AS l, y.a AS r, tot.n, CAST(1000 * CAST(cut.a AS HUGEINT) * tot.n // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = one JOIN f y ON y.lang = cut.lang AND y.phrase = two JOIN tot ON tot.lang = cut.lang),
w AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS nth FROM sc),
ok AS (SELECT * FROM w WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM f WHERE f.lang = w.lang AND f.k > w.k AND contains(' ' || f.phrase || ' ', ' ' || w.phrase || ' ') AND f.a >= w.a)),
rk AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ok)
SELECT lang, rank, phrase, a, l, r, n, score FROM rk WHERE rank <= 2000"""
}
