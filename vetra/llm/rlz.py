"""Substring deduplication by relative Lempel-Ziv parsing against the corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rolling as R
from . import shared as S
from .frames import id_array, id_column, table, texts

#: Words of the shortest factor that counts as a duplicate.
MIN_WORDS = 13
#: Words of an anchor gram.
GRAM = 5

U = np.uint64


class Windows:
    """Words, windows and anchors of the documents of one part."""

    def __init__(self, group: pa.Table, size: int, gram: int) -> None:
        self.ids = id_array(group["doc_id"])
        self.data, self.offsets = R.text_buffers(group["text"])
        self.size, self.gram = size, gram

    def __iter__(self):
        """For each chunk: its first row, bytes, word starts and ends, first word of each row, row of each word, windows, word hashes, their prefix sums."""
        for a, b in R.chunks(self.offsets):
            data = self.data[self.offsets[a] : self.offsets[b]]
            starts, ends, first = R.words(data, self.offsets[a : b + 1] - self.offsets[a], R.SPACE_WORDS)
            hashes = R.byte_ranges(R.byte_prefix(data), starts, ends)
            row = np.repeat(np.arange(a, b), np.diff(first))
            at = np.arange(max(0, len(starts) - self.size + 1))
            at = at[row[at] == row[at + self.size - 1]]
            yield a, data, starts, ends, first, row, at, hashes, R.word_prefix(hashes)

    def anchors(self, at: np.ndarray, sums: np.ndarray) -> np.ndarray:
        grams = R.word_grams(sums, self.gram)
        return grams[R.sliding_argmin(grams, self.size - self.gram + 1)[at]] if len(at) else np.empty(0, U)

    def keys(self, at: np.ndarray, data, starts, ends, hashes, sums) -> tuple[np.ndarray, np.ndarray]:
        """96 bits for the windows ``at``."""
        if not len(at):
            return np.empty(0, U), np.empty(0, np.uint32)
        return R.word_grams(sums, self.size)[at], R.second_grams(R.second_prefix(R.second_values(hashes, data, starts, ends)), self.size)[at]


def _joined(pieces: list, kind) -> np.ndarray:
    return np.concatenate(pieces) if pieces else np.empty(0, kind)


def _anchors_of(size: int, gram: int):
    def run(group: pa.Table):
        hashes, rows = [], []
        w = Windows(group, size, gram)
        for _, _, _, _, _, row, at, _, sums in w:
            h, r = w.anchors(at, sums), row[at]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
            hashes.append(h[new])
            rows.append(r[new])
        return _joined(hashes, U), _joined(rows, np.int64)

    return run


def _candidates(group: pa.Table, masks: pa.Table, size: int, gram: int, buckets: int):
    """Key, document id and position of every window whose anchor is shared, by (id, row, position)."""
    empty = np.empty(0, U), np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
    anchor, rows = _anchors_of(size, gram)(group)
    many, _ = S.read_masks(anchor, rows, buckets, masks)
    wanted = np.unique(S.order_by_bucket(anchor[many], buckets))
    if not len(wanted):
        return empty
    found = []
    w = Windows(group.take(pa.array(np.argsort(id_array(group["doc_id"]), kind="stable"))), size, gram)
    for a, data, starts, ends, first, row, at, hashes, sums in w:
        own = S.order_by_bucket(w.anchors(at, sums), buckets)
        i = np.searchsorted(wanted, own)
        i[i == len(wanted)] = 0
        at = at[wanted[i] == own]
        found.append((*w.keys(at, data, starts, ends, hashes, sums), w.ids[row[at]], at - first[row[at] - a]))
    return tuple(_joined(list(x), e.dtype) for x, e in zip(zip(*found), empty))


def _heads(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Firsts of the runs of equal keys."""
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    return np.flatnonzero(new)


def _block(h: np.ndarray, buckets: int) -> np.ndarray:
    """The reference block of each window: ranges of the hash, so that windows in order of it are in order of blocks."""
    return ((h >> U(32)) * U(buckets)) >> U(32)


def _index(parts: DataFrame, masks: DataFrame, size: int, gram: int, buckets: int) -> DataFrame:
    """Blocks of the reference index: windows with the first document and place of each, told to the parts that ask."""

    def ask(key: tuple, group: pa.Table, sent: pa.Table) -> pa.Table:
        h, g, doc, place = _candidates(group, sent, size, gram, buckets)
        order = np.lexsort((g, h))  # stable: by id and place among equals
        h, g, doc, place = h[order], g[order], doc[order], place[order]
        at = _heads(h, g)
        last = np.r_[at[1:], len(h)] - 1 if len(at) else at
        several = doc[at] != doc[last]
        h, g, doc, place = h[at], g[at], doc[at], place[at]
        ends = np.searchsorted(_block(h, buckets), np.arange(buckets + 1, dtype=U))
        part = key[0].as_py()
        cuts = [(b, int(ends[b]), int(ends[b + 1])) for b in np.flatnonzero(np.diff(ends)).tolist()]
        both = lambda s, e: S.blob(place[s:e].astype(np.uint32) << np.uint32(1) | several[s:e])
        return S.table_of(S.POSTS, [(b, part, S.blob(h[s:e]), S.blob(doc[s:e]), both(s, e), S.blob(g[s:e])) for b, s, e in cuts])

    def answer(key: tuple, group: pa.Table) -> pa.Table:
        hs = [np.frombuffer(x.as_py(), U) for x in group["a"]]
        h = np.concatenate(hs)
        doc = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in group["b"]])
        place = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in group["c"]])
        g = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in group["d"]])
        several, place = (place & np.uint32(1)).astype(bool), place >> np.uint32(1)
        order = np.lexsort((g, h))
        at = _heads(h[order], g[order])
        n = np.diff(np.r_[at, len(h)])
        least = np.minimum.reduceat(doc[order], at) if len(at) else doc[:0]
        first = np.minimum.reduceat(np.where(doc[order] == np.repeat(least, n), place[order], np.uint32(0xFFFFFFFF)), at) if len(at) else place[:0]
        source, start = np.empty(len(h), np.int64), np.empty(len(h), np.uint32)
        source[order], start[order] = np.repeat(least, n), np.repeat(first, n)
        found = several | (source < doc)
        out, at = [], 0
        for part, x in zip(group["part"].to_pylist(), hs):
            i = at + np.flatnonzero(found[at : at + len(x)])
            at += len(x)
            if len(i):
                out.append((part, key[0].as_py(), 1, S.blob(h[i]), S.blob(source[i]), S.blob(start[i]), S.blob(g[i])))
        return S.table_of(S.ANSWERS, out)

    asked = parts.groupBy("part").cogroup(masks.groupBy("part")).applyInArrow(ask, S.POSTS)
    return asked.groupBy("bucket").applyInArrow(answer, S.ANSWERS)


def _look_up(h: np.ndarray, g: np.ndarray, own: np.ndarray, own_g: np.ndarray) -> np.ndarray:
    """Places of keys among sorted ones, or -1."""
    out = np.full(len(own), -1)
    if not len(h):
        return out
    i = np.searchsorted(h, own)
    more = True
    while more:
        j = np.minimum(i, len(h) - 1)
        same = (h[j] == own) & (i < len(h)) & (out < 0)
        out[same & (g[j] == own_g)] = j[same & (g[j] == own_g)]
        more = bool((same & (out < 0)).any())  # the same 64 bits, but not the other 32
        i += 1
    return out


def phrases(row: np.ndarray, at: np.ndarray, source: np.ndarray, place: np.ndarray, size: int):
    """(row, start, end, source, place) of the longest stretches that go on in one source.

    ``at`` are the windows found, by row and position.  Windows of one source
    at one distance belong together while they overlap or touch, whatever
    other sources the windows between them have.
    """
    lag = place - at
    name = R.mix(row.astype(U) * U(0x9E3779B97F4A7C15) ^ R.mix(source.astype(U) * U(0xD6E8FEB86659FD93) ^ lag.astype(U)))
    order = np.argsort(name, kind="stable")
    r, a, s, d = row[order], at[order], source[order], lag[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1]) | (d[1:] != d[:-1]) | (a[1:] - a[:-1] > size)
    head = np.flatnonzero(new)
    tail = np.r_[head[1:], len(r)] - 1 if len(head) else head
    out = r[head], a[head], a[tail] + size, s[head], a[head] + d[head]
    order = np.lexsort((out[1], out[0]))
    return tuple(x[order] for x in out)


def factors(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, end, source, place there) of one document, from its phrases by start.

    At each place the phrase that reaches furthest is the factor.  Phrases that
    begin before or at its end, found by looking up the windows across that
    boundary, come next if they reach beyond it; else words up to the next
    phrase are literals.
    """
    out: list[tuple[int, int, int, int]] = []
    i, n, to = 0, len(found), -1
    while i < n:
        to = max(to, found[i][0])
        best = None
        while i < n and found[i][0] <= to:
            if best is None or found[i][1] > best[1]:
                best = found[i]
            i += 1
        if best[1] > to:
            out.append(best)
            to = best[1]
    return out


_RESULT = "doc_id long, n_words long, n_removed long, kept string, factors array<struct<start: long, words: long, source: long, source_start: long>>"
_FACTOR = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("source", pa.int64()), ("source_start", pa.int64())]))


def deduplicate(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept, factors for every row of ``docs``.

    Words are runs of anything but ASCII white space.  Every document is parsed
    against the blocks of the reference index into factors of ``min_words`` or
    more words copied from documents with a smaller doc_id, and literals; the
    words of its factors go, ``kept`` holds the literals, joined by one space.
    So a word goes if a window of ``min_words`` consecutive words around it
    also starts in such a document; windows are judged on the input.
    ``factors`` lists (start, words, source document, place in it); the sources
    tried for a window are the smallest document (and first place) that has it,
    and those of the windows around it, as far as they go on.

    A null or empty text has no words.  A null doc_id is larger than any
    other.  Rows with one doc_id, or copies of a row, are no reference for
    each other.  An empty table gives no rows.
    """
    gram = min(gram, min_words)
    docs = texts(docs)
    buckets = S.width(docs)
    parts = S.in_parts(docs, buckets * S.PARTS_PER_PARTITION)
    masks = S.shared_masks(parts, _anchors_of(min_words, gram), buckets)
    index = _index(parts, masks, min_words, gram, buckets)

    def parse(key: tuple, group: pa.Table, sent: pa.Table) -> pa.Table:
        h = _joined([np.frombuffer(x.as_py(), U) for x in sent["a"]], U)
        source = _joined([np.frombuffer(x.as_py(), np.int64) for x in sent["b"]], np.int64)
        place = _joined([np.frombuffer(x.as_py(), np.uint32) for x in sent["c"]], np.uint32).astype(np.int64)
        g = _joined([np.frombuffer(x.as_py(), np.uint32) for x in sent["d"]], np.uint32)
        order = np.lexsort((g, h))
        h, source, place, g = h[order], source[order], place[order], g[order]
        n_words, n_removed, kept, lists = [], [], [], []
        w = Windows(group, min_words, gram)
        for a, data, starts, ends, first, row, at, hashes, sums in w:
            chosen: list[list] = [[] for _ in range(len(first) - 1)]
            if len(h) and len(at):
                own, own_g = w.keys(at, data, starts, ends, hashes, sums)
                i = _look_up(h, g, own, own_g)
                ok = i >= 0
                ok[ok] = source[i[ok]] < w.ids[row[at[ok]]]
                at, i = at[ok], i[ok]
                found = phrases(row[at], at, source[i], place[i], min_words)
                edge = np.searchsorted(found[0], np.arange(a, a + len(first)))
                whole = list(zip(*(x.tolist() for x in found[1:])))
                for k in np.flatnonzero(np.diff(edge)).tolist():
                    chosen[k] = factors(whole[edge[k] : edge[k + 1]])
            cover = np.zeros(len(starts) + 1, np.int64)
            spans = np.array([f[:2] for own in chosen for f in own], np.int64).reshape(-1, 2)
            np.add.at(cover, spans[:, 0], 1)
            np.add.at(cover, spans[:, 1], -1)
            keep = np.cumsum(cover[:-1]) == 0
            # words that stay, with one space after each, in one buffer
            size = (ends - starts + 1) * keep
            to = np.zeros(len(starts) + 1, np.int64)
            np.cumsum(size, out=to[1:])
            # walk the source bytes of every kept word and its separator
            index_ = np.repeat(starts - to[:-1], size) + np.arange(to[-1])
            raw = np.append(data, np.uint8(32))[np.minimum(index_, len(data))]
            raw[to[1:][keep] - 1] = 32
            raw = raw.tobytes()
            for k in range(len(first) - 1):
                f, l = int(first[k]), int(first[k + 1])
                n_words.append(l - f)
                n_removed.append(l - f - int(np.count_nonzero(keep[f:l])))
                kept.append(raw[to[f] : max(to[f], to[l] - 1)].decode("utf-8", "replace"))
                lists.append([{"start": x - f, "words": y - x, "source": d, "source_start": p} for x, y, d, p in chosen[k]])
        return pa.Table.from_arrays(
            [id_column(w.ids), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(lists, _FACTOR)],
            names=["doc_id", "n_words", "n_removed", "kept", "factors"],
        )

    return parts.groupBy("part").cogroup(index.groupBy("part")).applyInArrow(parse, _RESULT)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))




ORACLE_SQL = {
    "op4_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT rid, coalesce(doc_id, 9223372036854775807) AS id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM d),
g AS (SELECT rid, id, pos, list(w) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS g FROM w),
k AS (SELECT rid, id, pos, md5(array_to_string(g, ' ')) AS k FROM g WHERE len(g) = 13),
m AS (SELECT rid, pos, id, min(id) OVER (PARTITION BY k) AS first FROM k),
c AS (SELECT DISTINCT rid, unnest(range(pos, pos + 13)) AS pos FROM m WHERE first < id),
r AS (SELECT w.rid, count(*) AS n_words, count(c.pos) AS n_removed, string_agg(w.w, ' ' ORDER BY w.pos) FILTER (c.pos IS NULL) AS kept FROM w LEFT JOIN c ON c.rid = w.rid AND c.pos = w.pos GROUP BY w.rid)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r ON r.rid = d.rid
"""
}
