"""Suffix-array deduplication: common-prefix interval trees over shared contexts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rolling as R
from . import shared as S
from .frames import id_column, id_array, table, texts

#: Bytes of a string that has to start somewhere else too.
MIN_BYTES = 200
#: Bytes of an anchor gram, at most MIN_BYTES.
GRAM = 48
#: An anchor with so many occurrences has its windows counted one by one
#: instead of its contexts gathered in one suffix array.
HOT = 4096
#: Context bytes that one suffix array takes.
ARRAY_BYTES = 512 << 10

U = np.uint64


# ---- enhanced suffix array -------------------------------------------------


def ranks(text: np.ndarray, ends: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Ranks of the first 8, 16, 32 ... bytes from every position.

    ``ends[i]`` is the end of the context of position i; what lies beyond
    counts as zero bytes.  Doubling stops when a rank spans any context.
    """
    n = len(text)
    longest = int((ends - np.arange(n)).max(initial=0))
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = text
    room = ends - np.arange(n)
    key = np.zeros(n, U)
    for k in range(8):
        key = key << U(8) | np.where(room > k, padded[k : n + k], 0).astype(U)
    levels, size = [], 8
    while True:
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64) + 1
        levels.append((size, rank))
        if size >= longest:
            return levels
        after = np.zeros(n, np.int64)
        if n > size:
            after[:-size] = np.where(room[:-size] > size, rank[size:], 0)
        key = rank * (n + 2) + after
        size *= 2


def common_prefix(levels, text: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of each pair of suffixes, inside their contexts."""
    limit = np.minimum(ends[a] - a, ends[b] - b)
    got = np.zeros(len(a), np.int64)
    n = len(text)
    for size, rank in reversed(levels):
        i, j = a + got, b + got
        ok = (got < limit) & (i < n) & (j < n)
        ok[ok] = rank[i[ok]] == rank[j[ok]]
        got[ok] += size
    for _ in range(7):
        i, j = a + got, b + got
        ok = got < limit
        ok[ok] = text[i[ok]] == text[j[ok]]
        got[ok] += 1
    return np.minimum(got, limit)


def interval_tree(lcp: list[int], left: list[int], least: int) -> list[tuple[int, int, int]]:
    """Maximal repeats (length, first, last) among suffixes in order.

    ``lcp[i]`` belongs to suffixes i - 1 and i.  A stack holds the open
    intervals; when one closes, its set of left characters (-1: none yet, -2:
    several, or a place where the left character is not known) goes up to its
    parent.  Only left-diverse intervals of ``least`` or more are put out, with
    all their occurrences first..last.
    """
    out: list[tuple[int, int, int]] = []
    stack: list[list[int]] = [[0, 0, -1]]  # length, first, left

    def join(x: int, y: int) -> int:
        return y if x == -1 else x if y == -1 or x == y else -2

    n = len(left)
    for i in range(1, n + 1):
        here = lcp[i] if i < n else 0
        start, carried = i - 1, left[i - 1]
        top = stack[-1]
        if here <= top[0]:
            top[2] = join(top[2], carried)
            carried = -1
        while here < top[0]:
            stack.pop()
            if top[0] >= least and top[2] == -2:
                out.append((top[0], top[1], i - 1))
            start, carried = top[1], top[2]
            top = stack[-1]
            if here <= top[0]:
                top[2] = join(top[2], carried)
                carried = -1
        if here > top[0]:
            stack.append([here, start, carried])
    return out


def maximal_repeats(contexts: list[bytes], starts: list[int], many: list[bool], least: int):
    """Arrays (context, start, length, group) of every occurrence of every maximal repeat.

    Suffixes start at 0 .. starts[k] - 1 of context k.  The first start of a
    context has an unknown left character, so a repeat that runs on beyond it
    is kept there.  A context that stands in several places (``many``) is a
    repeat by itself.  All groups are put out, nested ones too, each with all
    its suffixes.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    text = np.frombuffer(b"".join(contexts), np.uint8)
    base = np.r_[0, np.cumsum(sizes)[:-1]]
    ends = np.repeat(base + sizes, sizes)
    levels = ranks(text, ends)
    counts = np.array(starts, np.int64)
    owner = np.repeat(np.arange(len(contexts)), counts)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + base[owner]
    order = np.argsort(levels[-1][1][at], kind="stable")
    sa, owner = at[order], owner[order]
    lcp = np.zeros(len(sa) + 1, np.int64)
    lcp[1:-1] = common_prefix(levels, text, ends, sa[:-1], sa[1:])
    deep = lcp[:-1] >= least
    whole = sa == base[owner]
    left = np.where(whole, -2, np.where(sa > 0, text[sa - 1], 0).astype(np.int64))
    # copies of a whole context, where no other suffix has all of it
    alone = whole & np.array(many, bool)[owner] & (np.maximum(lcp[:-1], lcp[1:]) < sizes[owner])
    firsts, lasts, lengths = [np.flatnonzero(alone)], [np.flatnonzero(alone)], [sizes[owner[alone]]]
    # stretches of suffixes that hang together at the least length
    heads = np.flatnonzero(deep & ~np.r_[False, deep[:-1]]) - 1
    tails = np.flatnonzero(deep & ~np.r_[deep[1:], False])
    found = [(h + first, h + last, length) for h, t in zip(heads.tolist(), tails.tolist()) for length, first, last in interval_tree([0, *lcp[h + 1 : t + 1].tolist()], left[h : t + 1].tolist(), least)]
    if found:
        for x, y in zip((firsts, lasts, lengths), zip(*found)):
            x.append(np.array(y, np.int64))
    first, last, length = (np.concatenate(x) for x in (firsts, lasts, lengths))
    names = R.byte_ranges(R.byte_prefix(text), sa[first], sa[first] + length)
    n = last - first + 1
    hit = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return owner[hit], sa[hit] - base[owner[hit]], np.repeat(length, n), np.repeat(names, n)


# ---- contexts of shared anchors ---------------------------------------------


class Runs:
    """Runs of windows with one anchor, in the documents of a part."""

    def __init__(self, group: pa.Table, size: int, gram: int) -> None:
        self.ids = id_array(group["doc_id"])
        self.data, self.offsets = R.text_buffers(group["text"])
        self.size, self.gram = size, gram

    def __iter__(self):
        """For each chunk: first row, bytes, offsets, prefix sums, row and ends (first window, last + 1) of runs, their anchors."""
        for a, b in R.chunks(self.offsets):
            data = self.data[self.offsets[a] : self.offsets[b]]
            off = self.offsets[a : b + 1] - self.offsets[a]
            sums = R.byte_prefix(data)
            if len(data) < self.size:
                yield a, data, off, sums, *(np.empty(0, np.int64),) * 3, np.empty(0, U)
                continue
            grams = R.byte_grams(np.append(sums, sums[-1]), self.gram)
            least = R.sliding_argmin(grams, self.size - self.gram + 1)
            new = np.ones(len(least) + 1, bool)
            new[1:-1] = least[1:] != least[:-1]
            begin = off[:-1]
            stop = np.maximum(off[1:] - self.size + 1, begin)  # windows of the row lie between
            new[begin[begin < len(new)]] = True
            new[stop[stop < len(new)]] = True
            edge = np.flatnonzero(new)
            first, last = edge[:-1], edge[1:]
            row = np.searchsorted(off, first, "right") - 1
            ok = first < stop[row]
            first, last, row = first[ok], last[ok], row[ok]
            yield a, data, off, sums, row, first, last, grams[least[first]]

    def contexts(self, sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return R.byte_ranges(sums, first, last + self.size - 1)


def _cat(pieces: list, kind) -> np.ndarray:
    return np.concatenate(pieces) if pieces else np.empty(0, kind)


def _anchors_of(size: int, gram: int):
    def run(group: pa.Table):
        return _cat([x[-1] for x in Runs(group, size, gram)], U), None

    return run


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U(40)) % U(buckets)).astype(np.int64)


def _ask(size: int, gram: int, buckets: int):
    """What a part sends: distinct contexts of its shared anchors, or windows of the hot ones."""

    def run(key: tuple, group: pa.Table, sent: pa.Table) -> pa.Table:
        part = key[0].as_py()
        runs = Runs(group, size, gram)
        # the windows' minima are found once; only prefix sums are made again, where they are asked for
        held = [(data, first, last, own) for _, data, _, _, _, first, last, own in runs]
        anchors = _cat([x[-1] for x in held], U)
        many, often = S.read_masks(anchors, None, buckets, sent)
        seen: dict[tuple[int, int], list] = {}
        hot_w, hot_a, at = [], [], 0
        for data, first, last, own in held:
            m, o = many[at : at + len(own)], often[at : at + len(own)]
            at += len(own)
            if not m.any():
                continue
            sums = R.byte_prefix(data)
            i = np.flatnonzero(m & ~o)
            raw = data.tobytes() if len(i) else b""
            for k, c, f, l in zip(own[i].tolist(), runs.contexts(sums, first[i], last[i]).tolist(), first[i].tolist(), last[i].tolist()):
                x = seen.get((k, c))
                if x is None:
                    seen[k, c] = [l - f, raw[f : l + size - 1], False]
                else:
                    x[2] = True
            if o.any():
                f, l, own = first[o], last[o], own[o]
                w = np.repeat(f - (np.cumsum(l - f) - (l - f)), l - f) + np.arange((l - f).sum())
                hot_w.append(R.byte_ranges(sums, w, w + size))
                hot_a.append(np.repeat(own, l - f))
        rows = []
        keys = list(seen)
        which = _bucket(np.array([k for k, _ in keys], U), buckets) if keys else np.empty(0, np.int64)
        order = np.argsort(which, kind="stable")
        cuts = np.searchsorted(which[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            own = [keys[i] for i in order[cuts[b] : cuts[b + 1]].tolist()]
            facts = [seen[k] for k in own]
            head = np.array([(x[0] << 1) | x[2] for x in facts], np.uint32)
            rows.append((b, part, S.blob(np.array(own, U)), S.blob(head), b"".join(x[1] for x in facts), None))
        h, n = np.unique(_cat(hot_w, U), return_index=True, return_counts=True)[::2] if hot_w else (np.empty(0, U), np.empty(0, np.int64))
        if len(h):
            owner = _cat(hot_a, U)[np.unique(_cat(hot_w, U), return_index=True)[1]]
            which = _bucket(h, buckets)
            order = np.argsort(which, kind="stable")
            h, n, owner, which = h[order], n[order], owner[order], which[order]
            cuts = np.searchsorted(which, np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                s = slice(cuts[b], cuts[b + 1])
                rows.append((b, part, S.blob(h[s]), S.blob(n[s] > 1), None, S.blob(owner[s])))
        return S.table_of(S.POSTS, rows)

    return run


def _repeats(keys: np.ndarray, ctx: np.ndarray, many: np.ndarray, starts: np.ndarray, bodies: list[bytes], size: int):
    """Arrays (context, start, length, name) of the repeats inside distinct contexts, anchor by anchor."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True])
    single = order[edge[:-1][np.diff(edge) == 1]]
    single = single[many[single]]  # an anchor with one context that stands in several places: the context is the only group
    out = [(single, np.zeros(len(single), np.int64), np.array([len(bodies[i]) for i in single.tolist()], np.int64), ctx[single])]
    batch: list[int] = []
    total = 0

    def flush():
        o, at, length, name = maximal_repeats([bodies[i] for i in batch], [int(starts[i]) for i in batch], [bool(many[i]) for i in batch], size)
        out.append((np.array(batch, np.int64)[o], at, length, name))

    for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if e - s > 1:
            own = order[s:e].tolist()
            batch += own
            total += sum(len(bodies[i]) for i in own)
            if total >= ARRAY_BYTES:
                flush()
                batch, total = [], 0
    if batch:
        flush()
    return tuple(np.concatenate(x) for x in zip(*out))


def _answer(size: int):
    """What a bucket answers: for each part's contexts the repeats inside, for hot windows those that occur again."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        out = []
        plain, hot = [], []
        for part, a, b, c, d in zip(*(group[n].to_pylist() for n in ("part", "a", "b", "c", "d"))):
            if d is None:
                plain.append((part, np.frombuffer(a, U).reshape(-1, 2), np.frombuffer(b, np.uint32), c))
            else:
                hot.append((part, np.frombuffer(a, U), np.frombuffer(b, bool), np.frombuffer(d, U)))
        if hot:
            w = np.concatenate([x[1] for x in hot])
            inverse = np.unique(w, return_inverse=True)[1]
            found = np.bincount(inverse, weights=1 + np.concatenate([x[2] for x in hot]))[inverse] >= 2
            at = 0
            for part, own, _, owner in hot:
                m = found[at : at + len(own)]
                at += len(own)
                if m.any():
                    out.append((part, bucket, 2, S.blob(own[m]), S.blob(owner[m]), None, None))
        number: dict[tuple[int, int], int] = {}
        starts, many, bodies, theirs = [], [], [], []
        for part, pairs, head, raw in plain:
            mine, at = [], 0
            for pair, h in zip(map(tuple, pairs.tolist()), head.tolist()):
                length = (h >> 1) + size - 1
                i = number.get(pair)
                if i is None:
                    i = number[pair] = len(bodies)
                    starts.append(h >> 1)
                    many.append(bool(h & 1))
                    bodies.append(raw[at : at + length])
                else:
                    many[i] = True
                at += length
                mine.append(i)
            theirs.append((part, mine))
        if number:
            pairs = np.array(list(number), U)
            i, at, length, name = _repeats(pairs[:, 0], pairs[:, 1], np.array(many), np.array(starts), bodies, size)
            order = np.argsort(i, kind="stable")
            i, at, length, name = i[order], at[order].astype(np.uint32), length[order].astype(np.uint32), name[order]
            edge = np.searchsorted(i, np.arange(len(bodies) + 1))
            for part, mine in theirs:
                mine = np.array(mine, np.int64)
                n = edge[mine + 1] - edge[mine]
                j = np.repeat(edge[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                if len(j):
                    out.append((part, bucket, 1, S.blob(pairs[i[j], 1]), S.blob(at[j]), S.blob(length[j]), S.blob(name[j])))
        return S.table_of(S.ANSWERS, out)

    return run


_RESULT = "doc_id long, n_bytes long, n_removed long, kept binary, spans array<struct<start: long, length: long>>, repeats array<struct<start: long, length: long, repeat: long>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
_REPEAT = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("repeat", pa.int64())]))


def _remove(size: int, gram: int):
    def run(key: tuple, group: pa.Table, sent: pa.Table) -> pa.Table:
        kinds = sent["kind"].to_pylist()
        cols = {n: sent[n].to_pylist() for n in "abcd"}

        def gather(kind: int, name: str, dtype) -> np.ndarray:
            return _cat([np.frombuffer(x, dtype) for x, k in zip(cols[name], kinds) if k == kind], dtype)

        ctx, begin, length, name = gather(1, "a", U), gather(1, "b", np.uint32).astype(np.int64), gather(1, "c", np.uint32).astype(np.int64), gather(1, "d", U)
        order = np.argsort(ctx, kind="stable")
        ctx, begin, length, name = ctx[order], begin[order], length[order], name[order]
        hot = np.unique(gather(2, "a", U))
        hot_anchors = np.unique(gather(2, "b", U))
        runs = Runs(group, size, gram)
        n_bytes, n_removed, kept, spans, repeats = [], [], [], [], []
        for a, data, off, sums, row, first, last, own in runs:
            start, reach, group_of, where = (np.empty(0, np.int64),) * 2 + (np.empty(0, U), np.empty(0, np.int64))
            if len(ctx) and len(first):
                h = runs.contexts(sums, first, last)
                lo, hi = np.searchsorted(ctx, h, "left"), np.searchsorted(ctx, h, "right")
                n = hi - lo
                j = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                start, reach, group_of, where = np.repeat(first, n) + begin[j], length[j], name[j], np.repeat(row, n)
            if len(hot) and len(first):
                i = np.searchsorted(hot_anchors, own)
                i[i == len(hot_anchors)] = 0
                o = hot_anchors[i] == own
                f, n = first[o], (last - first)[o]
                w = np.repeat(f - (np.cumsum(n) - n), n) + np.arange(n.sum())
                h = R.byte_ranges(sums, w, w + size)
                i = np.searchsorted(hot, h)
                i[i == len(hot)] = 0
                ok = hot[i] == h
                start, reach = np.r_[start, w[ok]], np.r_[reach, np.full(int(ok.sum()), size)]
                group_of, where = np.r_[group_of, h[ok]], np.r_[where, np.repeat(row[o], n)[ok]]
            cover = np.zeros(len(data) + 1, np.int32)
            np.add.at(cover, start, 1)
            np.add.at(cover, start + reach, -1)
            gone = np.cumsum(cover[:-1]) > 0
            left = data[~gone]
            to = np.r_[0, np.cumsum(~gone)]
            edge = np.zeros(len(data) + 1, bool)
            edge[1:-1] = gone[1:] != gone[:-1]
            edge[off] = True
            edge = np.flatnonzero(edge)
            solid = gone[edge[:-1]] if len(edge) > 1 else np.empty(0, bool)
            s0, s1 = edge[:-1][solid], edge[1:][solid]
            srow = np.searchsorted(off, s0, "right") - 1
            order = np.lexsort((start, where))
            start, reach, group_of, where = start[order], reach[order], group_of[order], where[order]
            scut, rcut = np.searchsorted(srow, np.arange(len(off))), np.searchsorted(where, np.arange(len(off)))
            raw = left.tobytes()
            for k in range(len(off) - 1):
                at, end = int(off[k]), int(off[k + 1])
                n_bytes.append(end - at)
                n_removed.append(end - at - int(to[end] - to[at]))
                kept.append(raw[to[at] : to[end]])
                x = slice(scut[k], scut[k + 1])
                spans.append([{"start": p - at, "length": q - p} for p, q in zip(s0[x].tolist(), s1[x].tolist())])
                x = slice(rcut[k], rcut[k + 1])
                repeats.append([{"start": p - at, "length": q, "repeat": g} for p, q, g in zip(start[x].tolist(), reach[x].tolist(), group_of[x].astype(np.int64).tolist())])
        return pa.Table.from_arrays(
            [id_column(runs.ids), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, _SPAN), pa.array(repeats, _REPEAT)],
            names=["doc_id", "n_bytes", "n_removed", "kept", "spans", "repeats"],
        )

    return run


def deduplicate(docs: DataFrame, min_bytes: int = MIN_BYTES, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, kept, spans, repeats for every row of ``docs``.

    A byte of the UTF-8 text goes if a string of ``min_bytes`` bytes around it
    also starts anywhere else in the corpus, the same document included.
    ``spans`` are the maximal runs of such bytes.  ``repeats`` lists, by start,
    the maximal repeats they are made of, nested ones too: rows with one
    ``repeat`` value, over all documents, are all the occurrences of one string.

    Every window of ``min_bytes`` belongs to the context of its smallest
    ``gram``; contexts with one anchor meet in one suffix array, where a repeat
    ends with its context at the latest, so a longer one is a chain of
    overlapping repeats.  Anchors with ``hot`` or more occurrences send hashes
    of their windows, counted before the shuffle, instead of contexts; their
    windows that occur again are groups of ``min_bytes`` bytes.  Contexts are
    told apart by two hashes, 128 bits.

    A null or empty text has no bytes.  Null and repeated doc_ids stay, and
    copies of a row are repeats of each other.  An empty table gives no rows.
    """
    gram = min(gram, min_bytes)
    docs = texts(docs)
    buckets = S.width(docs)
    parts = S.in_parts(docs, buckets * S.PARTS_PER_PARTITION)
    masks = S.shared_masks(parts, _anchors_of(min_bytes, gram), buckets, hot)
    asked = parts.groupBy("part").cogroup(masks.groupBy("part")).applyInArrow(_ask(min_bytes, gram, buckets), S.POSTS)
    answers = asked.groupBy("bucket").applyInArrow(_answer(min_bytes), S.ANSWERS)
    return parts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_remove(min_bytes, gram), _RESULT)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = {
    "op7_suffix_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, unnest(range(0, len(h) // 2 - 199)) AS pos FROM d WHERE len(h) >= 400),
k AS (SELECT w.rid, pos, md5_number(substr(h, 2 * pos + 1, 400)) AS k FROM w JOIN d ON d.rid = w.rid),
m AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY k) AS n FROM k) x WHERE n > 1),
o AS (SELECT rid, pos, lag(pos) OVER (PARTITION BY rid ORDER BY pos) AS last FROM m),
i AS (SELECT rid, pos, sum(CASE WHEN last IS NULL OR pos > last + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY pos) AS run FROM o),
s AS (SELECT rid, run, min(pos) AS a, max(pos) + 200 AS b FROM i GROUP BY ALL),
e AS (SELECT s.rid, a, b, coalesce(lag(b) OVER (PARTITION BY s.rid ORDER BY a), 0) AS before, h FROM s JOIN d ON d.rid = s.rid),
r AS (SELECT rid, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) || substr(any_value(h), CAST(2 * max(b) + 1 AS BIGINT)) AS kept FROM e GROUP BY rid)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN r ON r.rid = d.rid
"""
}
