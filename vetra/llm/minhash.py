"""MinHash near-duplicates by an inverted join of signature coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rolling as R
from . import shared as S
from .components import components
from .frames import NO_ID, id_array, in_runs, small, table, texts, written

#: Words of a shingle, of the dealt query; pipeline stages take five.
SHINGLE = 4
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Coordinates of a signature and matches that make a pair a candidate.  At a
#: similarity of 0.8 the matches are binomial: fewer than 32 of 64 come once in
#: some ten million pairs.
COORDINATES = 64
MATCHES = 32
#: Classes that one task compares; a larger posting list or cluster is dealt out, see :func:`forest`.
BLOCK = 2000
#: Members of a large group that every slice of it is compared with.
HUBS = 8
#: Rows of (doc_id, hash of the text, cluster, class) that are broadcast at most: some 100
#: bytes each.  With more, the texts are shuffled to them.
BROADCAST_ROWS = 200_000

U = np.uint64
_RND = np.random.default_rng(19970613)
_FACTORS = _RND.integers(0, 2**63, 1024, dtype=np.int64).astype(U) * U(2) + U(1)


def shingles(column: pa.Array, k: int):
    """For each chunk of rows: first row, starts of the rows' shingles (one more at the end), shingle hashes."""
    data, offsets = R.text_buffers(column)
    for a, b in R.chunks(offsets):
        low = R.LOWER[data[offsets[a] : offsets[b]]]
        starts, ends, first = R.words(low, offsets[a : b + 1] - offsets[a], R.SPACE_WORDS)
        sums = R.word_prefix(R.byte_ranges(R.byte_prefix(low), starts, ends))
        n = np.diff(first)
        count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        cuts = np.r_[0, np.cumsum(count)]
        at = np.arange(cuts[-1]) + np.repeat(first[:-1] - cuts[:-1], count)
        yield a, cuts, R.word_ranges(sums, at, at + np.repeat(np.minimum(n, k), count))


def sets(cuts: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts and hashes of the distinct shingles of each row, in order of the hash."""
    row = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return np.r_[0, np.cumsum(np.bincount(row[new], minlength=len(cuts) - 1))], h[new]


def signatures(cuts: np.ndarray, h: np.ndarray, coordinates: int) -> np.ndarray:
    """Smallest value of each coordinate, of the rows that have shingles."""
    rows = np.flatnonzero(np.diff(cuts))
    out = np.empty((len(rows), coordinates), np.uint32)
    for k in range(coordinates):
        out[:, k] = np.minimum.reduceat(h * _FACTORS[k], cuts[rows]) >> U(32) if len(rows) else 0
    return out


def _names(cuts: np.ndarray, h: np.ndarray) -> list[bytes | None]:
    """128-bit names of the sets of each row; None for an empty one."""
    x = R.mix(h * U(0x9FB21C651E98DF25))
    a, b = np.zeros(len(h) + 1, U), np.zeros(len(h) + 1, U)
    np.cumsum(h, out=a[1:])
    np.cumsum(x, out=b[1:])
    n = np.diff(cuts).astype(U)
    pair = np.stack([R.mix(a[cuts[1:]] - a[cuts[:-1]] + n), R.mix(b[cuts[1:]] - b[cuts[:-1]])], axis=1)
    return [pair[i].tobytes() if n[i] else None for i in range(len(n))]


_SKETCH = "part int, doc_id long, text_hash long, n_shingles long, class binary, signature binary"


def sketches(docs: DataFrame, k: int, coordinates: int, parts: int) -> DataFrame:
    """One small row for each document; a null doc_id becomes NO_ID.  Equal sets have one class and one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, sigs = [], [], []
            for _, cuts, h in shingles(batch.column("text"), k):
                cuts, h = sets(cuts, h)
                sig = iter(signatures(cuts, h, coordinates))
                own = _names(cuts, h)
                sizes.append(np.diff(cuts))
                names += own
                sigs += [None if x is None else next(sig).tobytes() for x in own]
            part = [0 if x is None else int.from_bytes(x[:8], "little") % parts for x in names]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(id_array(batch.column("doc_id"))), batch.column("text_hash"), pa.array(np.concatenate(sizes) if sizes else [], pa.int64()), pa.array(names, pa.binary()), pa.array(sigs, pa.binary())],
                names=["part", "doc_id", "text_hash", "n_shingles", "class", "signature"],
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, _SKETCH)


def _matrix(column: pa.Array, coordinates: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, coordinates)


def _tokens(column: pa.Array, coordinates: int) -> np.ndarray:
    """Hash of every (coordinate, value) pair: rows x coordinates."""
    return R.mix(_matrix(column, coordinates).astype(U) | (np.arange(1, coordinates + 1, dtype=U) << U(32)))


_POSTED = "class binary, doc_id long, text_hash long, n_shingles long, signature binary, tokens array<long>"


def posted(known: DataFrame, coordinates: int, matches: int, buckets: int) -> DataFrame:
    """Classes that share at least ``matches`` pairs with others, with the pairs they are posted under.

    The pairs of a class are ordered by how many classes share them, rarest
    first; of m shared ones the first m - matches + 1 are enough: two classes
    with ``matches`` collisions have one of these in common.
    """
    one = F.min(F.struct("doc_id", "text_hash", "n_shingles", "signature")).alias("one")
    firsts = known.groupBy("part", "class").agg(one).select("part", "class", "one.*")

    def anchors(group: pa.Table):
        return _tokens(group["signature"], coordinates).ravel(), None

    told = S.tell(S.post(firsts, anchors, buckets), 1 << 62, powers=True)

    def choose(key: tuple, group: pa.Table, masks: pa.Table) -> pa.Table:
        tokens = _tokens(group["signature"], coordinates)
        keys, _ = S.distinct(tokens.ravel(), None, buckets)
        rare = np.full(len(keys), 255, np.int64)
        sent = dict(zip(masks["bucket"].to_pylist(), zip(masks["a"].to_pylist(), masks["c"].to_pylist())))
        for b, s, e in S.cut(keys, buckets):
            a, c = sent[b]
            m = np.unpackbits(np.frombuffer(a, np.uint8), count=e - s).astype(bool)
            rare[s:e][m] = np.frombuffer(c, np.uint8)
        mine = S.order_by_bucket(tokens, buckets)
        rank = rare[np.searchsorted(keys, mine)]
        shared = rank < 255
        count = shared.sum(axis=1)
        ok = np.flatnonzero(count >= matches)
        order = np.lexsort((mine[ok], rank[ok]), axis=1)
        lists = [mine[i][o[: count[i] - matches + 1]].astype(np.int64) for i, o in zip(ok, order)]
        own = group.take(pa.array(ok)).drop_columns(["part"])
        return own.append_column("tokens", pa.array(lists, pa.list_(pa.int64()))).select(["class", "doc_id", "text_hash", "n_shingles", "signature", "tokens"])

    return firsts.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(choose, _POSTED)


def compare(sizes: np.ndarray, signature: np.ndarray, contents: list[np.ndarray] | None, percent: int, matches: int, label: np.ndarray) -> np.ndarray:
    """Labels of the members under links; pairs that carry one label already aren't looked at.

    Collisions are counted over whole signatures (the prefix that brought a
    pair together and all the lists it skipped).  Pairs of enough collisions and
    of sizes that can be alike are links or, with ``contents``, are confirmed
    on their sets, the most alike first.
    """
    label = label.copy()
    for i in range(1, len(sizes)):
        j = np.flatnonzero(label[:i] != label[i])
        if not len(j):
            continue
        j = j[100 * np.minimum(sizes[j], sizes[i]) >= percent * np.maximum(sizes[j], sizes[i])]
        hits = (signature[j] == signature[i]).sum(axis=1)
        j, hits = j[hits >= matches], hits[hits >= matches]
        for x in j[np.argsort(-hits, kind="stable")].tolist():
            if label[x] == label[i]:
                continue
            if contents is not None:
                a, b = (contents[i], contents[x]) if sizes[i] < sizes[x] else (contents[x], contents[i])
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                both = int(np.count_nonzero(b[at] == a))
                if 100 * both < percent * (int(sizes[i] + sizes[x]) - both):
                    continue
            label[label == label[x]] = label[i]
    return label


_EDGE = "u binary, v binary"


def _linked(percent: int, matches: int, coordinates: int):
    """Links inside one group of rows (class, n_shingles, signature, perhaps content and label), as stars."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        names = group["class"].to_pylist()
        first = {}
        for i, x in enumerate(names):
            first.setdefault(x, i)
        at = sorted(first.values(), key=lambda i: names[i])
        own = group.take(pa.array(at))
        names = [names[i] for i in at]
        raw = own["content"].to_pylist() if "content" in own.column_names else None
        known = own["label"].to_pylist() if "label" in own.column_names else names
        label = compare(
            own["n_shingles"].to_numpy(), _matrix(own["signature"], coordinates), raw and [np.frombuffer(x, U) for x in raw], percent, matches,
            np.unique(np.array([x.hex() for x in known]), return_inverse=True)[1],
        )
        head = {}
        edges = [(head.setdefault(x, n), n) for x, n in zip(label.tolist(), names)]
        edges = [e for e in edges if e[0] != e[1]]
        return pa.Table.from_arrays([pa.array([e[0] for e in edges], pa.binary()), pa.array([e[1] for e in edges], pa.binary())], names=["u", "v"])

    return run


def forest(rows: DataFrame, percent: int, matches: int, coordinates: int, block: int, hubs: int = HUBS) -> tuple[DataFrame, bool]:
    """(u, v): links that connect all that the links of each ``grp`` of ``rows`` connect; whether a group was dealt out.

    A group of more than ``block`` classes is dealt into slices, each compared
    inside and with a few hubs, which connects most copies of one text.
    Members that the largest component of the group doesn't hold are then
    compared with every slice, in blocks of their own.
    """
    run = _linked(percent, matches, coordinates)
    large = written(rows.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > block), "large")
    if large.isEmpty():
        return written(in_runs(rows, ["grp"], run, _EDGE), "links"), False
    large = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    slices = F.coalesce(F.ceil(F.col("n") / (block // 2)), F.lit(1)).cast("int")
    rows = rows.join(large, "grp", "left").withColumn("slices", slices).withColumn("slice", F.pmod(F.xxhash64("class"), F.col("slices")).cast("int"))
    hub = rows.where("n IS NOT NULL").groupBy("grp", F.pmod(F.xxhash64("class", F.lit(1)), F.lit(hubs)).alias("h")).agg(F.min("class").alias("class")).select("grp", "class")
    apart = [c for c in rows.columns if c != "slice"]
    to_all = rows.join(hub, ["grp", "class"], "left_semi").select(*apart, F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    drop = ["n", "slices"]
    one = written(in_runs(rows.unionByName(to_all).drop(*drop), ["grp", "slice"], run, _EDGE), "links")
    labels = components(one).select(F.col("v").alias("class"), "label")
    big = rows.where("n IS NOT NULL")
    held = big.select("grp", "class", "slices").join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    held = written(held, "held")
    main = held.groupBy("grp", "label").agg(F.count("*").alias("k")).groupBy("grp").agg(F.max(F.struct("k", "label"))["label"].alias("main"))
    held = held.join(main, "grp")
    rest = held.where("label <> main").groupBy("grp").agg(F.count("*").alias("k")).withColumn("blocks", F.ceil(F.col("k") / (block // 2)).cast("int")).drop("k")
    held = held.join(rest, "grp").withColumn("left", F.col("label") != F.col("main")).select("grp", "class", "label", "left", "blocks")
    held = written(held, "rest")
    if held.isEmpty():
        return one, True
    every = big.join(held, ["grp", "class"])
    own = F.pmod(F.xxhash64("class", F.lit(2)), F.col("blocks")).cast("int")
    cols = [c for c in every.columns if c not in ("slice", "left", "blocks", "n", "slices")]
    to_blocks = every.select(*cols, "slice", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("blk"))
    to_slices = every.where("left").select(*cols, F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), own.alias("blk"))
    two = written(in_runs(to_blocks.unionByName(to_slices), ["grp", "slice", "blk"], run, _EDGE), "links")
    return written(one.unionAll(two), "links"), True


def candidates(post: DataFrame, percent: int, matches: int, coordinates: int, block: int) -> DataFrame:
    """(u, v): pairs of classes with at least ``matches`` collisions that connect all such pairs.

    Classes are merged list by list under the pairs they are posted under;
    lists of the same classes are merged once.
    """
    entries = post.select("class", F.explode("tokens").alias("grp"))
    lists = entries.groupBy("grp").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("class")).alias("a"), F.bit_xor(F.xxhash64("class", F.lit(1))).alias("b")).where("n > 1")
    lists = lists.groupBy("n", "a", "b").agg(F.min("grp").alias("grp")).select("grp")
    members = entries.join(lists, "grp").join(post.select("class", "n_shingles", "signature"), "class")
    return forest(written(members.select("grp", "class", "n_shingles", "signature"), "lists"), percent, matches, coordinates, block)[0]


def contents(docs: DataFrame, clusters: DataFrame, k: int, coordinates: int) -> DataFrame:
    """(grp, class, n_shingles, signature, content) of the classes of ``clusters`` (grp, class, doc_id, text_hash)."""
    wanted = small(clusters, BROADCAST_ROWS)
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").join(wanted, ["doc_id", "text_hash"])
    rows = rows.groupBy("grp", "class").agg(F.min("text").alias("text"))  # repeated rows count once, before the shuffle

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sigs, raw = [], [], []
            for _, cuts, h in shingles(batch.column("text"), k):
                cuts, h = sets(cuts, h)
                sizes += np.diff(cuts).tolist()
                sigs += [x.tobytes() for x in signatures(cuts, h, coordinates)]
                raw += [h[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("grp"), batch.column("class"), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(raw, pa.binary())],
                names=["grp", "class", "n_shingles", "signature", "content"],
            )

    return rows.mapInArrow(read, "grp binary, class binary, n_shingles long, signature binary, content binary")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, coordinates: int = COORDINATES, matches: int = MATCHES, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Shingles are ``shingle`` consecutive words (runs of anything but ASCII
    white space, A-Z lowered); a text of fewer words is one shingle, one
    without words has none and is linked with nothing.  Rows are linked if
    their sets' Jaccard similarity is at least ``percent`` / 100, confirmed on
    whole sets; component_id is the smallest doc_id that links reach, and
    ``kept`` says that it is the row's own.

    Rows with equal sets are one class from the start, whatever their number.
    Classes meet in the posting lists of the rarest (coordinate, value) pairs of
    their signatures (see :func:`posted`), where collisions are counted; pairs
    with ``matches`` or more, and what they connect, are confirmed on full
    sets.  A null doc_id is larger than any other; a row that reaches only null
    ids has a null component_id and stays.  Rows with a repeated doc_id are
    judged by their own texts.  An empty table gives no rows.
    """
    docs = texts(docs)
    width = S.width(docs)
    every = written(sketches(docs, shingle, coordinates, width * S.PARTS_PER_PARTITION), "sketches")
    known = every.where("class IS NOT NULL")
    post = written(posted(known, coordinates, matches, width), "posted")
    meets = components(candidates(post, percent, matches, coordinates, block))
    clusters = meets.select(F.col("v").alias("class"), F.col("label").alias("grp")).join(post.select("class", "doc_id", "text_hash"), "class")
    clusters = written(clusters, "clusters")
    links, dealt = forest(written(contents(docs, clusters, shingle, coordinates), "contents"), percent, matches, coordinates, block)
    label = components(links).select(F.col("v").alias("class"), "label") if dealt else links.select(F.col("v").alias("class"), F.col("u").alias("label"))
    least = known.groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).join(label, "class", "left").withColumn("label", F.coalesce("label", "class"))
    goal = written(least.select("class", "label", "least", "n"), "classes")
    ids = goal.groupBy("label").agg(F.min("least").alias("component"), F.sum("n").alias("rows"))
    linked = goal.join(ids.where("rows > 1"), "label").select("class", "component")
    real = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    rows = known.join(linked, "class", "left").select("doc_id", "n_shingles", "component")
    rows = rows.unionAll(every.where("class IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long")))
    reached = F.coalesce("component", "doc_id")
    out = rows.select(real.alias("doc_id"), "n_shingles", F.when(reached != NO_ID, reached).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op10_minhash": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT rid, len(ws) AS n, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM d),
g AS (SELECT rid, n, pos, list(w) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS g FROM w),
s AS (SELECT DISTINCT rid, md5(array_to_string(g, ' ')) AS k FROM g WHERE len(g) = 4 OR (n < 4 AND pos = 1)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.rid <> b.rid GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT r.a AS rid, min(t.doc_id) AS component_id FROM r JOIN d t ON t.rid = r.b GROUP BY r.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id IS NOT DISTINCT FROM component_id AS kept FROM d LEFT JOIN n ON n.rid = d.rid LEFT JOIN c ON c.rid = d.rid
"""
}
