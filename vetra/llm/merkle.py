"""A Merkle manifest of a dataset: digests in aligned blocks, a proof for every row, and the check of that proof."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import in_runs, shuffle_width, small, table, workers_import, written

#: Nodes whose concatenation makes the node above them.
FANOUT = 2
#: Levels of an aligned block: FANOUT^LEVELS nodes (1,024) meet in one matrix, their node above stands for them in the next tier.
LEVELS = 10
#: Rows of languages, offsets or paths that are broadcast at most.
BROADCAST_ROWS = 200_000
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]

_HEX = np.array([list(f"{b:02x}".encode()) for b in range(256)], np.uint8)
_STEPS = "array<struct<left:binary,right:binary>>"


def framed(value: Column) -> Column:
    """Bytes that tell a value from any other: ``-`` for null, else byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, lang, leaf, other of every row: the digest of its five FIELDS, and that with n_chars + 1 where ``tampered`` holds and n_chars isn't null.

    Digests are 32 bytes.  Columns beyond FIELDS have no part in them.
    """
    d = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("decimal(20,0)"), F.col("text").cast("string"))
    digest = lambda n: F.unhex(F.sha2(F.concat(*(framed(n if c == "n_chars" else F.col(c)) for c in FIELDS)).cast("binary"), 256))
    return d.select("doc_id", "lang", digest(F.col("n_chars")).alias("leaf"), F.when(tampered & F.col("n_chars").isNotNull(), digest(F.col("n_chars") + 1)).alias("other"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with ``place``, their number from 0 in the order of the columns (nulls first); written.

    Rows are dealt into ranges and sorted there; the ranges' sizes, one row for each, give the offsets.
    """
    inside = "place"
    put = rows.repartitionByRange(shuffle_width(rows.sparkSession), *(F.asc_nulls_first(c) for c in order)).sortWithinPartitions(*(F.asc_nulls_first(c) for c in order))
    put = written(put.withColumn(inside, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(inside, 33)
    sizes = put.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each shuffle partition
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("part", before.alias("before")))
    return put.withColumn("part", part).join(offsets, "part").withColumn(inside, F.col("before") + F.col(inside).bitwiseAND((1 << 33) - 1)).drop("part", "before")


def hex_rows(digests: np.ndarray) -> np.ndarray:
    """(n, 32) bytes as (n, 64) lower-case hexadecimal digits."""
    return _HEX[digests].reshape(len(digests), 64)


def raw_rows(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), 32)


def hashed(rows: Iterable[bytes]) -> np.ndarray:
    """The digests of the rows, as a matrix of hexadecimal digits."""
    out = b"".join(hashlib.sha256(r).hexdigest().encode() for r in rows)
    return np.frombuffer(out, np.uint8).reshape(-1, 64)


def runs_of(level: np.ndarray, fanout: int) -> tuple[np.ndarray, np.ndarray]:
    """The level's nodes as one row for each run of ``fanout`` (the last is filled up), and how many nodes each run has."""
    n = -(-len(level) // fanout)
    full = np.zeros((n * fanout, 64), np.uint8)
    full[: len(level)] = level
    held = np.full(n, fanout)
    if n:
        held[-1] = len(level) - (n - 1) * fanout
    return full.reshape(n, fanout * 64), held


def levels_of(block: np.ndarray, levels: int | None, fanout: int) -> list[np.ndarray]:
    """All levels above and with ``block`` (hexadecimal rows): ``levels`` of them more, or until one node is left where that is None."""
    out = [block]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        runs, held = runs_of(out[-1], fanout)
        out.append(hashed(r[: 64 * k].tobytes() for r, k in zip(runs, held.tolist())))
    return out


def climbed(levels: list[np.ndarray], at: np.ndarray, start: np.ndarray, fanout: int) -> tuple[list[list[tuple[bytes, bytes]]], np.ndarray]:
    """For the nodes ``at`` of the lowest level: the siblings left and right of each one's way up, and the node at the top if ``start`` stood in their places."""
    steps: list[list[tuple[bytes, bytes]]] = [[] for _ in at]
    index, now = at.copy(), start
    for level in levels[:-1]:
        runs, held = runs_of(level, fanout)
        run, slot = index // fanout, index % fanout
        mine = runs[run]  # a copy: one row of siblings for each node
        inside = mine.reshape(len(at), fanout, 64)
        for way, row, s, k in zip(steps, mine, slot.tolist(), held[run].tolist()):
            way.append((row[: 64 * s].tobytes(), row[64 * (s + 1) : 64 * k].tobytes()))
        inside[np.arange(len(at)), slot] = now
        now = hashed(row[: 64 * k].tobytes() for row, k in zip(mine, held[run].tolist()))
        index = run
    return steps, now


def folded(node: bytes, steps: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in steps:
        node = hashlib.sha256(left + node + right).hexdigest().encode()
    return node


def _pick(group: pa.Table, name: str) -> np.ndarray:
    return group.column(name).to_numpy(zero_copy_only=False)


def ordered_block(group: pa.Table, fanout: int, levels: int) -> tuple[pa.Array, list[np.ndarray]]:
    """The order of a block's rows by place, and the levels of the block: all of a tree that has no other, else ``levels`` of them."""
    order = pa.array(np.argsort(_pick(group, "place"), kind="stable"))
    block = hex_rows(raw_rows(group.column("digest").take(order).to_pylist()))
    alone = group.column("n")[0].as_py() <= fanout**levels
    return order, levels_of(block, None if alone else levels, fanout)


class Forest:
    """Trees over ``nodes`` (tree long, place long, n long, digest binary): place counts from 0 in each tree, n is its number of nodes.

    Every tier cuts the nodes of a tree into aligned blocks, one group each;
    the nodes above the blocks are the nodes of the next tier, until each tree
    has one block.  A tier is written, so lost executors cost no more than its
    tasks; there are log(n) / LEVELS of them, 4 for 10^12 rows.
    """

    def __init__(self, nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> None:
        workers_import(nodes.sparkSession)
        self.fanout, self.levels, self.width = fanout, levels, fanout**levels
        self.tiers = [nodes]
        most = nodes.agg(F.max("n")).first()[0] or 0
        while most > self.width:
            self.tiers.append(written(self._tops(self.tiers[-1]), "tier"))
            most = -(-most // self.width)

    def _blocks(self, nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("block", F.expr(f"place div {self.width}"))

    def _tops(self, nodes: DataFrame) -> DataFrame:
        """One node for each block: a tier's nodes from those of the tier below."""
        fanout, levels, width = self.fanout, self.levels, self.width

        def run(key: tuple, group: pa.Table) -> pa.Table:
            top = bytes.fromhex(ordered_block(group, fanout, levels)[1][-1].tobytes().decode())
            n = -(-group.column("n")[0].as_py() // width)
            return pa.table([[key[0]], [key[1]], [n], pa.array([top], pa.binary())], names=["tree", "place", "n", "digest"])

        blocks = self._blocks(nodes).select("tree", "block", "place", "n", "digest")
        return in_runs(blocks, ["tree", "block"], run, "tree long, place long, n long, digest binary")

    def roots(self) -> DataFrame:
        """(tree, root) of every tree; root has 32 bytes."""
        one = Forest._tops(self, self.tiers[-1])
        return one.select("tree", F.col("digest").alias("root"))

    def ways(self, above: DataFrame, lowest: bool = True) -> DataFrame:
        """(tree, block, steps, subroot, root) of every lowest node, block being its place: its siblings up to the root and on by ``above``.

        ``above`` has (tree, steps, subroot, root): how the root of each tree goes on.
        Without ``lowest``: of the blocks of the lowest nodes.
        """
        way = above.select("tree", F.lit(0).cast("long").alias("block"), "steps", "subroot", "root")
        for tier in reversed(self.tiers if lowest else self.tiers[1:]):
            way = written(self._down(tier.withColumn("other", F.lit(None).cast("binary")), way, None), "ways")
        return way

    def proofs(self, above: DataFrame, keep: str) -> DataFrame:
        """The columns ``keep`` ("name type, ...") of the lowest nodes and subroot, root, proof_sha256, folded_root (hexadecimal digits).

        The nodes need a column ``other``: the digest to fold in their place, or null.  For ``above`` see :meth:`ways`.
        """
        return self._down(self.tiers[0], self.ways(above, lowest=False), keep)

    def _down(self, nodes: DataFrame, way: DataFrame, keep: str | None) -> DataFrame:
        """From the ways of the blocks to those of their nodes, or, with ``keep``, to the proofs."""
        fanout, per_block = self.fanout, self.levels
        names = [f.split()[0] for f in keep.split(",")] if keep else []
        # a block meets its way as one more row of its group: nothing is repeated for every node
        rows = self._blocks(nodes).select("tree", "block", "place", "n", "digest", "other", *names)
        none = lambda c, kind: F.lit(None).cast(kind).alias(c)
        lone = way.select("tree", "block", *(none(c, rows.schema[c].dataType) for c in rows.columns[2:]), "steps", "subroot", "root")
        both = rows.select("*", none("steps", _STEPS), none("subroot", "string"), none("root", "string")).unionAll(lone)
        out = f"{keep}, subroot string, root string, proof_sha256 string, folded_root string" if keep else f"tree long, block long, steps {_STEPS}, subroot string, root string"

        def run(key: tuple, group: pa.Table) -> pa.Table:
            is_way = np.asarray(group.column("place").is_null())
            head = group.filter(pa.array(is_way)).slice(0, 1).to_pylist()[0]
            rest = [(s["left"], s["right"]) for s in head["steps"]]
            group = group.filter(pa.array(~is_way))
            order, levels = ordered_block(group, fanout, per_block)
            group = group.take(order)
            own = levels[0].copy()
            for i, value in enumerate(group.column("other").to_pylist()):
                if value is not None:
                    own[i] = hex_rows(np.frombuffer(value, np.uint8).reshape(1, 32))[0]
            steps, tops = climbed(levels, np.arange(len(own)), own, fanout)
            if keep is None:
                ways = [[{"left": x, "right": y} for x, y in [*s, *rest]] for s in steps]
                kind = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))
                same = [pa.array([head[c]] * len(own), pa.string()) for c in ("subroot", "root")]
                return pa.table([group.column("tree"), group.column("place"), pa.array(ways, kind), *same], names=["tree", "block", "steps", "subroot", "root"])
            tail = b"".join(x + y for x, y in rest)
            known: dict[bytes, str] = {}
            ends = []
            for top in tops:
                top = top.tobytes()
                if top not in known:
                    known[top] = folded(top, rest).decode()
                ends.append(known[top])
            proof = [hashlib.sha256(b"".join(x + y for x, y in s) + tail).hexdigest() for s in steps]
            same = [pa.array([head[c]] * len(own), pa.string()) for c in ("subroot", "root")]
            return pa.table([*(group.column(c) for c in names), *same, pa.array(proof, pa.string()), pa.array(ends, pa.string())], names=[*names, "subroot", "root", "proof_sha256", "folded_root"])

        return in_runs(both, ["tree", "block"], run, out)


def manifest(docs: DataFrame, tampered: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of ``docs``.

    A tree for each ``lang`` (null is one of its own) over its rows by doc_id,
    then a tree over the languages' roots, null first, then by bytes.  Every
    ``fanout`` consecutive nodes of a level make one above, the last run maybe
    fewer.  proof_sha256 is the digest of all siblings on a leaf's way, from its
    level up, left to right.  folded_root is what that way makes of the leaf,
    or of its tampered form where ``tampered`` holds (a column over ``docs``;
    null counts as no), and verified says whether it is root.

    A null doc_id comes first; rows of the same doc_id are ordered by their
    leaves, so rows that tie in all are the same leaf.  A null n_chars isn't
    tampered with.  An empty table gives an empty table.
    """
    workers_import(docs.sparkSession)
    tampered = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    rows = written(leaves(docs, tampered).withColumn("row", F.monotonically_increasing_id()), "leaves")
    placed = numbered(rows, "lang", "doc_id", "leaf", "row")
    langs = numbered(placed.groupBy("lang").agg(F.min("place").alias("first"), F.count("*").alias("n")), "lang").withColumnRenamed("place", "tree")
    langs = written(langs, "languages")
    r, t = placed.alias("r"), small(langs, BROADCAST_ROWS).alias("t")
    nodes = r.join(t, F.expr("r.lang <=> t.lang")).selectExpr("t.tree", "r.place - t.first AS place", "t.n", "r.leaf AS digest", "r.other", "r.doc_id", "lower(hex(r.leaf)) AS leaf")
    forest = Forest(nodes, fanout, levels)
    subroots = written(forest.roots(), "subroots")
    top = Forest(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(langs.count()).cast("long").alias("n"), F.col("root").alias("digest")), fanout, levels)
    whole = top.roots().select("tree", F.array().cast(_STEPS).alias("steps"), F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("root")).alias("root"))
    ways = top.ways(whole).select(F.col("block").alias("tree"), "steps", "root")
    above = ways.join(subroots.select("tree", F.lower(F.hex("root")).alias("subroot")), "tree")
    out = forest.proofs(above, "doc_id long, leaf string")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)


_FRAMED = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in FIELDS)
_FRAMED_OTHER = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ["doc_id", "source", "lang", "(n_chars + 1)", "text"])
#: All levels of the trees as rows, the way of each leaf as joins on its index at each level; crc32 bit by bit over the digits.
ORACLE_SQL = {
    "op12_merkle": f"""WITH RECURSIVE lf AS (SELECT doc_id, lang, n_chars, sha256({_FRAMED}) AS leaf, sha256({_FRAMED_OTHER}) AS other FROM documents),
crc AS (SELECT doc_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, 8 * len(CAST(doc_id AS VARCHAR))), lambda i: CAST(CASE WHEN i % 8 = 0 THEN ascii(CAST(doc_id AS VARCHAR)[i // 8 + 1]) ELSE 0 END AS BIGINT))),
  lambda c, x: CASE WHEN xor(c, x) & 1 = 1 THEN xor(xor(c, x) >> 1, 3988292384) ELSE xor(c, x) >> 1 END), 4294967295) AS crc FROM documents WHERE doc_id IS NOT NULL),
pl AS (SELECT lf.*, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, coalesce(crc % 7 = 0, false) AND n_chars IS NOT NULL AS bad FROM lf LEFT JOIN crc USING (doc_id)),
low(tree, lv, i, d, n) AS (SELECT tree, 0, i, leaf, count(*) OVER (PARTITION BY tree) FROM pl
  UNION ALL SELECT tree, lv + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (max(n) + 1) // 2 FROM low WHERE n > 1 GROUP BY tree, lv, i // 2),
sub AS (SELECT tree, d AS subroot FROM low WHERE n = 1),
high(lv, i, d, n) AS (SELECT 0, tree - 1, subroot, count(*) OVER () FROM sub UNION ALL SELECT lv + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (max(n) + 1) // 2 FROM high WHERE n > 1 GROUP BY lv, i // 2),
top AS (SELECT d AS root FROM high WHERE n = 1),
mine AS (SELECT doc_id, tree, i, leaf, CASE WHEN bad THEN other ELSE leaf END AS start, unnest(range(0, 64)) AS lv FROM pl),
st AS (SELECT m.tree, m.i, m.lv, CAST(low.i AS BIGINT) AS own, sib.d AS sibling FROM mine m JOIN low ON low.tree = m.tree AND low.lv = m.lv AND low.i = m.i >> CAST(m.lv AS INTEGER) AND low.n > 1 LEFT JOIN low sib ON sib.tree = low.tree AND sib.lv = low.lv AND sib.i = xor(CAST(low.i AS BIGINT), 1)
  UNION ALL SELECT p.tree, p.i, 100 + h.lv, CAST(h.i AS BIGINT), sib.d FROM pl p JOIN high h ON h.i = (p.tree - 1) >> CAST(h.lv AS INTEGER) AND h.n > 1 LEFT JOIN high sib ON sib.lv = h.lv AND sib.i = xor(CAST(h.i AS BIGINT), 1)),
sq AS (SELECT *, row_number() OVER (PARTITION BY tree, i ORDER BY lv) AS k FROM st),
pf AS (SELECT tree, i, sha256(coalesce(string_agg(sibling, '' ORDER BY lv), '')) AS proof FROM sq GROUP BY tree, i),
fo(tree, i, k, d) AS (SELECT tree, i, 0, CASE WHEN bad THEN other ELSE leaf END FROM pl
  UNION ALL SELECT fo.tree, fo.i, fo.k + 1, sha256(CASE WHEN own % 2 = 1 THEN coalesce(sibling, '') || d ELSE d || coalesce(sibling, '') END) FROM fo JOIN sq ON sq.tree = fo.tree AND sq.i = fo.i AND sq.k = fo.k + 1),
en AS (SELECT tree, i, arg_max(d, k) AS folded_root FROM fo GROUP BY tree, i)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified FROM pl JOIN sub USING (tree) JOIN en USING (tree, i) LEFT JOIN pf USING (tree, i) CROSS JOIN top"""
}
