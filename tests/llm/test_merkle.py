import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from vetra.llm import merkle

from cases import SF, frame


def _h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(r, more: int = 0) -> str:
    n = None if r["n_chars"] is None else r["n_chars"] + more
    values = [r["doc_id"], r["source"], r["lang"], n, r["text"]]
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _above(nodes: list[str], fanout: int) -> list[str]:
    return [_h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]


def _way(nodes: list[str], i: int, fanout: int) -> tuple[str, list[tuple[list[str], list[str]]]]:
    """The root, and the siblings left and right on the way from node i."""
    steps = []
    while len(nodes) > 1:
        s = i // fanout * fanout
        run = nodes[s : s + fanout]
        steps.append((run[: i - s], run[i - s + 1 :]))
        nodes, i = _above(nodes, fanout), i // fanout
    return nodes[0], steps


def _brute(rows: list, tampered, fanout: int) -> list[tuple]:
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted((r for r in rows if r["lang"] == x), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r))) for x in langs}
    subroots = [_way([_leaf(r) for r in trees[x]], 0, fanout)[0] for x in langs]
    out = []
    for k, x in enumerate(langs):
        nodes = [_leaf(r) for r in trees[x]]
        for i, r in enumerate(trees[x]):
            (sub, low), (root, high) = _way(nodes, i, fanout), _way(subroots, k, fanout)
            proof = "".join("".join(a + b) for a, b in low + high)
            now = _leaf(r, 1 if tampered(r) and r["n_chars"] is not None else 0)
            for a, b in low + high:
                now = _h(*a, now, *b)
            out.append((r["doc_id"], nodes[i], sub, root, _h(proof), now, now == root))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def _got(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def _seventh(r) -> bool:
    return r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0


@pytest.mark.parametrize(("fanout", "levels"), [(2, 10), (2, 2), (3, 1)])
def test_awkward_rows_by_brute_force_in_blocks_of_several_sizes(spark, fanout, levels):
    docs = frame(spark).withColumn("n_chars", F.expr("CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id = 3 THEN 9223372036854775807 ELSE n_chars END"))
    got = _got(merkle.manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, fanout, levels))
    assert got == _brute(docs.collect(), _seventh, fanout)
    assert {x[-1] for x in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 9])
def test_every_number_of_leaves(spark, n):
    rows = [(i, f"text {i}", "en" if i % 3 else None, "s", i) for i in range(n)]
    assert _got(merkle.manifest(frame(spark, rows), levels=2)) == _brute(frame(spark, rows).collect(), lambda r: False, 2)


def test_many_languages_make_tiers_of_their_own(spark):
    rows = [(i, "x", f"l{i % 23}", None, i) for i in range(60)]
    assert _got(merkle.manifest(frame(spark, rows), F.col("doc_id") == 5, levels=1)) == _brute(frame(spark, rows).collect(), lambda r: r["doc_id"] == 5, 2)


def test_no_rows(spark):
    assert merkle.manifest(frame(spark, [])).count() == 0


def test_the_frame_tells_values_apart(spark):
    rows = [(1, "-", "a", None, 1), (1, None, "a", "-", 1), (1, "", "a", "1:-", 1), (1, "é", "a", "", 1)]
    got = merkle.manifest(frame(spark, rows)).select("leaf").collect()
    assert len({r["leaf"] for r in got}) == 4


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert _got(merkle.op12_merkle(spark, SF)) == _brute(docs, _seventh, 2)
