import hashlib
import re

from cases import SF, awkward, frame

from vetra.llm import rlz

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size):
    first = {}
    big = 1 << 62
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            first[k] = min(first.get(k, big), big if d is None else d)
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < (big if d is None else d):
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        yield d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()


def test_table(spark):
    got = rlz.op4_substring_dedup(spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, got)) == sorted(brute(docs, 13))
    assert any(r.n_removed for r in got)


def test_awkward(spark):
    for size in (4, 13):
        got = rlz.deduplicate(frame(spark), min_words=size).collect()
        want = sorted(map(str, brute([(r[0], r[1]) for r in awkward()], size)))
        assert sorted(str((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest())) for r in got) == want
    assert rlz.deduplicate(frame(spark, [])).count() == 0


def test_factors_name_their_source(spark):
    docs = {r.doc_id: WORD.findall(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    n = 0
    for r in rlz.deduplicate(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        for f in r.factors:
            n += 1
            assert f.source < r.doc_id and f.words >= 13
            assert docs[r.doc_id][f.start : f.start + f.words] == docs[f.source][f.source_start : f.source_start + f.words]
    assert n


def test_factors_after_documents_without_words(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = frame(spark, [(i, "" if i % 2 else text, "en", "s", 0) for i in range(40)])
    for r in rlz.deduplicate(docs).collect():
        assert [(f.start, f.words, f.source, f.source_start) for f in r.factors] == ([(0, 30, 0, 0)] if r.doc_id and r.doc_id % 2 == 0 else [])


def test_a_factor_goes_on_through_smaller_sources(spark):
    long = [f"w{i}" for i in range(100)]
    docs = [(1, " ".join(["a", *long[40:55], "b"])), (2, " ".join(long)), (3, " ".join(["x", *long, "y"])), (4, " ".join([*long[80:], *long[:30]]))]
    got = {r.doc_id: [(f.start, f.words, f.source, f.source_start) for f in r.factors] for r in rlz.deduplicate(frame(spark, [(d, t, "en", "s", 0) for d, t in docs])).collect()}
    assert got == {1: [], 2: [(40, 15, 1, 1)], 3: [(1, 100, 2, 0)], 4: [(0, 20, 2, 80), (20, 30, 2, 0)]}


def test_removed_words_are_those_of_factors(spark, monkeypatch):
    assert rlz.factors([(0, 20, 5, 0), (3, 40, 6, 0), (10, 25, 7, 0), (38, 60, 8, 0), (70, 90, 9, 0)]) == [(0, 20, 5, 0), (3, 40, 6, 0), (38, 60, 8, 0), (70, 90, 9, 0)]
    text = " ".join(f"w{i}" for i in range(40))
    docs = frame(spark, [(1, text, "en", "s", 0), (2, text, "en", "s", 0)])
    assert {r.doc_id: r.n_removed for r in rlz.deduplicate(docs).collect()} == {1: 0, 2: 40}
