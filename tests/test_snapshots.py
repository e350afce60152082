import random

import numpy as np
import pytest

from vetra.operators import snapshots


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


@pytest.mark.parametrize("seed", range(300))
def test_scripts_are_shortest_and_leave_a_common_text(seed):
    rnd = random.Random(seed)
    kinds = rnd.choice([1, 2, 3, 5, 30])
    a = [rnd.randrange(kinds) for _ in range(rnd.randrange(0, 25))]
    b = [x for x in a if rnd.random() < 0.8] if rnd.random() < 0.5 else [rnd.randrange(kinds) for _ in range(rnd.randrange(0, 25))]
    for _ in range(rnd.randrange(3)):
        b.insert(rnd.randrange(len(b) + 1), rnd.randrange(kinds))
    marks = snapshots.added(np.array(a, np.int64), np.array(b, np.int64))
    kept = [x for x, m in zip(b, marks) if not m]
    assert len(kept) == lcs(a, b)
    rest = iter(a)
    assert all(x in rest for x in kept)


def test_large_texts_that_share_nothing_but_order():
    a, b = np.arange(30_000) % 977, (np.arange(30_000) * 7 + 3) % 983
    marks = snapshots.added(np.arange(20_000), np.concatenate([np.arange(0, 20_000, 2), np.arange(5)]))
    assert marks.sum() == 5
    assert snapshots.added(a[:3000], b[:3000]).sum() == 3000 - lcs(a[:3000].tolist(), b[:3000].tolist())


def test_ranges_of_files(spark):
    now = [("same", "a\nb\n"), ("new", "x\n"), ("less", "a\n"), ("two", "a\nX\nb\nc\nY\nZ\n"), ("end", "a\nb"), ("empty", ""), ("null", None)]
    then = [("same", "a\nb\n"), ("less", "a\nb\n"), ("two", "a\nb\nc\n"), ("end", "a\nb\n"), ("gone", "q\n"), ("empty", "a\n"), ("null", "a")]
    got = snapshots.changed_ranges(spark.createDataFrame(now, "path string, content string"), spark.createDataFrame(then, "path string, content string"))
    assert sorted(map(tuple, got.collect())) == [("end", 2, 2), ("new", 1, snapshots.WHOLE), ("two", 2, 2), ("two", 5, 6)]


def test_the_deepest_root_owns_a_file(spark):
    files = spark.createDataFrame([(p,) for p in ["a.py", "./x/b.py", "x/y/c.py", "x/yy/d.py", "z/e.py", "x/y/c.py", "x/y"]], "path string")
    roots = spark.createDataFrame([("x",), ("x/y/",), ("q",)], "path string")
    got = sorted(map(tuple, snapshots.owned(files, roots).collect()), key=str)
    assert got == sorted([("a.py", None, None), ("./x/b.py", "x", "b.py"), ("x/y/c.py", "x/y", "c.py"), ("x/y/c.py", "x/y", "c.py"), ("x/yy/d.py", "x", "yy/d.py"), ("z/e.py", None, None), ("x/y", "x", "y")], key=str)
    whole = snapshots.owned(files, spark.createDataFrame([(".",), ("x",)], "path string"))
    assert {(r.path, r.repository, r.inside) for r in whole.collect()} >= {("a.py", ".", "a.py"), ("z/e.py", ".", "z/e.py"), ("x/y", "x", "y")}


def test_roots_are_found(spark):
    of = lambda *paths, **more: sorted(r.path for r in snapshots.discovered_roots(spark.createDataFrame([(p,) for p in paths], "path string"), **more).collect())
    paths = ["a/.git", "a/b/.git/x/.git", "c/.github/x", "d", "vendor/.git/x", "vendor/q/.git/x", "e/vendor/q/.git", "f/g/.git/config", "ab/.git"]
    assert of(*paths) == ["a", "ab", "f/g", "vendor"]
    assert of(*paths, nested=True) == ["a", "a/b", "ab", "e/vendor/q", "f/g", "vendor", "vendor/q"]
    assert of(*paths, ".git/config") == ["."]
    assert of("x") == []
