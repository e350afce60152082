import random
import re

import numpy as np
from cases import SF, awkward, frame

from vetra.llm import minhash
from vetra.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def brute(rows, k):
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    for i, (d, _) in enumerate(rows):
        c = least.get(find(i))
        yield d, len(sets[i]), c, d == c


def test_table(spark):
    got = minhash.op10_minhash(spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, got)) == sorted(brute(docs, 4))
    assert any(not r.kept for r in got)


def test_awkward(spark):
    rows = [(r[0], r[1]) for r in awkward()]
    for block in (4000, 4):
        got = minhash.near_duplicates(frame(spark), block=block).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows, 4))), block
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_chains_of_near_copies(spark):
    rnd = random.Random(5)
    rows = []
    for g in range(4):
        words = [f"g{g}w{i}" for i in range(120)]
        for n in range(25):
            rows.append((100 * g + n, " ".join(words), "en", "s", 0))
            words = list(words)
            for _ in range(rnd.randint(1, 4)):
                words[rnd.randrange(120)] = f"x{rnd.random()}"
    want = sorted(brute([(r[0], r[1]) for r in rows], 4))
    for block in (4000, 6):
        assert sorted(map(tuple, minhash.near_duplicates(frame(spark, rows), block=block).collect())) == want


def test_components(spark):
    rnd = np.random.default_rng(1)
    names = [int(x) for x in rnd.integers(0, 1 << 40, 300)]
    pairs = [(names[i], names[i + 1]) for i in range(0, 150)] + [(names[a], names[b]) for a, b in rnd.integers(200, 300, (60, 2)).tolist()]
    got = {r.v: r.label for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {v for p in pairs if p[0] != p[1] for v in p} == set(got)
    groups, mine = {}, {}
    for v, label in got.items():
        groups.setdefault(find(v), set()).add(label)
        mine.setdefault(label, set()).add(find(v))
    assert all(len(x) == 1 for x in groups.values()) and all(len(x) == 1 for x in mine.values())


def test_shared_passages_are_no_clusters_and_large_clusters_are_dealt_out(spark):
    rnd = random.Random(9)
    passages = [" ".join(f"p{p}w{i}" for i in range(20)) for p in range(12)]
    rows = [(i, " ".join([*rnd.sample(passages, 4), *(f"own{i}w{j}" for j in range(30))]), "en", "s", 0) for i in range(150)]
    base = [f"b{i}" for i in range(200)]
    for n in range(60):
        own = list(base)
        for _ in range(rnd.randint(1, 5)):
            own[rnd.randrange(200)] = f"y{rnd.random()}"
        rows.append((1000 + n, " ".join(own), "en", "s", 0))
    want = sorted(brute([(r[0], r[1]) for r in rows], 4))
    assert len({c for d, _, c, _ in want if d < 1000}) == 150
    for block in (2000, 10):
        assert sorted(map(tuple, minhash.near_duplicates(frame(spark, rows), block=block).collect())) == want


def test_recall_near_the_threshold(spark):
    rnd = random.Random(21)
    rows = []
    for g in range(60):
        words = [f"g{g}w{i}" for i in range(200)]
        other = list(words)
        for at in range(rnd.randrange(10), 200, 41):
            other[at] = f"z{g}x{at}"
        rows += [(2 * g, " ".join(words), "en", "s", 0), (2 * g + 1, " ".join(other), "en", "s", 0)]
    want = sorted(brute([(r[0], r[1]) for r in rows], 4))
    assert sum(not k for *_, k in want) == 60
    assert sorted(map(tuple, minhash.near_duplicates(frame(spark, rows)).collect())) == want
