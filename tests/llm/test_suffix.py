import hashlib
import random
from collections import Counter

from cases import SF, awkward, frame

from vetra.llm import suffix


def brute(rows, size):
    raw = [(t or "").encode() for _, t in rows]
    n = Counter(b[i : i + size] for b in raw for i in range(len(b) - size + 1))
    for (d, _), b in zip(rows, raw):
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if n[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        yield d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()


def test_table(spark):
    got = suffix.op7_suffix_dedup(spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, got)) == sorted(brute(docs, 200))
    assert any(r.n_removed for r in got)


def test_awkward_with_and_without_hot_anchors(spark):
    docs = [(r[0], r[1]) for r in awkward()]
    for size, gram, hot in ((30, 12, 1 << 20), (30, 30, 1 << 20), (30, 12, 3), (200, 48, 4096)):
        got = suffix.deduplicate(frame(spark), size, gram, hot).collect()
        have = sorted(str((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest())) for r in got)
        assert have == sorted(map(str, brute(docs, size))), (size, gram, hot)
    assert suffix.deduplicate(frame(spark, [])).count() == 0


def test_repeats_with_one_name_are_one_string(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    raw = {r.doc_id: r.text.encode() for r in rows}
    named = {}
    for r in suffix.deduplicate(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        for x in r.repeats:
            named.setdefault(x.repeat, set()).add((r.doc_id, x.start, x.length))
    assert named
    for own in named.values():
        assert len({raw[d][s : s + n] for d, s, n in own}) == 1
        assert len({n for _, _, n in own}) == 1


def groups(contexts, starts, many, least):
    """All strings of ``least`` or more that start at several places (a many context counts twice) and can't be longer to the right or the left."""
    places = {}
    for k, c in enumerate(contexts):
        for i in range(starts[k]):
            for j in range(i + least, len(c) + 1):
                places.setdefault(c[i:j], set()).add((k, i))
    out = {}
    for s, at in places.items():
        n = sum(2 if many[k] else 1 for k, _ in at)
        right = {contexts[k][i + len(s) : i + len(s) + 1] if i + len(s) < len(contexts[k]) else (k, i) for k, i in at}
        right_open = len(right) > 1 or any(isinstance(x, tuple) for x in right)
        before = {contexts[k][i - 1] if i else None for k, i in at}
        if n > 1 and right_open and (None in before or len(before) > 1):
            out[s] = at
    return out


def test_maximal_repeats_against_brute_force():
    rnd = random.Random(3)
    for _ in range(200):
        contexts = list({bytes(rnd.choice(b"ab") for _ in range(rnd.randint(4, 30))) for _ in range(rnd.randint(2, 6))})
        least = rnd.randint(2, 5)
        starts = [len(c) - least + 1 for c in contexts]
        if min(starts) < 1:
            continue
        many = [rnd.random() < 0.4 for _ in contexts]
        got = {}
        for k, s, length, name in zip(*(x.tolist() for x in suffix.maximal_repeats(contexts, starts, many, least))):
            got.setdefault(name, set()).add((contexts[k][s : s + length], k, s))
        assert all(len({x for x, _, _ in own}) == 1 for own in got.values())
        assert {next(iter(own))[0]: {(k, s) for _, k, s in own} for own in got.values()} == groups(contexts, starts, many, least)
