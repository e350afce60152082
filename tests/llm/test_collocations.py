import re
from collections import Counter

import pytest

from cases import SF, awkward, frame
from vetra.llm import collocations


def _brute(rows, least, longest, inside, top):
    n, f = Counter(), Counter()
    for r in rows:
        lang = "und" if r["lang"] is None else r["lang"]
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    cand = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    held = Counter()
    for (lang, p), a in cand.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                held[lang, p[i : i + k]] = max(held[lang, p[i : i + k]], a)
    out = []
    for (lang, p), a in cand.items():
        if 100 * held[lang, p] >= inside * a:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    rank = Counter()
    done = []
    for x in out:
        rank[x[0]] += 1
        if rank[x[0]] <= top:
            done.append((x[0], rank[x[0]], *x[1:]))
    return done


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1]))


_MORE = [(60, "A.B,c;d:e!f?g\x0bh\x0ci\rj a b\ta  b", None, "s", 1), (61, "... ,,, \t", "en", "s", 1), (62, "a b a b a b a b.a b a b", "und", "s", 1), (63, "ÄÖ äö ÄÖ äö", "fr", "s", 1)]


@pytest.mark.parametrize(("least", "inside", "top", "buckets"), [(2, 100, 2000, None), (3, 60, 5, 1 << 16), (12, 100, 2000, 1 << 16)])
def test_awkward_rows_by_brute_force(spark, monkeypatch, least, inside, top, buckets):
    monkeypatch.setattr(collocations, "CHUNK", 300)
    docs = frame(spark, awkward() + _MORE)
    want = _brute(docs.collect(), least, 5, inside, top)
    assert want
    assert _got(collocations.collocations(docs, least, 5, inside, top, buckets)) == want


def test_no_rows(spark):
    assert collocations.collocations(frame(spark, [])).count() == 0


def test_joined_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BROADCAST_BYTES", 0)
    docs = frame(spark)
    assert _got(collocations.collocations(docs, 4, 3)) == _brute(docs.collect(), 4, 3, 100, 2000)


def test_score_is_exact_beyond_64_bits(spark):
    big = 10**15 + 7
    phrases = spark.createDataFrame([("en", "a", 1, big + 2), ("en", "b", 1, big + 1), ("en", "a b", 2, big)], "lang string, phrase string, k int, a long")
    totals = spark.createDataFrame([("en", 9 * big)], "lang string, n long")
    assert [r["score"] for r in collocations.scored(phrases, totals).collect()] == [1000 * big * 9 * big // ((big + 2) * (big + 1))]


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert _got(collocations.op13_collocations(spark, SF)) == _brute(docs, 100, 5, 100, 2000)


def test_a_very_long_text(spark):
    rows = [(1, "x y z. " * 100_000, "en", "s", 1)]
    got = [tuple(r)[2:7] for r in collocations.collocations(frame(spark, rows)).collect()]
    assert got == [("x y z", 100_000, 100_000, 100_000, 300_000)]
