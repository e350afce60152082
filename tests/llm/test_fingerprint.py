import hashlib
import math
from collections import Counter

import numpy as np
from cases import SF, awkward, frame
from pyspark.sql import functions as F

from vetra.llm import fingerprint


def edited(rows):
    """(doc_id, text) in falling order -> edited texts, by position."""
    out = []
    for i, (_, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        out.append(t[: len(t) - half] + after[:half])
    return out


def test_table(spark):
    got = {r.doc_id: r for r in fingerprint.op8_fingerprints(spark, SF).collect()}
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    assert len(got) == len(docs)
    by_text = {}
    for (d, t), e in zip(docs, edited(docs)):
        assert got[d].n_chars == len(t)
        assert got[d].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        by_text.setdefault(t, set()).add(got[d].fingerprint)
        by_text.setdefault(e, set()).add(got[d].edited_fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    for i, (d, _) in enumerate(docs):
        f, n = got[d].fingerprint, got[docs[(i + 1) % len(docs)][0]].fingerprint
        assert got[d].near_next == np.mean([f[j : j + 8] == n[j : j + 8] for j in range(0, len(f), 8)])
    assert np.mean([r.near_edited for r in got.values()]) > np.mean([r.near_next for r in got.values()]) + 0.1


def jaccard(a, b):
    a, b = Counter(a.lower().split()), Counter(b.lower().split())
    return sum((a & b).values()) / sum((a | b).values())


def test_collision_rate_is_generalised_jaccard(spark):
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(12):
        words = [f"w{int(x)}" for x in rng.zipf(1.4, 300) % 200]
        texts.append(" ".join(words[: rng.integers(50, 300)]))
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    n = 512
    got = {r.k: r.fingerprint for part in range(1) for r in fingerprint.fingerprints(df, ["k"], "text", 96).collect()}
    errors = []
    for i in range(12):
        for j in range(i):
            share = np.mean([got[i][x : x + 8] == got[j][x : x + 8] for x in range(0, 96 * 8, 8)])
            errors.append(share - jaccard(texts[i], texts[j]))
    assert n and abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.2


def test_awkward(spark):
    """Every row, null and repeated ids too: rows of one id follow each other by a hash of their texts."""
    docs = frame(spark)
    out = fingerprint.edits(docs)
    key = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    rows = [(r.doc_id, r.text) for r in sorted(key, key=lambda r: (r.k, r.h), reverse=True)]
    want = sorted(str((d, len(t), e)) for (d, t), e in zip(rows, edited(rows)))
    assert sorted(str((r.doc_id, r.n_chars, r.edited)) for r in out.collect()) == want
    got = {r.doc_id: r for r in out.collect()}
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    assert got[41].fingerprint == "0" * 8 * fingerprint.SAMPLES
    assert fingerprint.edits(frame(spark, [])).count() == 0
    one = fingerprint.edits(frame(spark, [(5, "abcd efgh", None, None, 0)])).collect()
    assert [(r.edited, r.near_next) for r in one] == [("abcd abcd", 1.0)]


def test_one_id_takes_several_ranges(spark):
    docs = frame(spark, [(None if i % 3 else i, f"text number {i}", None, None, 0) for i in range(600)])
    dealt = fingerprint.in_ranges(docs.select("doc_id", "text")).where("extra = 0").groupBy("range").count().collect()
    assert sum(r["count"] for r in dealt) == 600 and max(r["count"] for r in dealt) < 150
    assert fingerprint.edits(docs).count() == 600


def test_samples_against_scalar_code(spark):
    """Bids of gamma samples, computed one by one from the same hashes."""
    text, samples = "the cat and the dog and the bird saw the other bird of the north", 12
    terms = Counter(text.split())
    hashes = {(r.word, r.k): r.h for r in spark.createDataFrame([(w,) for w in terms], "word string").select("word", F.xxhash64("word").alias("term"), F.explode(F.sequence(F.lit(-samples), F.lit(samples - 1))).alias("k")).select("word", "k", F.xxhash64("term", "k").alias("h")).collect()}

    def uniforms(word, k):
        h = hashes[word, k] & (2**64 - 1)
        return [((h >> (21 * i) & (2**21 - 1)) + 0.5) / 2**21 for i in range(3)]

    want = []
    for k in range(samples):
        bids = []
        for word, w in terms.items():
            u2, u3, u4 = uniforms(word, k)
            e1, e2 = -math.log(uniforms(word, -1 - k)[0]), -math.log(u2)
            r, c = e1 + e2, -math.log(u3 * u4)
            b = e1 / r
            t = math.floor(math.log(w) / r + b)
            bids.append(c / math.exp(r * (t - b + 1)))
        want.append(min(bids))
    df = spark.createDataFrame(list(terms.items()), "word string, n int").select(F.xxhash64("word").alias("term"), F.col("n").cast("double").alias("w"))
    got = df.agg(*(F.min(fingerprint.sample(F.col("term"), F.col("w"), k)).alias(f"s{k}") for k in range(samples))).first()
    assert np.allclose(list(got), want, rtol=1e-9)
    prints = fingerprint.fingerprints(spark.createDataFrame([(0, text)], "i int, text string"), ["i"], "text", samples).first().fingerprint
    digits = spark.createDataFrame([tuple(got)], ", ".join(f"s{k} double" for k in range(samples))).select(*(F.substring(F.lpad(F.hex(F.xxhash64(f"s{k}")), 16, "0"), 1, 8).alias(f"s{k}") for k in range(samples))).first()
    assert prints == "".join(digits)


def test_no_python_on_the_main_path(spark):
    plan = fingerprint.op8_fingerprints(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert F
