import corpus_pipeline as P
import test_decontaminate
import test_minhash
import test_packing
import test_secrets
from cases import SF, awkward, frame
from pyspark.sql import functions as F

from vetra.llm import language, packing, secrets


def as_rows(df):
    assert df.columns == P.COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


def test_every_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.Classifier(language.fit(docs))
    rows = as_rows(docs)

    def through(name, stage, rows):
        return as_rows(stage(spark, spark.createDataFrame(rows, docs.schema), SF))

    got = through("language", P.identified, rows)
    kept = [(r, model.predict(r[1])) for r in rows]
    assert got == [(d, t, p[0], s, n) for (d, t, _, s, n), p in kept if p[0] != "und" and p[2] >= language.MARGIN]
    assert len(got) > 0.95 * len(rows)

    rows = got
    got = through("near", P.deduplicated, rows)
    stays = {d for d, _, _, k in test_minhash.brute([(r[0], r[1]) for r in rows], P.SHINGLE) if k}
    assert got == [r for r in rows if r[0] in stays] and len(got) < len(rows)

    rows = got
    got = through("bench", P.decontaminated, rows)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {x[0] for x in test_decontaminate.brute([(r[0], r[1]) for r in rows], items) if not x[5]}
    assert got == [r for r in rows if r[0] in clean] and len(got) < len(rows)

    rows = [*got, (10**6, 'x token = "0123456789abcdef0123456789abcdef01234567" y', "en", "s", 1)]
    got = through("secrets", P.redacted, rows)
    assert [r[0] for r in got] == [r[0] for r in sorted(rows, key=str)]
    extra = {r.doc_id: r.random for r in secrets.scan(spark.createDataFrame(rows, docs.schema)).collect()}
    for before, after in zip(sorted(rows, key=str), got):
        spans = sorted([(s, e) for s, _, e in test_secrets.base(before[1])] + [(s.start, s.end) for s in extra[before[0]]])
        text, at = "", 0
        for s, e in spans:
            if s >= at:
                text += before[1][at:s] + P.MASK
            at = max(at, e)
        assert after[1] == text + before[1][at:]
        assert after[4] == (len(after[1]) if spans else before[4])
    assert (10**6, f"x {P.MASK} y") not in {r[:2] for r in got} and any(P.MASK in r[1] for r in got)

    out = P.packed(spark, spark.createDataFrame(got, docs.schema), SF).collect()
    test_packing.check(out, [(r[0], r[1]) for r in got], packing.WINDOW)


def test_run_is_the_stages_in_order(spark):
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "benchmark", "secrets", "packing"]
    out = P.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert out.count() == docs.count() and out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_awkward_documents(spark):
    docs = frame(spark)
    for stage in (P.deduplicated, P.redacted, P.decontaminated, P.identified):
        assert stage(spark, docs, SF).columns == P.COLUMNS
        stage(spark, docs, SF).collect()
    assert P.redacted(spark, docs, SF).count() == len(awkward())
    none = frame(spark, [])
    for _, stage in P.STAGES:
        assert stage(spark, none, SF).count() == 0
    assert P.redacted(spark, frame(spark, [(1, None, None, None, 7)]), SF).where(F.col("text").isNull() & (F.col("n_chars") == 7)).count() == 1


def test_near_copies_go_by_row_and_not_by_id(spark):
    def words(name):
        return " ".join(f"{name}{i}" for i in range(60))

    rows = [
        (None, words("a"), "en", "null copy", 0), (7, words("a"), "en", "kept copy", 0), (None, words("b"), "en", "null alone", 0), (None, words("c"), "en", "null pair 1", 0), (None, words("c"), "en", "null pair 2", 0),
        (3, words("d"), "en", "least", 0), (5, words("d") + " tail", "en", "near copy", 0), (5, words("e"), "en", "same id, other text", 0), (9, words("f"), "en", "twice 1", 0), (9, words("f"), "en", "twice 2", 0), (None, None, None, "no text", 0),
    ]
    got = [r.source for r in P.deduplicated(spark, frame(spark, rows), SF).collect()]
    one_of = [{"null pair 1", "null pair 2"}, {"twice 1", "twice 2"}]
    assert all(len(x & set(got)) == 1 for x in one_of)
    assert sorted(x for x in got if not any(x in o for o in one_of)) == ["kept copy", "least", "no text", "null alone", "same id, other text"]
    assert len(got) == 7


def test_run_leaves_nothing_but_its_result(spark):
    import os

    from vetra.llm import frames

    place = frames.ensure_checkpoints(spark).removeprefix("file:")
    before = set(os.listdir(place)) if os.path.isdir(place) else set()
    assert P.run(spark, SF).count() > 0
    new = [d for d in os.listdir(place) if d not in before and d.startswith(("pipeline-", "vetra-"))]
    assert len(new) == 1 and len(os.listdir(f"{place}/{new[0]}")) == 1


def test_no_machine_local_folder_on_a_cluster(spark):
    import pytest

    from vetra.llm import frames

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(RuntimeError):
        frames.ensure_checkpoints(Session())


def test_masks_against_scalar_code(spark):
    rows = [(0, "abcdefghij", [(0, 3), (2, 5), (5, 6), (8, 10)]), (1, "\U0001f600bcd", [(1, 2)]), (2, "xyz", [(0, 3)])]
    want = []
    for _, t, spans in rows:
        out, at = "", 0
        for a, b in spans:
            if a >= at:
                out += t[at:a] + P.MASK
            at = max(at, b)
        want.append(out + t[at:])
    df = spark.createDataFrame(rows, "i int, t string, s array<struct<start:int,end:int>>")
    assert [r.m for r in df.select("i", P._masked(F.col("t"), F.col("s")).alias("m")).orderBy("i").collect()] == want
