import random

import duckdb
import pytest
from pyspark.sql import functions as F

from cases import SF, frame
from vetra.llm import quality


def _counts(text):
    """The contract read literally."""
    import re
    from collections import Counter

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if wins[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("seed", range(60))
def test_counts_of_random_texts(seed):
    rnd = random.Random(seed)
    vocab = ["a", "b", "ñ", "c#", "|", "<x>", "日本"][: rnd.randint(1, 7)]
    text = "".join(rnd.choice(vocab) + rnd.choice([" ", " ", "\n", "\t ", "\x0b", "\r\n", "\x1f ", "  "]) for _ in range(rnd.randint(0, 60)))
    assert quality.counts(text) == _counts(text)


def test_awkward_rows(spark):
    docs = frame(spark)
    got = quality.judged(docs, 5).collect()
    assert len(got) == docs.count()
    want = sorted(str((r["doc_id"], *_counts(r["text"]))) for r in docs.collect())
    assert sorted(str((r["doc_id"], *(r[c] for c in quality._COUNTS))) for r in got) == want
    assert all(not r["kept"] for r in got if r["base_failed"])
    assert all(r["base_failed"] for r in got if r["doc_id"] in (40, 41, 42))
    assert quality.judged(frame(spark, [])).count() == 0


def _quartiles(values):
    values, n = sorted(values), len(values)
    low = lambda v: v if v < 128 else v >> (v.bit_length() - 7) << (v.bit_length() - 7)
    return low(values[-(-n // 4) - 1]), low(values[-(-3 * n // 4) - 1])


def test_sketches_give_quartiles_and_merge(spark):
    rnd = random.Random(3)
    rows = [(g, rnd.choice([rnd.randint(0, 9), rnd.randint(0, 10**6), 0])) for g in ("a", "b", None) for _ in range(rnd.randint(50, 200))]
    df = spark.createDataFrame(rows, "g string, v long").repartition(5)
    fine = quality.sketch(df, ["g"], {"m": "v"})
    assert {(r.g, r.n, r.q1, r.q3) for r in quality.quartiles(fine, ["g"]).collect()} == {(g, len(v), *_quartiles(v)) for g in ("a", "b", None) for v in [[x for h, x in rows if h == g]]}
    all_ = quality.quartiles(quality.merged(fine, []), []).first()
    assert (all_.n, all_.q1, all_.q3) == (len(rows), *_quartiles([v for _, v in rows]))


def _text(rnd, n, symbol=""):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) + symbol for _ in range(n))


def _corpus():
    rnd = random.Random(5)
    rows = [(i, _text(rnd, rnd.randint(80, 300)), "en", "prose", 1) for i in range(150)]
    rows += [(1000 + i, _text(rnd, rnd.randint(80, 300), "**"), "en", "code", 1) for i in range(150)]  # marks are usual here
    return rows, [(2000, _text(rnd, 100, "**"), "en", "prose", 1), (2001, _text(rnd, 100, "**"), "en", "code", 1), (2002, _text(rnd, 100, "**"), "en", "new", 1), (2003, _text(rnd, 100, "#" * 9), "fr", None, 1), (2004, _text(rnd, 100), None, None, 1)]


@pytest.mark.parametrize("rows", [quality.BROADCAST_ROWS, 0])
def test_thresholds_follow_language_and_source(spark, monkeypatch, rows):
    monkeypatch.setattr(quality, "BROADCAST_ROWS", rows)
    usual, odd = _corpus()
    got = {r["doc_id"]: r for r in quality.judged(frame(spark, usual + odd)).collect()}
    assert all(got[i]["kept"] for i in range(150)) and all(got[1000 + i]["kept"] for i in range(150))
    assert got[2000]["far_out"][0] == "symbols" and not got[2000]["kept"]
    assert got[2001]["kept"]  # usual in its source
    assert got[2002]["kept"]  # a small source: the language's limits, which code widens
    assert not got[2003]["kept"] and "length" in got[2003]["far_out"]  # a small language: those of all rows
    assert got[2004]["kept"]


def test_too_few_rows_have_no_limits(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(50)), "en", "s", 1), (2, " ".join(f"w{i}****" for i in range(50)), "en", "s", 1)]
    assert all(r["kept"] for r in quality.judged(frame(spark, rows)).collect())


def test_clean_documents_are_kept_and_bad_ones_are_not(spark):
    sf = SF.replace("0.001", "0.1")
    out = quality.op11_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.avg((F.col("kept") | F.col("base_failed")).cast("int")).alias("by_limits")).collect()
    share = {r["quality"]: r for r in out}
    assert share[1]["by_limits"] > 0.998 and share[0]["kept"] < 0.02


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.sql(quality.ORACLE_SQL["op11_quality"])
    names = [c for c in want.columns]
    assert sorted(map(tuple, quality.op11_quality(spark, SF).select(names).collect())) == sorted(want.fetchall())


def test_a_very_long_text(spark):
    text = " ".join(f"w{i % 400_000}" for i in range(500_000)) + "\n" + "# " * 10
    got = quality.judged(frame(spark, [(1, text, "en", "s", 1)])).first()
    assert tuple(got[c] for c in quality._COUNTS) == (500_010, len("".join(text.split())), 10, 2, 0, 200_000 + 10)
