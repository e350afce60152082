"""Quality rules whose thresholds come from the corpus: quantile sketches for each language and source, then a join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import small, table, texts, written

#: Words of a window that counts as repeated.
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
#: The base rule: fewest words, and the largest share of words in repeated windows in hundredths.
LEAST_WORDS = 10
MOST_REPEATED = 20
#: Leading bits of a value that a sketch keeps: quantiles are low by less than 1 / 2^(BITS - 1) of their value.
BITS = 7
#: Documents that a group must have for thresholds of its own; smaller ones take those of the language, then of all.
GROUP_ROWS = 100
#: A value is far out beyond so many spreads (distances of the quartiles) from the nearer quartile.
SPREADS = 3
#: What is measured, in whole numbers: the measure, its least spread, and which sides are judged.
METRICS = {
    "symbols": ("1000 * n_symbols div n_words", 50, "high"),
    "lines": ("1000 * n_dup_lines div n_lines", 200, "high"),
    "repeats": ("1000 * n_repeat_words div n_words", 100, "high"),
    "length": ("100 * word_chars div n_words", 50, "both"),
    "words": ("n_words", None, "low"),
}
#: A text with less than this part of the words of its group's lower quartile is too short.
FOLD = 64
#: Rows of thresholds that are broadcast at most (some 80 bytes each), and copies of each beyond that, so that a hot source meets in several tasks.
BROADCAST_ROWS = 300_000
SALTS = 16

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in a window of ``window`` words that the list has twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    one = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    if len(known) > len(words) - 2:  # of two equal windows each word comes twice
        return 0
    # ranks of windows of growing width: two ranks beside or over each other make that of a wider one
    rank, wide = one, 1
    while wide < window:
        step = min(wide, window - wide)
        pairs = rank[: len(rank) - step] * np.int64(len(words)) + rank[step:]
        rank, wide = np.unique(pairs, return_inverse=True)[1], wide + step
    often = np.flatnonzero(np.bincount(rank)[rank] > 1)
    if not len(often):
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, often, 1)
    np.add.at(edges, often + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The values of _COUNTS for one text; words are parted by blanks and the control characters 9 to 13, nothing else."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chars = len(b"".join(words).decode())
    return len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(words)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every row; a null text counts as an empty one."""
    rows = texts(docs, "lang", "source").select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([counts(t.as_py()) for t in batch.column("text")], np.int64).reshape(-1, len(_COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(got[:, k]) for k in range(len(_COUNTS)))], names=["doc_id", "lang", "source", *_COUNTS])

    return rows.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in _COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def bucket(value: str, bits: int = BITS) -> Column:
    """The bucket of a whole number from 0: its ``bits`` leading bits, the others 0."""
    spare = f"greatest(length(bin({value})) - {bits}, 0)"
    return F.expr(f"shiftleft(shiftright({value}, {spare}), {spare})")


def sketch(rows: DataFrame, keys: list[str], metrics: dict[str, str], bits: int = BITS) -> DataFrame:
    """(keys, metric, bucket, n): a quantile sketch of each metric for each key, as rows.

    ``metrics`` are SQL expressions of whole numbers from 0.  A sketch is the
    number of values in each bucket; it has at most 2^(bits - 1) buckets for
    each power of two, whatever it counts, is made in the tasks before rows
    travel, and doesn't depend on their order.
    """
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.expr(f"CAST({e} AS long)").alias("value")) for m, e in metrics.items())))
    return rows.select(*keys, each.alias("m")).select(*keys, "m.metric", "m.value").groupBy(*keys, "metric", bucket("value", bits).alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of a coarser key: counts of the same bucket added up."""
    return sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, n, q1, q3): how many values a sketch holds, and the buckets in which the quarters of them are reached."""
    inside = W.partitionBy(*keys, "metric")
    run = sketches.select(*keys, "metric", "bucket", F.sum("n").over(inside.orderBy("bucket")).alias("upto"), F.sum("n").over(inside).alias("total"))
    reached = lambda quarter: F.min(F.when(4 * F.col("upto") >= quarter * F.col("total"), F.col("bucket")))
    return run.groupBy(*keys, "metric").agg(F.max("total").alias("n"), reached(1).alias("q1"), reached(3).alias("q3"))


def limits(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, low, high): for each key the least and largest value of each metric that isn't far out; no entry where a side isn't judged."""
    q = quartiles(sketches, keys)
    spread = F.greatest(F.col("q3") - F.col("q1"), F.create_map(*(F.lit(x) for m, (_, least, _) in METRICS.items() for x in (m, least or 0)))[F.col("metric")])
    low = F.when(F.col("metric") == "words", F.ceil(F.col("q1") / FOLD)).otherwise(F.col("q1") - SPREADS * spread)
    sides = lambda *which: F.col("metric").isin(*(m for m, x in METRICS.items() if x[2] in which))
    of = lambda side, value: F.map_from_entries(F.collect_list(F.when(side, F.struct("metric", value.cast("long")))))
    return q.groupBy(*keys).agg(F.max("n").alias("n"), of(sides("low", "both"), low).alias("low"), of(sides("high", "both"), F.col("q3") + SPREADS * spread).alias("high"))


def thresholds(rows: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(lang, source, low, high) for every language and source among the rows that pass the base rule; from :func:`measured` rows.

    One pass over the rows gives the sketches of the groups; those of the
    languages and of all rows are merged from them.  A group of fewer than
    ``group_rows`` rows has the limits of its language, or of all rows; where
    these have too few too, low and high are null.
    """
    fine = sketch(rows.where(~base_failed()), ["lang", "source"], {m: x[0] for m, x in METRICS.items()})
    fine = written(fine, "sketches")  # read four times
    enough = lambda c: F.when(F.col("n") >= group_rows, F.col(c)).alias(c)
    group = limits(fine, ["lang", "source"]).select("lang", "source", enough("low"), enough("high"))
    language = limits(merged(fine, ["lang"]), ["lang"]).select(F.col("lang").alias("of"), enough("low"), enough("high"))
    every = limits(merged(fine, []).withColumn("one", F.lit(1)), ["one"]).select("one", enough("low"), enough("high"))
    g, one, a = group.alias("g"), language.alias("l"), every.alias("a")
    both = g.join(one, F.expr("g.lang <=> l.of"), "left").join(F.broadcast(a), F.expr("a.one = 1"), "left")
    # a map is there in all its entries or not at all
    return both.selectExpr("g.lang", "g.source", "coalesce(g.low, l.low, a.low) AS low", "coalesce(g.high, l.high, a.high) AS high")


def judged(docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed, far_out, kept for every row of ``docs``.

    ``far_out`` names the metrics beyond the limits of the row's language and
    source, in the order of METRICS; it is empty where no limits are known or
    the base rule fails.  ``kept`` is false if the base rule fails or a metric
    is far out.  A null or empty text has no words, so the base rule fails.
    Null languages and sources are groups of their own; repeated rows count
    each, equal texts of one group fare alike; an empty table gives an empty
    table, further columns are left out.
    """
    rows = written(measured(docs), "measured")
    level = written(thresholds(rows, group_rows), "thresholds")
    rows = rows.withColumn("base_failed", base_failed())
    if level.count() <= BROADCAST_ROWS:
        level, salt = F.broadcast(level), F.lit(0)
        level = level.withColumn("salt", F.lit(0))
    else:
        level, salt = level.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), F.pmod(F.xxhash64("doc_id", *_COUNTS), F.lit(SALTS)).cast("int")
    r, t = rows.withColumn("salt", salt).alias("r"), level.alias("t")
    joined = r.join(t, F.expr("r.lang <=> t.lang AND r.source <=> t.source AND r.salt = t.salt"), "left")
    value = lambda m: F.expr(METRICS[m][0])
    out = [F.when(~F.col("base_failed") & (F.coalesce(value(m) < F.col("t.low")[m], F.lit(False)) | F.coalesce(value(m) > F.col("t.high")[m], F.lit(False))), F.lit(m)) for m in METRICS]
    done = joined.select("doc_id", "r.lang", "r.source", *_COUNTS, "base_failed", F.array_compact(F.array(*out)).alias("far_out"))
    return done.withColumn("kept", ~F.col("base_failed") & (F.size("far_out") == 0))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = {
    "op11_quality": r"""WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM t) x),
twice AS (SELECT doc_id, win FROM win GROUP BY doc_id, win HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(0, 5)) AS k FROM win SEMI JOIN twice USING (doc_id, win)) x GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
dup AS (SELECT doc_id, count(*) AS lines, count(*) - count(DISTINCT line) AS n FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (SELECT doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, coalesce(dup.lines, 0) AS n_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM t LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
m AS (SELECT doc_id, lang, source, unnest(['symbols', 'lines', 'repeats', 'length', 'words']) AS metric,
  unnest([1000 * n_symbols // n_words, 1000 * n_dup_lines // n_lines, 1000 * n_repeat_words // n_words, 100 * word_chars // n_words, n_words]) AS v FROM b WHERE NOT base_failed),
k AS (SELECT *, v - v % (CAST(1 AS BIGINT) << CAST(greatest(length(bin(v)) - 7, 0) AS INTEGER)) AS bucket FROM m),
lv AS (SELECT 1 AS level, lang, source, metric, bucket FROM k UNION ALL SELECT 2, lang, NULL, metric, bucket FROM k UNION ALL SELECT 3, NULL, NULL, metric, bucket FROM k),
sk AS (SELECT level, lang, source, metric, bucket, count(*) AS n FROM lv GROUP BY ALL),
run AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, metric) AS total FROM sk),
q AS (SELECT level, lang, source, metric, max(total) AS n, min(bucket) FILTER (4 * upto >= total) AS q1, min(bucket) FILTER (4 * upto >= 3 * total) AS q3 FROM run GROUP BY ALL),
li AS (SELECT level, lang, source, metric, CASE metric WHEN 'words' THEN (q1 + 63) // 64 WHEN 'length' THEN q1 - 3 * greatest(q3 - q1, 50) END AS low,
  CASE metric WHEN 'symbols' THEN q3 + 3 * greatest(q3 - q1, 50) WHEN 'lines' THEN q3 + 3 * greatest(q3 - q1, 200) WHEN 'repeats' THEN q3 + 3 * greatest(q3 - q1, 100) WHEN 'length' THEN q3 + 3 * greatest(q3 - q1, 50) END AS high FROM q WHERE n >= 100),
best AS (SELECT m.doc_id, m.metric, m.v, arg_min(li.low, level) FILTER (level IS NOT NULL AND (m.metric = 'words' OR m.metric = 'length')) AS low, arg_min(li.high, level) FILTER (m.metric <> 'words') AS high FROM m
  LEFT JOIN li ON li.metric = m.metric AND ((level = 1 AND li.lang IS NOT DISTINCT FROM m.lang AND li.source IS NOT DISTINCT FROM m.source) OR (level = 2 AND li.lang IS NOT DISTINCT FROM m.lang) OR level = 3) GROUP BY ALL),
bad AS (SELECT DISTINCT doc_id FROM best WHERE v < low OR v > high)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM b"""
}
