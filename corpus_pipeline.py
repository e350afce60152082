"""A training-data pipeline: five stages over ``documents``, each writing a table for the next.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of ``documents`` (doc_id, text, lang,
source, n_chars).  Every stage works on rows, whatever their ids: rows with a
null or repeated doc_id are judged one by one, an empty table gives an empty
table, and columns beyond those of ``documents`` are dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetra.llm import decontaminate, language, minhash, packing, secrets
from vetra.llm.frames import delete, discard_since, ensure_checkpoints, small, table, tables_made, workers_import, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5
#: What stands in a text for a secret.
MASK = "[SECRET]"
#: Numbers of rows in groups of near copies that are broadcast at most (16 bytes each); with more, the rows are shuffled.
BROADCAST_IDS = 500_000


def _numbered(docs: DataFrame) -> DataFrame:
    """COLUMNS and ``row``, a number of its own for every row; written, so that the numbers stay."""
    return written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "numbered")


def _copies(docs: DataFrame) -> DataFrame:
    """``row`` of all rows of each group of near copies but one: the smallest by (doc_id, row), null ids last."""
    near = minhash.near_duplicates(docs.select(F.col("row").alias("doc_id"), "text"), shingle=SHINGLE)
    tied = written(near.where("NOT kept").select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")), "tied")
    group = tied.unionAll(tied.select(F.col("component").alias("row"), "component").distinct())
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    member = docs.select("row", "doc_id").join(small(group, BROADCAST_IDS), "row")
    stays = member.groupBy("component").agg(F.min(place)["row"].alias("row"))
    return group.join(stays, "row", "left_anti").select("row")


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets ``lang`` to the predicted language; documents that the classifier rejects go.

    A null or empty text, or one without a letter, has no language and goes, as
    does one whose two best languages are too close; equal texts fare alike.
    """
    workers_import(spark)
    labelled = table(spark, sf_dir, "documents")
    return language.label(docs.select(COLUMNS), language.fit(labelled)).where("accepted").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that with the smallest doc_id; rows count by themselves, whatever their ids.

    Null ids come last; of rows that tie, copies of a row among them, the first
    in the order of the input stays.  Texts that are null or without words are
    near nothing and stay.
    """
    docs = _numbered(docs)
    gone = small(written(_copies(docs), "dropped"), BROADCAST_IDS)
    return docs.join(gone, "row", "left_anti").select(COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    A null or empty text holds none and stays; equal texts fare alike.
    """
    return decontaminate.marked(docs.select(COLUMNS), table(spark, sf_dir, "benchmark")).where("n_hit = 0").select(COLUMNS)


def _masked(text: Column, spans: Column) -> Column:
    """The text with every span (in order, overlaps allowed) replaced by MASK."""

    def of(s: Column) -> Column:
        before = secrets.running(F.transform(s, lambda x: x["end"]), F.lit(0), lambda x, y: F.greatest(x, y))

        def join(chars: Column) -> Column:
            piece = lambda a, b: F.array_join(F.slice(chars, a + 1, b - a), "")
            # a span that begins inside another one, or at its end after the first, adds to its mask
            pieces = F.zip_with(s, before, lambda x, b: F.when(x["start"] >= b, F.concat(piece(b, x["start"]), F.lit(MASK))).otherwise(""))
            return F.concat(F.array_join(pieces, ""), piece(F.array_max(F.transform(s, lambda x: x["end"])), F.size(chars)))

        return secrets.let(F.split(text, ""), join)

    return secrets.let(spans, of)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to MASK; no document goes.  n_chars is that of the new text.

    A null or empty text stays as it is, n_chars too; equal texts become equal texts.
    """
    out = secrets.scan(docs, keep=("text", "lang", "source", "n_chars"))
    spans = F.array_sort(F.concat(*(F.col(k) for k in secrets.KINDS)))
    out = out.withColumn("spans", spans).withColumn("masked", F.when(F.size("spans") > 0, _masked(F.col("text"), F.col("spans"))))
    return out.select("doc_id", F.coalesce("masked", "text").alias("text"), "lang", "source", F.coalesce(F.length("masked").cast("long"), "n_chars").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of packing.WINDOW tokens.

    A null or empty text is its end token; every row is packed, copies too.
    """
    return packing.pack(docs)


STAGES = [("language", identified), ("near_duplicates", deduplicated), ("benchmark", decontaminated), ("secrets", redacted), ("packing", packed)]

#: The stages can't be written in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; each result is written to the shared folder and read again.

    What a stage read and made on its way is removed when its result is written; the last result stays.
    """
    docs = table(spark, sf_dir, "documents")
    base = f"{ensure_checkpoints(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for k, (name, stage) in enumerate(STAGES):
        mark = tables_made()
        out = stage(spark, docs, sf_dir)
        path = f"{base}/{k}-{name}"
        out.write.parquet(path)
        discard_since(spark, mark)
        if last:
            delete(spark, last)
        last, docs = path, spark.read.schema(out.schema).parquet(path)
    return docs
