"""Language identification by compression with per-language dictionaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .frames import table, texts, workers_import

#: Bounds of the labelled sample that the dictionaries are cut from: documents
#: of each language and characters of each document.
SAMPLE_DOCS = 400
SAMPLE_CHARS = 1500
#: Characters of the whole sample that come to the driver: with many languages each has fewer documents, not fewer languages.
SAMPLE_TOTAL = 24_000_000
#: Bytes of one language's dictionary.
DICTIONARY_BYTES = 110_000
#: A text is compressed in blocks of so many characters, each against every
#: dictionary, so that a long text doesn't become its own dictionary.
BLOCK_CHARS = 2000
#: Narrowest relative gap between the two shortest encodings that is accepted.
MARGIN = 0.003
UNKNOWN = "und"

_ADDED = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("margin", DoubleType()), StructField("accepted", BooleanType())]

_OTHER = re.compile(r"[\W\d_]+")
_LETTER = regex.compile(r"\p{L}")
#: Rows of a language that the first pass of :func:`fit` should leave, as a multiple of the sample.
SPARE = 4


def plain(text: str) -> str:
    """Lower-case letters with single blanks: what the models see."""
    return _OTHER.sub(" ", text.lower())


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """One raw-content dictionary for each language of the training rows.

    Reads (doc_id, text, lang) of rows that are not held out and have a text
    with a letter and a language.  The sample is the first ``sample_docs``
    rows of a language by a hash of doc_id and text (of the rows whose hash is
    in the lowest SPARE * ``sample_docs`` / count of its range), ``sample_chars``
    characters from the middle of each; with more than SAMPLE_TOTAL /
    (``sample_docs`` * ``sample_chars``) languages, fewer rows of each, one at least.
    So what is shuffled and reaches the driver doesn't depend on the corpus, and
    every language of the labels (an enumeration, not data) has a dictionary.
    No such row: no dictionary.
    """
    train = texts(docs, "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    size = F.length("text")
    excerpt = F.substring("text", F.greatest(F.lit(1), ((size - sample_chars) / 2).cast("int")), F.lit(sample_chars))
    rank = F.xxhash64("doc_id", F.xxhash64("text"))
    sizes = train.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not sizes:
        return {}
    sample_docs = max(1, min(sample_docs, SAMPLE_TOTAL // (sample_chars * len(sizes))))
    # a row is in the sample only if its hash is low: what a language has beyond that never leaves its scan
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, SPARE * sample_docs / r["n"]))))
    low = F.try_element_at(share, F.col("lang"))
    order = W.partitionBy("lang").orderBy("rank", "doc_id", "excerpt")
    picked = train.select("lang", "doc_id", rank.alias("rank"), excerpt.alias("excerpt")).where(((F.col("rank") / F.lit(2.0**64)) + 0.5) <= low)
    rows = picked.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample_docs).orderBy("n", "lang").collect()
    parts: dict[str, list[bytes]] = {}
    for r in rows:
        parts.setdefault(r["lang"], []).append(plain(r["excerpt"]).strip().encode())
    out = {}
    for lang, texts_ in sorted(parts.items(), key=lambda x: (-len(x[1]), x[0])):
        share = max(64, DICTIONARY_BYTES // len(texts_))
        whole = b" ".join(t[:share].decode("utf-8", "ignore").encode() for t in reversed(texts_))
        out[lang] = whole[-DICTIONARY_BYTES:]
    return out


class Classifier:
    """Compressed sizes of a text under every dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        import zstandard as z

        self.languages = list(dictionaries)
        params = z.ZstdCompressionParameters.from_level(
            3, hash_log=16, chain_log=16, min_match=4, strategy=z.STRATEGY_GREEDY, search_log=4, window_log=18, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        self.coders = []
        for lang in self.languages:
            d = z.ZstdCompressionDict(dictionaries[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.coders.append(z.ZstdCompressor(dict_data=d, compression_params=params))

    def sizes(self, text: str) -> list[int]:
        total = [0] * len(self.coders)
        for at in range(0, len(text), BLOCK_CHARS):
            block = text[at : at + BLOCK_CHARS].encode("utf-8", "replace")
            for i, c in enumerate(self.coders):
                total[i] += len(c.compress(block))
        return total

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score from 0 to 1, margin); UNKNOWN if there is no letter."""
        if not self.coders or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(plain(text))
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        best = sizes[order[0]]
        second = sizes[order[1]] if len(order) > 1 else 2 * best
        margin = (second - best) / max(second, 1)
        return self.languages[order[0]], min(1.0, 0.5 + margin), margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, margin, accepted for every row of ``docs``.

    The language whose dictionary gives the shortest encoding of the whole
    text wins; ties go to the one that comes first in ``dictionaries``.  ``accepted`` is false
    where the relative gap to the second is under ``margin``.  A null or empty
    text, or one without letters, is ``und``, score 0, not accepted.  Repeated
    rows and null ids stay.  The dictionaries (DICTIONARY_BYTES each at most) go out with the function.
    """
    return label(texts(docs), dictionaries, margin).drop("text")


def label(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """``docs`` (with text, and any other columns) and lang_pred, score, margin, accepted; see :func:`identify`.

    Columns of ``docs`` that have one of these four names give way.
    """
    workers_import(docs.sparkSession)
    docs = docs.drop(*(f.name for f in _ADDED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries)
        for batch in batches:
            got = [model.predict(t.as_py()) for t in batch.column("text")]
            langs, scores, margins = zip(*got) if got else ((), (), ())
            accepted = [lang != UNKNOWN and m >= margin for lang, m in zip(langs, margins)]
            more = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()), pa.array(accepted, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "lang_pred", "score", "margin", "accepted"])

    schema = StructType([*docs.schema.fields, *_ADDED])
    return docs.mapInArrow(run, schema)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "accepted")
