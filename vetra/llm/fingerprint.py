"""Document fingerprints by consistent weighted sampling, in DataFrame operations only."""

from __future__ import annotations


from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import shuffle_width, table, texts

#: Samples of a fingerprint; its likeness has a deviation of at most 1 / (2 * sqrt(SAMPLES)).
SAMPLES = 32
#: Ranges of doc_id for each shuffle partition; what comes to the driver is one row for each.
RANGES_PER_PARTITION = 4

_BITS = 21
_UNIT = float(1 << _BITS)


def _uniforms(term: Column, k: int) -> list[Column]:
    """Three uniform numbers inside (0, 1) of a term and a sample, from one 64-bit hash."""
    h = F.xxhash64(term, F.lit(k))
    mask = (1 << _BITS) - 1
    return [(F.shiftrightunsigned(h, _BITS * i).bitwiseAND(F.lit(mask)).cast("double") + 0.5) / _UNIT for i in range(3)]


def sample(term: Column, weight: Column, k: int) -> Column:
    """What a weighted term bids for sample k; the smallest bid of a document is its sample.

    With r and c from Gamma(2, 1) and b uniform, all functions of term and k,
    t = floor(ln(w) / r + b) and the bid is c / exp(r * (t - b + 1)).  A bid
    depends on the weight through t only, so equal bids are equal (term, t).
    r = E1 + E2 and b = E1 / r for two exponential numbers: independent, as
    asked, and r * (1 - b) = E2, so a bid with t = 0 needs one logarithm.
    """
    u2, u3, u4 = _uniforms(term, k)
    c = -F.ln(u3 * u4)
    first = c * u2
    e1 = -F.ln(_uniforms(term, -1 - k)[0])
    r = e1 - F.ln(u2)
    t = F.floor((F.ln(weight) + e1) / r)
    return F.when((weight <= 1) | (t <= 0), first).otherwise(c * F.exp(e1 - r * (t + 1)))


def _hex(value: Column) -> Column:
    """Eight digits of a sample; of none, zeros."""
    return F.coalesce(F.substring(F.lpad(F.hex(F.xxhash64(value)), 16, "0"), 1, 8), F.lit("0" * 8))


def likeness(a: Column, b: Column, samples: int) -> Column:
    """Share of equal samples of two fingerprints."""
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.substring(a, i * 8 + 1, F.lit(8)) == F.substring(b, i * 8 + 1, F.lit(8))))
    return same.cast("double") / samples


def fingerprints(rows: DataFrame, keys: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """keys, fingerprint: ``samples`` times eight hexadecimal digits for every key, zeros for one without terms.

    Terms are the words of a text (runs of anything but ASCII white space,
    lower case), weighted by how often they occur.  If ``rows`` is already
    partitioned by some of ``keys``, nothing is shuffled.
    """
    terms = rows.select(*keys, F.explode(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+")).alias("word"))
    terms = terms.select(*keys, F.when(F.col("word") != "", F.xxhash64("word")).alias("term")).groupBy(*keys, "term").agg(F.count("*").cast("double").alias("weight"))
    bids = terms.groupBy(*keys).agg(*(F.min(F.when(F.col("term").isNotNull(), sample(F.col("term"), F.col("weight"), k))).alias(f"s{k}") for k in range(samples)))
    return bids.select(*keys, F.concat(*(_hex(F.col(f"s{k}")) for k in range(samples))).alias("fingerprint"))


def _bounds(keys: DataFrame, n: int) -> list[tuple[int, int]]:
    """Borders (order_id, order_text) of ``n`` ranges with about as many rows each, in order.

    An id that takes several ranges is cut by the hash of the text, which is spread evenly.
    """
    found = keys.agg(F.percentile_approx("order_id", [i / n for i in range(1, n)], F.lit(100_000)).alias("q")).first()["q"] or []
    out = []
    for q in sorted(set(found)):
        k = found.count(q)
        out.append((q, -(1 << 63)))
        out += [(q, -(1 << 63) + j * ((1 << 64) // k)) for j in range(1, k)]
    return out


def in_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, text, range, extra: rows dealt by ranges of doc_id, one to a partition.

    The first row of each range in falling order is also, as ``extra``, the
    last of the range above (of the lowest range for the top one), so every row has the next
    document beside it.
    """
    n = RANGES_PER_PARTITION * shuffle_width(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("order_id"), F.xxhash64("text").alias("order_text"), F.lit(0).alias("range"))
    bounds = _bounds(rows, n)
    if bounds:
        # binary search for the number of bounds that are not above the row; one expression, however many bounds
        steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
        ids, hashes, m = F.array(*(F.lit(b) for b, _ in bounds)), F.array(*(F.lit(h) for _, h in bounds)), len(bounds)

        def step(at: Column, s: Column) -> Column:
            i = F.least(at + s, F.lit(m)) - 1
            there = (F.get(ids, i) < F.col("order_id")) | ((F.get(ids, i) == F.col("order_id")) & (F.get(hashes, i) <= F.col("order_text")))
            return F.when((at + s <= m) & there, at + s).otherwise(at)

        rows = rows.withColumn("range", F.aggregate(F.array(*(F.lit(s) for s in steps)), F.lit(0), step))
    heads = rows.groupBy("range").agg(F.max(F.struct("order_id", "order_text")).alias("head")).collect()
    heads.sort(key=lambda r: r["range"])
    spark = docs.sparkSession
    goes = [(r["range"], r["head"]["order_id"], r["head"]["order_text"], heads[(i + 1) % len(heads)]["range"]) for i, r in enumerate(heads)]
    heads_ = spark.createDataFrame(goes, "`range` int, order_id long, order_text long, goes int")
    rows = rows.join(F.broadcast(heads_), ["range", "order_id", "order_text"], "left")
    own = F.struct(F.col("range"), F.lit(0).alias("extra"))
    to = F.when(F.col("goes").isNotNull(), F.array(own, F.struct(F.col("goes").alias("range"), F.lit(1).alias("extra")))).otherwise(F.array(own))
    return rows.select("doc_id", "text", "order_id", "order_text", F.explode(to).alias("to")).select("doc_id", "text", "order_id", "order_text", "to.range", "to.extra").repartitionById(len(bounds) + 1, "range")


def edits(docs: DataFrame, samples: int = SAMPLES, facts: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    With ``facts`` these columns, made of the edited text, stand for it, and
    only they go on to the join with the fingerprints.

    ``edited`` is the text with its last floor(n_chars / 2) code points
    replaced by the first as many (or all) of the next document, in falling
    order of doc_id, the first following the last.  The likeness of two
    fingerprints is their share of equal samples, an estimate of the
    generalised Jaccard similarity of the texts' word counts.

    A null text is empty; a text without words has a fingerprint of zeros,
    like only itself.  A null doc_id comes last; rows with one doc_id are
    ordered by a hash of their texts.  A single row follows itself.
    """
    docs = texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    order = W.partitionBy("range").orderBy("extra", F.col("order_id").desc(), F.col("order_text").desc())
    facts = {"edited": lambda e: e} if facts is None else facts
    rows = in_ranges(docs).select("range", "extra", "doc_id", "text", F.row_number().over(order).alias("at"), F.lead("text").over(order).alias("after"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("after"), F.lit(1), half))
    rows = rows.withColumn("edited", F.when(F.col("extra") == 0, edited))
    # doc_id goes along so that both uses of the dealt rows read the same columns, and the shuffle is done once
    both = rows.select("range", "at", "doc_id", F.posexplode(F.when(F.col("extra") == 0, F.array("text", "edited")).otherwise(F.array("text"))).alias("which", "text"))
    prints = fingerprints(both, ["range", "at", "doc_id", "which"], "text", samples)
    pair = prints.groupBy("range", "at").agg(F.max(F.when(F.col("which") == 0, F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(F.col("which") == 1, F.col("fingerprint"))).alias("edited_fingerprint"))
    own = rows.where("extra = 0").select("range", "at", "doc_id", F.length("text").cast("long").alias("n_chars"), *(f(F.col("edited")).alias(k) for k, f in facts.items()))
    beside = F.lead("fingerprint").over(W.partitionBy("range").orderBy("at"))
    pair = pair.withColumn("next", beside).select(
        "range", "at", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next"), samples).alias("near_next"),
    )
    return own.join(pair, ["range", "at"]).select("doc_id", "n_chars", *facts, "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits(table(spark, sf_dir, "documents"), facts={"edited_sha256": lambda e: F.sha2(e.cast("binary"), 256)})
