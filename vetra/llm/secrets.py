"""Secret scans: fixed patterns, and a randomness test battery with false-discovery control."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import table, texts, written

KINDS = ["assign", "access", "hex", "random"]
_ASSIGN = """(?i:(?:password|passwd|secret|token|api_?key))["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Pattern, inner group whose length counts (0: all of it), least length, and a quick test that any match passes.
PATTERNS = {
    "assign": (_ASSIGN, 1, 12, """(?i:password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?[A-Za-z0-9+/_.=-]{12}"""),
    "access": ("AKIA[A-Z0-9]{14,}", 0, 18, "AKIA[A-Z0-9]{14}"),
    "hex": ("[0-9a-f]{16,}", 0, 16, "[0-9a-f]{16}"),
}
#: Lower-case words of which a text has one if it has a match, looked for before any pattern is.
WORDS = {"assign": ["password", "passwd", "secret", "token", "api"], "access": ["akia"]}
#: Tokens that the battery looks at.
LEAST_TOKEN = 20
TOKEN = f"[A-Za-z0-9+/_-]{{{LEAST_TOKEN},}}"
#: Tokens whose parts all belong to the key: UUIDs and four or more groups of one length and case.
GROUPED = "^[0-9A-Fa-f]{8}(?:[-_][0-9A-Fa-f]{4}){3}[-_][0-9A-Fa-f]{12}$|" + "|".join(f"^{c}{{{n}}}(?:[-_]{c}{{{n}}}){{3,}}$" for n in range(4, 13) for c in ("[a-z0-9]", "[A-Z0-9]"))
#: What goes from other tokens with marks inside: parts of letters only (prefixes, words), and the marks.
NO_KEY = "(?<![A-Za-z0-9])[A-Za-z]+(?![A-Za-z0-9])|[-_/+]+"
#: Level of the false-discovery control: the share of random keys among the runs that the battery calls structured.
LEVEL = 0.05
#: Powers of ten by which a run has to be likelier as a key than as text to be tested at all.
NO_TEXT = 3.0
#: Symbols of the model of text: what isn't a letter or digit is a blank.
SYMBOLS = " abcdefghijklmnopqrstuvwxyz0123456789"
#: What is added to each count of a pair, and the least chances of a digit after a digit and after another symbol.
SMOOTH = 0.5
NUMBER = 0.09
NUMBER_BEGINS = 0.01
#: The least chance of a letter after any symbol: identifiers may be in another language than the corpus.
LETTER = 0.008
#: Bins of a p-value for each power of ten, and the last bin.
PER_DECADE = 16
LAST_BIN = 320

ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base32l": "abcdefghijklmnopqrstuvwxyz234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, start: Column, join: Callable[[Column, Column], Column], stretch: int = 256) -> Column:
    """For each element what ``join`` makes of those before it, from ``start`` on; in two levels, so that long arrays aren't copied for each element."""

    def of(v: Column) -> Column:
        last = F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / stretch).cast("int")
        whole = F.transform(F.sequence(F.lit(0), last), lambda c: F.aggregate(F.slice(v, c * stretch + 1, F.lit(stretch)), start, join))
        heads = F.aggregate(whole, F.array(start), lambda acc, x: F.concat(acc, F.array(join(F.element_at(acc, -1), x))))

        def at(h: Column) -> Column:
            def one(_: Column, i: Column) -> Column:
                c = F.floor(i / stretch).cast("int")
                return F.aggregate(F.slice(v, c * stretch + 1, i - c * stretch), F.get(h, c), join)

            return F.transform(v, one)

        return let(heads, at)

    return let(values, of)


def matches(text: Column, pattern: str, inner: int, least: int) -> Column:
    """Array of (start, end, token) of the leftmost matches that don't overlap, in code points.

    The text is cut at the matches; positions are running sums of the lengths
    of gaps and matches.  Matches whose inner group is shorter than ``least``
    are dropped after they have taken their place.
    """
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    cores = F.regexp_extract_all(text, F.lit(pattern), F.lit(inner)) if inner else hits
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"), cores.alias("core"))

    def placed(p: Column) -> Column:
        before = running(F.transform(p, lambda x: F.char_length(x["gap"]) + F.char_length(x["hit"])), F.lit(0), lambda x, y: x + y)

        def one(x: Column, b: Column) -> Column:
            start = b + F.char_length(x["gap"])
            span = F.struct(start.alias("start"), (start + F.char_length(x["hit"])).alias("end"), x["hit"].alias("token"))
            return F.when(F.char_length(x["core"]) >= least, span)

        return F.filter(F.zip_with(p, before, one), lambda m: m.isNotNull())

    return let(pairs, placed)


def touches(spans: Column, start: Column, end: Column) -> Column:
    """Whether one of ``spans`` (in order, without overlaps) shares a place with [start, end): a binary search."""

    def step(at: Column, k: Column) -> Column:
        there = F.get(spans, F.least(at + k, F.size(spans)) - 1)["start"]
        return F.when((at + k <= F.size(spans)) & (there < end), at + k).otherwise(at)

    before = F.aggregate(F.array(*(F.lit(1 << k) for k in reversed(range(24)))), F.lit(0), step)
    return F.coalesce(let(before, lambda n: F.get(spans, F.greatest(n, F.lit(1)) - 1)["end"] > F.when(n > 0, start)), F.lit(False))


def two_sided(z: Column) -> Column:
    """Chance that a standard normal value is further from 0 than z (within 2e-7)."""
    x = F.abs(z) / F.lit(2**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.least(F.lit(1.0), poly * F.exp(-x * x))


def encoding(token: Column) -> Column:
    """Name of the narrowest alphabet that a token of mixed symbols fits, or null."""
    digit = token.rlike("[0-9]")
    upper, lower = token.rlike("[A-Z]"), token.rlike("[a-z]")
    mixed = digit & upper & lower
    return (
        F.when(token.rlike("^[0-9a-f]+$") & digit & lower, "hex")
        .when(token.rlike("^[0-9A-F]+$") & digit & upper, "HEX")
        .when(token.rlike("^[A-Z2-7]+$") & digit & upper, "base32")
        .when(token.rlike("^[a-z2-7]+$") & digit & lower, "base32l")
        .when(token.rlike("^[0-9A-Z]+$") & digit & upper, "BASE36")
        .when(token.rlike("^[0-9a-z]+$") & digit & lower, "base36")
        .when(token.rlike("^[A-Za-z0-9]+$") & mixed, "base62")
        .when(token.rlike("^[A-Za-z0-9+/]+$") & mixed, "base64")
        .when(token.rlike("^[A-Za-z0-9_-]+$") & mixed, "base64url")
    )


def core(token: Column) -> Column:
    """The parts of a token with marks inside that can be a key, joined."""
    return F.when(token.rlike(GROUPED), F.regexp_replace(token, "[-_]", "")).otherwise(F.regexp_replace(token, NO_KEY, ""))


def battery(token: Column, name: Column) -> Column:
    """p-value of a token of the encoding ``name`` under independent, uniform symbols: three tests, Bonferroni.

    Chi-squared of the symbol counts (two-sided, Wilson-Hilferty), runs above
    and below the middle of the alphabet, and lag-one serial correlation.
    """

    def of(alphabet: Column) -> Column:
        codes = F.transform(F.split(token, ""), lambda c: F.instr(alphabet, c).cast("double"))
        return let(F.struct(codes.alias("x"), F.char_length(alphabet).cast("double").alias("a")), lambda k: tests(k["x"], k["a"]))

    def tests(x: Column, a: Column) -> Column:
        n = F.size(x).cast("double")
        squares = F.aggregate(F.transform(F.array_distinct(x), lambda c: F.size(F.filter(x, lambda y: y == c)).cast("double")), F.lit(0.0), lambda s, k: s + k * k)
        chi = squares * a / n - n
        df = a - 1
        p_chi = two_sided((F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
        high = F.size(F.filter(x, lambda y: y > a / 2)).cast("double")
        low = n - high
        neighbours = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda u, v: F.struct(u.alias("u"), v.alias("v")))

        def of_pairs(pairs: Column) -> Column:
            runs = 1 + F.size(F.filter(pairs, lambda q: (q["u"] > a / 2) != (q["v"] > a / 2)))
            mean = 2 * high * low / n + 1
            spread = 2 * high * low * (2 * high * low - n) / (n * n * (n - 1))
            p_runs = F.when(spread > 0, two_sided((runs - mean) / F.sqrt(F.greatest(spread, F.lit(1e-9))))).otherwise(F.lit(0.0))

            def of_middle(middle: Column) -> Column:
                within = F.aggregate(x, F.lit(0.0), lambda s, y: s + (y - middle) * (y - middle))
                across = F.aggregate(pairs, F.lit(0.0), lambda s, q: s + (q["u"] - middle) * (q["v"] - middle))
                p_serial = let(within, lambda w: F.when(w > 0, two_sided((across / F.greatest(w, F.lit(1e-9)) + 1 / n) * F.sqrt(n))).otherwise(F.lit(0.0)))
                return F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial))

            return let(F.aggregate(x, F.lit(0.0), lambda s, y: s + y) / n, of_middle)

        return let(neighbours, of_pairs)

    return let(F.try_element_at(F.create_map(*(F.lit(x) for pair in ALPHABETS.items() for x in pair)), name), of)


def pairs_of(docs: DataFrame) -> DataFrame:
    """(pair, n): how often two symbols follow each other in the words of the texts; a blank is before and after each word.

    Words are runs of letters and digits (a-z, lowered, and 0-9) under
    LEAST_TOKEN, so that no key is text to itself; they are counted first, and
    what is cut into pairs is each word once.
    """
    words = docs.select(F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("word")).where(F.length("word").between(1, LEAST_TOKEN - 1)).groupBy("word").agg(F.count("*").alias("n"))
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substring(padded, i, F.lit(2)))).alias("pair")
    return words.select("n", pair).groupBy("pair").agg(F.sum("n").alias("n"))


def chances(counts: dict[str, int]) -> list[float]:
    """Natural logarithm of the chance of a symbol after another in text, by :func:`code` of both.

    Chances are those of the counted pairs, smoothed, but a letter has LETTER at
    least, a digit NUMBER after a digit and NUMBER_BEGINS after any other symbol,
    and marks may follow each other freely: chances that are too large only
    make the test more careful.
    """
    out = []
    for a in SYMBOLS:
        total = sum(counts.get(a + b, 0) for b in SYMBOLS)
        for b in SYMBOLS:
            p = (counts.get(a + b, 0) + SMOOTH) / (total + SMOOTH * len(SYMBOLS))
            if b.isdigit():
                p = max(p, NUMBER if a.isdigit() else NUMBER_BEGINS)
            elif b != " ":
                p = max(p, LETTER)
            out.append(0.0 if a == b == " " else math.log(p))
    return out


def surprise(key: Column, name: Column, table_: Column) -> Column:
    """How many powers of ten a key is likelier as independent, uniform symbols of its encoding than as text; 0 at least.

    The ratio of both chances is 1 at most on average over text, so by Markov's
    inequality text reaches ten to the power of the result in at most one of as many cases: a p-value, whatever the length.
    """
    low = F.translate(F.lower(key), "+/_-", "    ")
    codes = F.transform(F.split(low, ""), lambda c: F.instr(F.lit(SYMBOLS), c) - 1)
    n = F.char_length(key)
    letters, marks = F.length(F.regexp_replace(key, "[^A-Za-z]", "")), F.length(F.regexp_replace(key, "[A-Za-z0-9]", ""))
    size = F.lit(0.0)
    for k, alphabet in ALPHABETS.items():
        folded = letters + marks if len(alphabet) > 60 else F.lit(0)  # both cases of a letter, and both marks, are one symbol here
        size = F.when(name == k, n * math.log(len(alphabet)) - folded * math.log(2.0)).otherwise(size)

    def of(c: Column) -> Column:
        steps = F.zip_with(F.concat(F.array(F.lit(0)), F.slice(c, F.lit(1), F.size(c) - 1)), c, lambda a, b: F.get(table_, a * len(SYMBOLS) + b))
        return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)

    return F.greatest(F.lit(0.0), (-let(codes, of) - size) / math.log(10.0))


def _stratum(name: Column, token: Column) -> Column:
    """Encoding and length band: tokens are held against others of like power."""
    return F.concat(name, F.lit(":"), F.floor(F.log2(F.char_length(token))).cast("string"))


def candidates(text: Column, table_: Column) -> Column:
    """Array of (start, end, stratum, bin) of the tokens in some encoding, or with a :func:`core` in one, that are no text.

    ``bin`` is the battery's p-value, as a power of ten in steps of 1 / PER_DECADE.
    """

    def judged(token: Column, label: Column) -> Column:
        name = encoding(token)
        return F.when(name.isNotNull(), F.struct(name.alias("name"), F.concat(label, name).alias("label"), token.alias("token")))

    def one(x: Column) -> Column:
        def named(key: Column) -> Column:
            odd = let(battery(key["token"], key["name"]), lambda p: F.when(p > 0, F.least(F.floor(-F.log10(p) * PER_DECADE).cast("int"), F.lit(LAST_BIN))).otherwise(LAST_BIN))
            other = surprise(key["token"], key["name"], table_) >= NO_TEXT
            return F.when(key.isNotNull() & other, F.struct(x["start"].alias("start"), x["end"].alias("end"), _stratum(key["label"], key["token"]).alias("stratum"), odd.alias("bin")))

        parts = F.when(x["token"].rlike("[-_/+]"), let(core(x["token"]), lambda c: F.when(F.char_length(c) >= LEAST_TOKEN, judged(c, F.lit("parts:")))))
        return let(F.coalesce(judged(x["token"], F.lit("")), parts), named)

    tokens = matches(text, TOKEN, 0, LEAST_TOKEN)
    return F.filter(F.transform(tokens, one), lambda c: c.isNotNull())


def found(docs: DataFrame, table_: list[float], keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``keep``, a (start, end) array for each base kind, candidates; in the order of KINDS."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.expr("CAST(array() AS array<struct<start:int,end:int>>)")
    cols = []
    docs = docs.withColumn("vetra_low", F.lower(text))
    for kind, (pattern, inner, least, quick) in PATTERNS.items():
        may = reduce(Column.__or__, (F.contains("vetra_low", F.lit(w)) for w in WORDS[kind])) if kind in WORDS else F.lit(True)
        spans = F.transform(matches(text, pattern, inner, least), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
        cols.append(F.when(may & text.rlike(quick), spans).otherwise(none).alias(kind))
    nobody = F.expr("CAST(array() AS array<struct<start:int,end:int,stratum:string,bin:int>>)")
    likely = text.rlike(TOKEN) & text.rlike("[0-9]")
    return docs.select("doc_id", *keep, *cols, F.when(likely, candidates(text, F.array(*(F.lit(x) for x in table_)))).otherwise(nobody).alias("tokens"))


def discovered(tokens: DataFrame, level: float) -> dict[str, int]:
    """Benjamini-Hochberg on the battery's p-values in each stratum: the least bin whose tokens are structured.

    p-values are rounded up to the edges of their bins; what comes to the
    driver is one row for a stratum (nine alphabets, whole or in parts, bands of doubling length).
    """
    bins = tokens.select(F.explode("tokens").alias("t")).groupBy("t.stratum", "t.bin").agg(F.count("*").alias("n"))
    beyond = W.partitionBy("stratum").orderBy(F.col("bin").desc())
    sums = bins.select("stratum", "bin", F.sum("n").over(beyond).alias("beyond"), F.sum("n").over(W.partitionBy("stratum")).alias("m"))
    edge = F.pow(F.lit(10.0), -F.col("bin") / PER_DECADE)
    cut = sums.where(edge <= level * F.col("beyond") / F.col("m")).groupBy("stratum").agg(F.min("bin").alias("bin"))
    return {r["stratum"]: r["bin"] for r in cut.collect()}


def scan(docs: DataFrame, level: float = LEVEL, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, assign, access, hex, random: arrays of (start, end), for every row of ``docs``.

    The first three are matches of the fixed patterns.  ``random`` has runs of
    LEAST_TOKEN or more of ``[A-Za-z0-9+/_-]`` outside those matches that fit an
    encoding (hexadecimal, base 32, 36, 62 or 64, with digits and letters), or
    whose parts between ``+/_-`` do, less those of letters only if LEAST_TOKEN
    characters are left (UUIDs, groups, keys behind a prefix).  Runs that the
    corpus's own words explain (see :func:`surprise`) aren't tested.  Of the
    others, those are reported whose randomness the battery doesn't reject.
    What it rejects is decided by Benjamini-Hochberg at ``level`` over the
    p-values of all runs of one encoding and length band of the whole table: of
    the runs called structured, at most that share is expected to be random keys, however many runs are tested.

    Offsets are code points, ends exclusive.  A null text is empty.  Rows with
    null or repeated doc_id stay; nothing but counts of words, pairs of symbols and bins is shuffled.
    """
    docs = texts(docs, *(k for k in keep if k != "text"))
    table_ = chances({r["pair"]: r["n"] for r in pairs_of(docs).collect()})  # at most len(SYMBOLS) ** 2 rows
    rows = written(found(docs, table_, keep), "tokens")
    cut = discovered(rows, level)
    if cut:
        least = F.create_map(*(F.lit(x) for pair in sorted(cut.items()) for x in pair))
        structured = lambda t: F.coalesce(t["bin"] >= F.try_element_at(least, t["stratum"]), F.lit(False))
    else:
        structured = lambda t: F.lit(False)
    taken = lambda t: reduce(Column.__or__, (touches(F.col(k), t["start"], t["end"]) for k in PATTERNS))
    random = F.transform(F.filter("tokens", lambda t: ~structured(t) & ~taken(t)), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return rows.select("doc_id", *keep, *PATTERNS, random.alias("random"))


def listed(kinds: list[str]) -> Column:
    """``kind:start:end`` of all spans by start, then kind, comma-joined."""

    def tag(n: int) -> Callable[[Column], Column]:
        return lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("kind"), s["end"].alias("end"))

    tagged = F.concat(*(F.transform(k, tag(n)) for n, k in enumerate(kinds)))
    names = F.array(*(F.lit(k) for k in kinds))
    return F.array_join(F.transform(F.array_sort(tagged), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    sizes = [F.size(k).cast("long").alias(f"n_{k}") for k in [*PATTERNS, "random"]]
    return out.select("doc_id", *sizes, F.sha2(listed(list(PATTERNS)).cast("binary"), 256).alias("base_sha256"), listed(KINDS).alias("spans"))
