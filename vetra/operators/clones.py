"""Repeated blocks of lines, renamed clones, and functions that do the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .closure import cut

MIN_BYTES = 160
MIN_DISTINCT = 3


def normalized_lines(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, line, text): kept lines numbered by ``at``, with their numbers in the file.

    One row's lines come from one array, so numbering them needs no shuffle.
    """
    raw = T.lines_of(F.col(text))
    kept = F.filter(F.transform(raw, lambda s, i: F.struct((i + 1).cast("long").alias("line"), T.normalized_line(s).alias("text"))), lambda x: x["text"].isNotNull())
    return files.select(key, F.posexplode(kept).alias("at", "x")).select(key, "at", "x.line", "x.text")


def blocks(files: DataFrame, key: str, text: str, size: int = 6, bits: int = 64) -> DataFrame:
    """(key, line, h1, h2): every run of ``size`` kept lines that is long and varied enough, by 128 bits of its lines (twice ``bits``).

    A line is normalised and hashed once; runs are combined from the hashes of
    their lines inside one text's array, so no window or shuffle is needed.
    """
    raw = F.transform(T.lines_of(F.col(text)), lambda s, i: F.struct((i + 1).cast("long").alias("line"), T.normalized_line(s).alias("text")))
    kept = F.filter(raw, lambda x: x["text"].isNotNull())
    facts = F.transform(kept, lambda x: F.struct(x["line"].alias("line"), F.xxhash64(x["text"]).alias("a"), F.xxhash64(F.lit(1), x["text"]).alias("b"), F.octet_length(x["text"]).alias("n")))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("kept") - (size - 1), F.lit(1))), lambda i: F.slice(F.col("kept"), i, F.lit(size)))
    # a run has no more bytes than its text; no filter on the array: it would be pushed below and normalise every text twice
    rows = files.where(F.octet_length(text) >= MIN_BYTES).select(key, facts.alias("kept")).select(key, F.explode(F.when(F.size("kept") >= size, runs)).alias("run"))
    n = F.aggregate("run", F.lit(size - 1), lambda s, x: s + x["n"])  # with a line break between lines
    short = lambda h: F.shiftrightunsigned(h, 64 - bits) if bits < 64 else h
    rows = rows.select(key, F.col("run")[0]["line"].alias("line"), short(F.xxhash64("run.a")).alias("h1"), short(F.xxhash64("run.b")).alias("h2"), n.alias("n"), F.size(F.array_distinct("run.a")).alias("d"))
    return rows.where((F.col("n") >= MIN_BYTES) & (F.col("d") >= MIN_DISTINCT)).drop("n", "d")


def run_texts(files: DataFrame, key: str, text: str, wanted: DataFrame, size: int = 6) -> DataFrame:
    """(key, line, run): the normalised text of the runs of ``size`` kept lines that begin at the lines of ``wanted`` (key, line); other files aren't looked into."""
    asked = wanted.groupBy(key).agg(F.collect_set("line").alias("asked"))  # lines of one file
    raw = F.transform(T.lines_of(F.col(text)), lambda s, i: F.struct((i + 1).cast("long").alias("line"), T.normalized_line(s).alias("text")))
    rows = files.select(key, text).join(asked, key).select(key, "asked", F.filter(raw, lambda x: x["text"].isNotNull()).alias("kept"))
    at = F.filter(F.sequence(F.lit(1), F.size("kept")), lambda i: F.array_contains("asked", F.col("kept")[i - 1]["line"]))
    rows = rows.select(key, "kept", F.explode(at).alias("i"))
    return rows.select(key, F.col("kept")[F.col("i") - 1]["line"].alias("line"), F.array_join(F.transform(F.slice("kept", F.col("i"), F.lit(size)), lambda x: x["text"]), "\n").alias("run"))


def duplicate_rows(found: DataFrame, key: str, files: DataFrame | None = None, text: str = "content", size: int = 6) -> DataFrame:
    """(key, line, first, first_line) of blocks whose text first stands in another file.

    The first occurrence of a text is a map-side minimum; a common block is one
    aggregate row a task and a skewed join side, never one window.  With
    ``files`` the texts of blocks that share a hash are compared as well, in a second pass over the files that hold such blocks.
    """
    # used twice, so written once instead of normalising all texts again
    keys = cut(found, "blocks")
    same = ["h1", "h2"]
    if files is not None:
        several = keys.groupBy(*same).agg(F.count("*").alias("n")).where("n > 1").drop("n")
        keys = cut(keys.join(several, same), "shared")
        keys = cut(keys.join(run_texts(files, key, text, keys.select(key, "line"), size), [key, "line"]), "texts")
        same = ["h1", "h2", "run"]
    first = keys.groupBy(*same).agg(F.min(F.struct(key, "line")).alias("f"), F.count("*").alias("n")).where("n > 1")
    later = keys.join(first.drop("n"), same)
    return later.where(F.col(key) != F.col(f"f.{key}")).select(key, "line", F.col(f"f.{key}").alias("first"), F.col("f.line").alias("first_line"))


def duplicate_pairs(rows: DataFrame, key: str, focus: DataFrame | None = None) -> DataFrame:
    """One (key, line, other, other_line) for each pair of files: the smallest by (first file, first line, line).

    With ``focus`` (key) the reported side is the later one if it is in focus,
    else the first one; pairs without a focused side are dropped before the choice.
    """
    out = rows
    if focus is not None:
        inside = focus.select(F.col(key).alias("k")).distinct().withColumn("yes", F.lit(True))
        out = out.join(inside.withColumnsRenamed({"k": key, "yes": "later_in"}), key, "left").join(inside.withColumnsRenamed({"k": "first", "yes": "first_in"}), "first", "left")
        out = out.where("later_in OR first_in")
    a, b = F.least(key, "first"), F.greatest(key, "first")
    side = F.struct(F.col("first"), F.col("first_line"), F.col("line"), F.col(key).alias("later"), *([F.coalesce("later_in", F.lit(False)).alias("own")] if focus is not None else []))
    best = out.groupBy(a.alias("a"), b.alias("b")).agg(F.min(side).alias("x"))
    if focus is None:
        return best.select(F.col("x.later").alias(key), F.col("x.line").alias("line"), F.col("x.first").alias("other"), F.col("x.first_line").alias("other_line"))
    pick = lambda yes, no: F.when(F.col("x.own"), F.col(yes)).otherwise(F.col(no))
    return best.select(pick("x.later", "x.first").alias(key), pick("x.line", "x.first_line").alias("line"), pick("x.first", "x.later").alias("other"), pick("x.first_line", "x.line").alias("other_line"))


def duplicate_findings(files: DataFrame, key: str, text: str, size: int = 6, focus: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """Findings of rule FG-DRY-001; nothing if ``size`` is under four.  With ``exact`` equal hashes are confirmed by text."""
    if size < 4:
        files = files.limit(0)
    pairs = duplicate_pairs(duplicate_rows(blocks(files, key, text, size), key, files if exact else None, text, size), key, focus)
    return pairs.select(
        F.lit("FG-DRY-001").alias("rule_id"), F.lit("info").alias("severity"), F.col(key).cast("string").alias("path"), "line",
        F.concat(F.lit(f"{size} normalized lines also stand at "), F.col("other").cast("string"), F.lit(":"), F.col("other_line").cast("string")).alias("evidence"),
    )


#: Words of the languages that no name stands for (fixed values).
KEYWORDS = (
    "abstract and as assert async await begin break case catch class const constructor continue def default defer del do elif else elsif elseif end enum except export extends extern false False final finally fn for foreach from fun func function "
    "global go if impl implements import in instanceof interface is lambda let local loop match mod module mut namespace new next nil None nonlocal not null of operator or package pass private protected pub public raise ref repeat require rescue "
    "return self Self sizeof static struct super switch then this throw throws trait true True try type typeof undefined union unless unsafe until use using val var virtual void volatile when where while with yield"
).split()
#: Calls that say nothing of what a function does (fixed values).
OUTPUT_CALLS = ["log", "print", "println"]
_PIECE = "//[^\n]*|(?s:/\\*.*?\\*/)|#[^\n]*|\"(?:\\\\.|[^\"\\\\])*\"|'(?:\\\\.|[^'\\\\])*'|`(?:\\\\.|[^`\\\\])*`|[A-Za-z_$][A-Za-z0-9_$]*|[0-9][A-Za-z0-9_.]*|[^\\sA-Za-z0-9_$]"
_COMMENT, _NAME = "^(//|/\\*|#)", "^[A-Za-z_$]"


def with_canonical(rows: DataFrame, text: str = "text", name: str = "canonical") -> DataFrame:
    """``rows`` and the tokens of each function without comments, local names replaced by their order of appearance.

    Names that are called or follow a dot are no local names, nor are keywords;
    literals stay.  Each step is a column of its own, so that it is computed once a function.
    """
    rows = rows.withColumn("vetra_t", F.filter(F.regexp_extract_all(F.col(text), F.lit(_PIECE), F.lit(0)), lambda t: ~t.rlike(_COMMENT)))
    before, after = lambda i: F.coalesce(F.get("vetra_t", i - 1), F.lit("")), lambda i: F.coalesce(F.get("vetra_t", i + 1), F.lit(""))
    local = lambda t, i: t.rlike(_NAME) & ~t.isin(KEYWORDS) & (before(i) != ".") & ((after(i) != "(") | before(i).isin("def", "function", "fn", "func", "fun"))
    rows = rows.withColumn("vetra_l", F.transform("vetra_t", local))
    rows = rows.withColumn("vetra_n", F.array_distinct(F.filter("vetra_t", lambda t, i: F.get("vetra_l", i))))
    form = F.transform("vetra_t", lambda t, i: F.when(F.get("vetra_l", i), F.concat(F.lit("$"), F.array_position(F.col("vetra_n"), t).cast("string"))).otherwise(t))
    return rows.withColumn(name, F.array_join(form, " ")).drop("vetra_t", "vetra_l", "vetra_n")


def functions(nodes: DataFrame, least_lines: int = 6) -> DataFrame:
    """(path, family, line, lines, canonical, original, domain, behavior) of the outermost functions of ``least_lines`` or more.

    ``behavior`` has the calls of the function itself, not of functions inside it.
    """
    lines = F.col("end_line") - F.col("start_line") + 1
    f = nodes.where("kind = 'function'").withColumn("lines", lines).where(F.col("lines") >= least_lines)
    outer = f.select(F.col("path").alias("p"), F.col("node_id").alias("i"), F.col("last_id").alias("l"))
    f = f.join(outer, (F.col("path") == F.col("p")) & (F.col("i") < F.col("node_id")) & (F.col("l") >= F.col("node_id")), "left_anti")
    calls = nodes.where("kind = 'call' AND scope_id IS NOT NULL").select("path", F.col("scope_id").alias("node_id"), T.terminal_name(F.col("name")).alias("call"))
    calls = calls.groupBy("path", "node_id").agg(F.collect_set("call").alias("calls"))  # the calls of one function
    f = with_canonical(f.join(calls, ["path", "node_id"], "left"))
    return f.select(
        "path", "family", F.col("start_line").alias("line"), "lines", "canonical", T.trimmed(F.regexp_replace("text", "\\s+", " ")).alias("original"), T.domain_tokens(F.col("name")).alias("domain"),
        signature(F.coalesce("calls", F.array().cast("array<string>"))).alias("behavior"),
    )


def renamed_clones(functions: DataFrame, least_lines: int = 6) -> DataFrame:
    """Pairs (first, later) of functions (path, line, lines, family, canonical, original) that differ in names only."""
    f = functions.where(F.col("lines") >= least_lines).select("path", "line", "family", _key("canonical").alias("same"), _key("original").alias("other_than"))
    return _one_of_each_pair(_with_first(f, ["family", "same"]))


def signature(calls: Column) -> Column:
    """Sorted distinct lower-case calls without output ones; null if fewer than three."""
    names = F.array_sort(F.array_distinct(F.filter(F.transform(calls, lambda c: F.lower(c)), lambda c: ~c.isin(OUTPUT_CALLS))))
    return F.when(F.size(names) >= 3, F.array_join(names, ","))


def same_operations(functions: DataFrame) -> DataFrame:
    """Pairs of functions (path, line, family, canonical, domain array, behavior) that share a domain word and all calls."""
    f = functions.where("behavior IS NOT NULL").select("path", "line", "family", F.explode(F.array_distinct("domain")).alias("word"), _key("behavior").alias("same"), _key("canonical").alias("other_than"))
    return _one_of_each_pair(_with_first(f, ["family", "word", "same"]))


def _key(column: str) -> Column:
    """128 bits for a text."""
    return F.struct(F.xxhash64(column).alias("a"), F.xxhash64(F.lit(1), column).alias("b"))


def _with_first(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows with the first of their key that is in another file and differs: a map-side minimum, never one window."""
    rows = cut(rows, "functions")  # read twice
    first = rows.groupBy(*key).agg(F.min(F.struct("path", "line", "other_than")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(first, key).where((F.col("path") != F.col("first.path")) & (F.col("other_than") != F.col("first.other_than")))


def _one_of_each_pair(rows: DataFrame) -> DataFrame:
    x = F.struct(F.col("first.path").alias("other"), F.col("first.line").alias("other_line"), F.col("line"), F.col("path"))
    best = rows.groupBy(F.least("path", "first.path").alias("a"), F.greatest("path", "first.path").alias("b")).agg(F.min(x).alias("x"))
    return best.select("x.path", "x.line", "x.other", "x.other_line")


def in_focus(pairs: DataFrame, focus: DataFrame | None) -> DataFrame:
    """Pairs (path, line, other, other_line) with a side in ``focus`` (path), which becomes the reported one; the later side if both are."""
    if focus is None:
        return pairs
    inside = focus.select("path").distinct()
    later = pairs.join(inside, "path", "left_semi")
    rest = pairs.join(inside, "path", "left_anti").join(inside.withColumnRenamed("path", "other"), "other", "left_semi")
    return later.unionByName(rest.select(F.col("other").alias("path"), F.col("other_line").alias("line"), F.col("path").alias("other"), F.col("line").alias("other_line")))


def function_findings(functions: DataFrame, least_lines: int = 6, focus: DataFrame | None = None) -> DataFrame:
    """Findings of rules FG-DRY-002 and FG-DRY-003."""

    def of(pairs: DataFrame, rule: str, what: str) -> DataFrame:
        pairs = in_focus(pairs, focus)
        return pairs.select(F.lit(rule).alias("rule_id"), F.lit("info").alias("severity"), "path", "line", F.concat(F.lit(f"{what} also stands at "), "other", F.lit(":"), F.col("other_line").cast("string")).alias("evidence"))

    renamed = of(renamed_clones(functions, least_lines), "FG-DRY-002", "the same function under other names")
    return renamed.unionByName(of(same_operations(functions), "FG-DRY-003", "a function with the same calls and subject"))
