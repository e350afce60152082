"""Queries of the library over the driver's tables, each beside its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clones, closure, lexical, measure, policy, sessions
from ..sources import files, syntax
from ..streaming import sessions as streams
from . import report

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: White space of all scripts in the syntax of the SQL engine's patterns.
_SP = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LINES = r"""lines AS (SELECT doc_id, CAST(pos AS BIGINT) AS line, regexp_replace(part, '\r\z', '') AS text FROM (
  SELECT doc_id, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS pos FROM (
    SELECT doc_id, string_split(regexp_replace(text, '\n\z', ''), chr(10)) AS parts FROM documents WHERE text <> '') a) b)"""
_PATH = r"""paths AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path FROM pages)"""


def paths(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1).alias("path"))


# ---- sources -------------------------------------------------------------------


@query(f"WITH {_LINES} SELECT doc_id, line, CAST(length(text) AS BIGINT) AS n_chars FROM lines")
def lines_numbered(spark, sf_dir):
    return files.lines(table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", "line", F.length("text").cast("long").alias("n_chars"))


_EXT = r"CASE WHEN regexp_matches(name, '^.+\.[^.]*$') THEN regexp_extract(name, '\.([^.]*)$', 1) END"


@query(rf"""WITH {_PATH}, n AS (SELECT *, string_split(path, '/')[-1] AS name FROM paths), e AS (SELECT *, {_EXT} AS ext FROM n)
SELECT page_id, path, ext, list_has_any(string_split(path, '/'), ['.git','.vetra','node_modules','target','dist','build','coverage','vendor','.next','.turbo']) AS excluded,
  len(list_filter(string_split(path, '/'), lambda c: lower(c) IN ('test','tests','__tests__'))) > 0 OR regexp_matches(name, '(_test\.go|_test\.rs)$|\.test\.|\.spec\.') AS is_test,
  coalesce(ext IN ('js','ts','py','rs','go','sql','php','rb'), false) AS is_source,
  lower(name) = 'dockerfile' OR starts_with(lower(name), '.env') OR coalesce(lower(ext) IN ('yaml','yml','json','toml','ini','conf','properties'), false) AS is_secret_text FROM e""")
def path_classify(spark, sf_dir):
    p, path = paths(table(spark, sf_dir, "pages")), F.col("path")
    return p.select("page_id", "path", files.extension(path).alias("ext"), files.is_excluded(path).alias("excluded"), files.is_test_path(path).alias("is_test"), files.is_source(path).alias("is_source"), files.is_secret_text(path).alias("is_secret_text"))


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents WHERE strlen(text) <= 1000")
def size_filtered_scan(spark, sf_dir):
    size = F.octet_length("text").cast("long")
    return table(spark, sf_dir, "documents").where(size <= 1000).select("doc_id", size.alias("n_bytes"))


@query(r"""WITH s AS (SELECT page_id, regexp_extract_all(html, '(?is)<script\b[^>]*>(.*?)</script>', 1) AS b, regexp_extract_all(html, '(?is)(<script\b[^>]*>).*?</script>', 1) AS t FROM pages)
SELECT page_id, CAST(unnest(range(1, len(b) + 1)) AS BIGINT) AS ordinal, unnest(b) AS script, regexp_matches(unnest(t), '(?i)lang\s*=\s*["'']?ts') AS is_ts FROM s""")
def script_extract(spark, sf_dir):
    return files.embedded_scripts(table(spark, sf_dir, "pages"), "page_id", "html")


@query(r"""SELECT page_id, CAST(length(html) AS BIGINT) AS n_chars, CAST(length(html) - length(replace(html, chr(10), '')) AS BIGINT) AS n_breaks,
  CAST(length(regexp_replace(array_to_string(regexp_extract_all(html, '(?is)<script\b[^>]*>(.*?)</script>', 1), ''), '\s', '', 'g')) AS BIGINT) AS n_script FROM pages""")
def script_masked(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("m", files.masked_script(F.col("html")))
    breaks = (F.length("m") - F.length(F.replace("m", F.lit("\n"), F.lit("")))).cast("long")
    return p.select("page_id", F.length("m").cast("long").alias("n_chars"), breaks.alias("n_breaks"), F.length(F.regexp_replace("m", "\\s", "")).cast("long").alias("n_script"))


@query(r"""SELECT l_orderkey, l_linenumber, CAST(l_partkey AS BIGINT) AS start_line, CAST(l_partkey + CASE WHEN l_linenumber = 1 THEN 1 ELSE CAST(l_quantity AS BIGINT) % 5 END - 1 AS BIGINT) AS end_line
FROM lineitem WHERE l_linenumber = 1 OR CAST(l_quantity AS BIGINT) % 5 > 0""")
def hunk_ranges(spark, sf_dir):
    count = F.when(F.col("l_linenumber") == 1, "").otherwise(F.concat(F.lit(","), (F.col("l_quantity").cast("long") % 5).cast("string")))
    header = F.concat(F.lit("@@ -1,2 +"), F.col("l_partkey").cast("string"), count, F.lit(" @@ fn"))
    h = table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("path"), header.alias("hunk_header"))
    return files.hunks(h).select("path.l_orderkey", "path.l_linenumber", "start_line", "end_line")


@query("""WITH x AS (SELECT DISTINCT l_orderkey, l_linenumber, first_value(l_suppkey) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey) AS s FROM lineitem)
SELECT CAST(s AS VARCHAR) AS path, CAST(l_linenumber AS BIGINT) AS line, CAST(l_orderkey % 3 AS BIGINT) AS hits, count(*) AS n FROM x GROUP BY ALL""")
def lcov_rows(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"))
    rows = x.select(
        F.col("l_orderkey").alias("report"),
        F.explode(F.array(
            F.struct((F.col("l_linenumber") * 2).alias("at"), F.concat(F.lit("SF:./"), F.col("s").cast("string")).alias("value")),
            F.struct((F.col("l_linenumber") * 2 + 1).alias("at"), F.concat(F.lit("DA:"), F.col("l_linenumber").cast("string"), F.lit(","), (F.col("l_orderkey") % 3).cast("string")).alias("value")),
        )).alias("x"),
    ).select("report", "x.at", "x.value")
    return files.lcov(rows).groupBy("path", "line", "hits").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT event_id, k AS name FROM (SELECT event_id, unnest(json_keys(props)) AS k FROM events) x")
def manifest_names(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"dependencies":{'), F.regexp_extract("props", "^\\{(.*)\\}$", 1), F.lit("}}")).alias("json"))
    return files.dependency_names(e, "event_id", "json")


# ---- lexical rules ----------------------------------------------------------------


@query(rf"""WITH {_LINES} SELECT doc_id, line, 'credential-like value redacted' AS evidence FROM lines
WHERE (regexp_matches(text, 'AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{36,255}}|sk_(?:live|prod)_[A-Za-z0-9]{{16,}}|-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----')
  OR regexp_matches(text, '(?i)\btoken\s*=\s*["''][0-9a-f]{{32,}}["'']')) AND NOT regexp_matches(text, '^\s*(#|//|;)')""")
def credential_lines(spark, sf_dir):
    return lexical.credential_lines(files.lines(table(spark, sf_dir, "documents"), "text", "doc_id"), extension=True)


@query(r"""WITH m AS (SELECT doc_id, text, unnest(string_split(text, 'Version ')[:-2]) AS part, unnest(range(1, len(string_split(text, 'Version ')))) AS k, string_split(text, 'Version ') AS parts FROM documents WHERE text LIKE '%Version %'),
p AS (SELECT doc_id, array_to_string(parts[:k], 'Version ') AS before FROM m)
SELECT doc_id, CAST(length(before) - length(replace(before, chr(10), '')) + 1 AS BIGINT) AS line FROM p""")
def pattern_lines(spark, sf_dir):
    return lexical.match_lines(table(spark, sf_dir, "documents"), "doc_id", "text", "Version ")


@query(rf"""WITH {_LINES}, f AS (SELECT doc_id, line, CASE WHEN length(text) > 600 THEN 'error' ELSE 'warning' END AS severity FROM lines WHERE length(text) > 200),
m AS (SELECT doc_id, line FROM lines WHERE contains(text, 'License')), c AS (SELECT doc_id, line FROM m UNION SELECT doc_id, line + 1 FROM m UNION SELECT doc_id, line - 1 FROM m)
SELECT * FROM f WHERE severity = 'error' OR NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = f.doc_id AND c.line = f.line)""")
def comment_suppressed(spark, sf_dir):
    lines = files.lines(table(spark, sf_dir, "documents"), "text", "doc_id")
    found = lines.where(F.length("text") > 200).select("doc_id", "line", F.when(F.length("text") > 600, "error").otherwise("warning").alias("severity"), F.lit("FG-LONG").alias("rule_id"))
    # a licence line stands for two markers: one on its own line and one on the line before
    marked = lines.where(F.contains("text", F.lit("License"))).select("doc_id", F.explode(F.array("line", F.col("line") - 1)).alias("line"), F.lit("# vetra: allow FG-LONG -- licence").alias("text"))
    return policy.suppress(found, policy.suppressions(marked, key="doc_id"), "doc_id").drop("rule_id")


@query(rf"""WITH t AS (SELECT p_partkey, p_name, p_type FROM part)
SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(p_name || '-' || p_partkey || '_x', '[^A-Za-z0-9_]+'), lambda x: regexp_matches(x, '^[A-Za-z_]')), ',') AS identifiers,
  lower(regexp_replace(p_type || ' (' || p_name || ')', '{_SP}+', '', 'g')) AS compact, regexp_replace(replace(lower('Find_' || replace(p_name, ' ', '_') || 'Async'), '_', ''), 'async$', '') AS method,
  list_filter(regexp_split_to_array('db.' || replace(p_name, ' ', '::'), '[.:>]'), lambda x: x <> '')[-1] AS terminal,
  CASE WHEN p_partkey % 3 = 0 THEN 'a' WHEN p_partkey % 3 = 1 THEN p_name END AS quoted,
  CASE WHEN p_partkey % 2 = 0 THEN 'total' END AS assigned,
  array_to_string(list_sort(list_distinct(list_filter(string_split(lower(replace(p_name, ' ', '_')) || '_handle', '_'), lambda x: length(x) >= 4 AND x <> 'handle'))), ',') AS domain FROM t""")
def text_functions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name, key = F.col("p_name"), F.col("p_partkey")
    snake = F.replace(name, F.lit(" "), F.lit("_"))
    text = F.when(key % 3 == 0, "x \"a\" 'b'").when(key % 3 == 1, F.concat(F.lit("'"), name, F.lit("' y"))).otherwise("none")
    line = F.when(key % 2 == 0, "total = a == b").otherwise("a == b")
    camel = F.concat(snake, F.lit("Handle"))
    return p.select(
        "p_partkey", F.array_join(T.identifiers(F.concat(name, F.lit("-"), key.cast("string"), F.lit("_x"))), ",").alias("identifiers"),
        T.compact_code(F.concat("p_type", F.lit(" ("), name, F.lit(")"))).alias("compact"), T.normalized_method(F.concat(F.lit("Find_"), snake, F.lit("Async"))).alias("method"),
        T.terminal_name(F.concat(F.lit("db."), F.replace(name, F.lit(" "), F.lit("::")))).alias("terminal"), T.quoted_value(text).alias("quoted"), T.trimmed(T.assignment(line)["left"]).alias("assigned"),
        F.array_join(T.domain_tokens(camel), ",").alias("domain"),
    )


@query("""SELECT doc_id, CASE WHEN length(text) > 240 THEN substr(text, 1, 240) || '…' ELSE text END AS evidence, CASE WHEN length(text) > 2000 THEN substr(text, 1, 1999) || '…' ELSE text END AS report,
  CAST(CASE WHEN length(text) > 8000 THEN 8019 ELSE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) END AS BIGINT) AS n_output FROM documents""")
def truncate_evidence(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.truncated(t, 240).alias("evidence"), T.truncated_within(t, 2000).alias("report"), F.length(T.truncated_output(t)).cast("long").alias("n_output"))


@query(r"""SELECT page_id, 'track' AS name, regexp_extract(html, 'track\((\d+)\)', 1) AS argument, true AS literal, CAST(0 AS INTEGER) AS loop_depth FROM pages WHERE regexp_matches(html, '<script>[^<]*(</p>[^<]*)?track\(\d+\)')""")
def script_calls(spark, sf_dir):
    scripts = files.embedded_scripts(table(spark, sf_dir, "pages"), "page_id", "html")
    n = syntax.nodes(scripts.select(F.concat(F.col("page_id").cast("string"), F.lit(".js")).alias("path"), F.col("script").alias("content")))
    return n.where("kind = 'call'").select(F.split_part("path", F.lit("."), F.lit(1)).cast("long").alias("page_id"), "name", "argument", "literal", "loop_depth")


# ---- clones -----------------------------------------------------------------------

_BLOCKS = rf"""{_LINES}, tr AS (SELECT doc_id, line, regexp_replace(text, '^{_SP}+|{_SP}+$', '', 'g') AS t FROM lines),
nl AS (SELECT doc_id, line, regexp_replace(t, '{_SP}+', ' ', 'g') AS t FROM tr WHERE t <> '' AND NOT regexp_matches(t, '^(//|#|/\*|\*|import |use |package )')),
fr AS (SELECT doc_id, line, list(t) OVER w AS b FROM nl WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
bl AS (SELECT doc_id, line, array_to_string(b, chr(10)) AS block FROM fr WHERE len(b) = 6 AND len(list_distinct(b)) >= 3 AND strlen(array_to_string(b, chr(10))) >= 160),
du AS (SELECT doc_id, line, first_value(doc_id) OVER w AS first, first_value(line) OVER w AS first_line FROM bl WINDOW w AS (PARTITION BY block ORDER BY doc_id, line)),
rows_ AS (SELECT * FROM du WHERE doc_id <> first),
pairs AS (SELECT doc_id, line, first AS other, first_line AS other_line FROM (SELECT *, row_number() OVER (PARTITION BY least(doc_id, first), greatest(doc_id, first) ORDER BY first, first_line, line, doc_id) AS rn FROM rows_) z WHERE rn = 1)"""


@query(f"WITH {_BLOCKS} SELECT * FROM rows_")
def duplicate_blocks(spark, sf_dir):
    return clones.duplicate_rows(clones.blocks(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


@query(f"WITH {_BLOCKS} SELECT * FROM pairs")
def duplicate_pairs(spark, sf_dir):
    return clones.duplicate_pairs(clones.duplicate_rows(clones.blocks(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id"), "doc_id")


@query(f"""WITH {_BLOCKS}, s AS (SELECT doc_id FROM documents WHERE source = 'src0'),
x AS (SELECT *, doc_id IN (SELECT doc_id FROM s) AS own, first IN (SELECT doc_id FROM s) AS theirs FROM rows_),
y AS (SELECT *, row_number() OVER (PARTITION BY least(doc_id, first), greatest(doc_id, first) ORDER BY first, first_line, line, doc_id) AS rn FROM x WHERE own OR theirs)
SELECT CASE WHEN own THEN doc_id ELSE first END AS doc_id, CASE WHEN own THEN line ELSE first_line END AS line, CASE WHEN own THEN first ELSE doc_id END AS other, CASE WHEN own THEN first_line ELSE line END AS other_line FROM y WHERE rn = 1""")
def duplicate_focus(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = clones.duplicate_rows(clones.blocks(docs, "doc_id", "text"), "doc_id")
    return clones.duplicate_pairs(rows, "doc_id", docs.where("source = 'src0'").select("doc_id"))


@query(f"""WITH {_BLOCKS} SELECT CAST(doc_id AS VARCHAR) AS path, line, 'FG-DRY-001' AS rule_id, 'warning' AS severity, true AS blocking,
  '6 normalized lines also stand at ' || other || ':' || other_line AS evidence FROM pairs""")
def gate_duplicates(spark, sf_dir):
    found = clones.duplicate_findings(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("seq", F.lit(0))
    config = spark.createDataFrame([("FG-DRY-001", None, "warning", None)], "rule_id string, enabled boolean, severity string, block boolean")
    known = spark.createDataFrame([], "rule_id string, path string, evidence string, count long")
    return policy.gate(found, config, known).select("path", "line", "rule_id", "severity", "blocking", "evidence")


_FUNCS = """f AS (SELECT printf('%09d', o_orderkey) AS path, o_orderpriority AS word, string_agg(DISTINCT lower(p_type), ',' ORDER BY lower(p_type)) AS behavior, count(DISTINCT lower(p_type)) AS n
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL)"""


@query(f"""WITH {_FUNCS}, w AS (SELECT path, first_value(path) OVER (PARTITION BY word, behavior ORDER BY path) AS other FROM f WHERE n >= 3)
SELECT path, CAST(1 AS BIGINT) AS line, other, CAST(1 AS BIGINT) AS other_line FROM w WHERE path <> other""")
def same_operations(spark, sf_dir):
    line, part = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), table(spark, sf_dir, "part").select("p_partkey", "p_type")
    calls = line.join(part, line.l_partkey == part.p_partkey).groupBy("l_orderkey").agg(F.collect_set("p_type").alias("calls"))
    f = table(spark, sf_dir, "orders").join(calls, F.col("o_orderkey") == F.col("l_orderkey"))
    f = f.select(F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("path"), F.lit(1).cast("long").alias("line"), F.lit("x").alias("family"), F.col("o_orderkey").cast("string").alias("canonical"), F.array("o_orderpriority").alias("domain"), clones.signature(F.col("calls")).alias("behavior"))
    return clones.same_operations(f)


@query("""WITH f AS (SELECT printf('%09d', c_custkey) AS path, c_mktsegment || ':' || (CAST(floor(c_acctbal) AS BIGINT) % 100) AS canonical FROM customer),
w AS (SELECT path, first_value(path) OVER (PARTITION BY canonical ORDER BY path) AS other FROM f) SELECT path, CAST(1 AS BIGINT) AS line, other, CAST(1 AS BIGINT) AS other_line FROM w WHERE path <> other""")
def renamed_clones(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    canonical = F.concat("c_mktsegment", F.lit(":"), (F.floor("c_acctbal") % 100).cast("string"))
    f = c.select(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("path"), F.lit(1).cast("long").alias("line"), F.lit(9).alias("lines"), F.lit("x").alias("family"), canonical.alias("canonical"), F.col("c_name").alias("original"))
    return clones.renamed_clones(f)


# ---- policy ----------------------------------------------------------------------

_FOUND = """f AS (SELECT event_id AS seq, event_type AS rule_id, CAST(user_id AS VARCHAR) AS path, CAST(floor(value) AS BIGINT) AS line, props AS evidence, ts,
  CASE WHEN value >= 150 THEN 'error' WHEN value >= 40 THEN 'warning' ELSE 'info' END AS severity FROM events)"""


def event_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    severity = F.when(value >= 150, "error").when(value >= 40, "warning").otherwise("info")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("rule_id"), F.col("user_id").cast("string").alias("path"), F.floor(value).cast("long").alias("line"), F.col("props").alias("evidence"), "ts", severity.alias("severity"))


_CONFIG = [("click", False, None, None), ("view", None, "info", None), ("error", True, "error", True), ("signup", None, None, False)]
_CFG = "c(rule_id, enabled, sev, block) AS (VALUES ('click', false, NULL, NULL), ('view', NULL, 'info', NULL), ('error', true, 'error', true), ('signup', NULL, NULL, false))"


def config(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_CONFIG, "rule_id string, enabled boolean, severity string, block boolean")


@query(f"WITH {_FOUND}, {_CFG} SELECT seq, f.rule_id, coalesce(sev, severity) AS severity, block FROM f LEFT JOIN c ON c.rule_id = f.rule_id WHERE coalesce(enabled, true)")
def rule_override(spark, sf_dir):
    return policy.apply_rules(event_findings(spark, sf_dir), config(spark)).select("seq", "rule_id", "severity", "block")


_GRID = [(m, v, w) for m in ("lite", "focus", "strict") for v in (1, 2) for w in (None, True, False)]


@query(f"""WITH {_FOUND}, {_CFG}, g(mode, version, wb) AS (VALUES {", ".join(f"('{m}', {v}, CAST({'NULL' if w is None else str(w).lower()} AS BOOLEAN))" for m, v, w in _GRID)}),
n AS (SELECT severity, block, count(*) AS n FROM f LEFT JOIN c ON c.rule_id = f.rule_id GROUP BY ALL)
SELECT mode, version, wb AS warnings_block, severity, block, n, CASE WHEN mode = 'lite' THEN false WHEN block IS NOT NULL THEN block WHEN wb THEN severity <> 'info' WHEN NOT wb THEN mode = 'strict' AND severity = 'error'
  WHEN version >= 2 AND mode = 'strict' THEN severity <> 'info' WHEN mode = 'strict' THEN severity = 'error' ELSE false END AS blocking FROM n, g""")
def blocking_matrix(spark, sf_dir):
    kinds = event_findings(spark, sf_dir).join(F.broadcast(config(spark).select("rule_id", "block")), "rule_id", "left").groupBy("severity", "block").agg(F.count("*").alias("n"))
    grid = spark.createDataFrame(_GRID, "mode string, version int, warnings_block boolean")
    # a handful of counted kinds by eighteen settings
    out = kinds.join(F.broadcast(grid), F.lit(True))
    return out.withColumn("blocking", policy.blocks(F.col("severity"), F.col("mode"), F.col("version"), F.col("warnings_block"), F.col("block"))).select("mode", "version", "warnings_block", "severity", "block", "n", "blocking")


_CHECKS = """k AS (SELECT CAST(o_custkey % 150 AS VARCHAR) AS path, o_orderstatus <> 'F' AS success, o_orderpriority = '1-URGENT' AS required FROM orders)"""
_SUMMARY = f"""{_FOUND}, {_CHECKS}, a AS (SELECT path, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS info, count(*) FILTER (severity = 'error') AS blocking, count(*) AS n_findings FROM f GROUP BY path),
b AS (SELECT path, count(*) FILTER (success) AS checks_passed, count(*) FILTER (NOT success) AS checks_failed, count(*) FILTER (NOT success AND required) AS rf FROM k GROUP BY path),
s AS (SELECT coalesce(a.path, b.path) AS path, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(info, 0) AS info, coalesce(blocking, 0) AS blocking, coalesce(n_findings, 0) AS n_findings, coalesce(checks_passed, 0) AS checks_passed, coalesce(checks_failed, 0) AS checks_failed,
  CASE WHEN coalesce(rf, 0) > 0 OR coalesce(blocking, 0) > 0 THEN 'blocked' WHEN coalesce(n_findings, 0) > 0 OR coalesce(checks_failed, 0) > 0 THEN 'warning' ELSE 'passed' END AS status FROM a FULL JOIN b ON a.path = b.path)"""


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = event_findings(spark, sf_dir).withColumn("blocking", F.col("severity") == "error")
    checks = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 150).cast("string").alias("path"), (F.col("o_orderstatus") != "F").alias("success"), (F.col("o_orderpriority") == "1-URGENT").alias("required"))
    return policy.summary(found, checks, ["path"])


@query(f"WITH {_SUMMARY} SELECT * FROM s")
def gate_summary(spark, sf_dir):
    return summaries(spark, sf_dir)


@query(f"""WITH {_SUMMARY} SELECT substr(path, 1, 1) AS repository, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(warnings) AS BIGINT) AS warnings, CAST(sum(info) AS BIGINT) AS info, CAST(sum(blocking) AS BIGINT) AS blocking, CAST(sum(n_findings) AS BIGINT) AS n_findings,
  CAST(sum(checks_passed) AS BIGINT) AS checks_passed, CAST(sum(checks_failed) AS BIGINT) AS checks_failed, CASE max(CASE status WHEN 'blocked' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) WHEN 2 THEN 'blocked' WHEN 1 THEN 'warning' ELSE 'passed' END AS status FROM s GROUP BY 1""")
def merged_report(spark, sf_dir):
    return policy.merged(summaries(spark, sf_dir).withColumn("repository", F.substring("path", 1, 1)), ["repository"])


_BASE = f"""{_FOUND}, e AS (SELECT *, rule_id || ':' || path AS k FROM f), old AS (SELECT rule_id, path, count(*) AS n, arg_min(severity, seq) AS severity FROM e WHERE ts < TIMESTAMP '2024-01-11' GROUP BY ALL)"""


@query(f"WITH {_BASE} SELECT rule_id, path, severity, n AS count FROM old")
def baseline_build(spark, sf_dir):
    return policy.baseline_of(event_findings(spark, sf_dir).where("ts < TIMESTAMP '2024-01-11'"), ["rule_id", "path"])


@query(f"""WITH {_BASE}, l AS (SELECT seq, rule_id, path, row_number() OVER (PARTITION BY rule_id, path ORDER BY seq) AS rn FROM e WHERE ts >= TIMESTAMP '2024-01-11')
SELECT seq, l.rule_id, l.path FROM l LEFT JOIN old ON old.rule_id = l.rule_id AND old.path = l.path WHERE rn > coalesce(n, 0)""")
def baseline_diff(spark, sf_dir):
    found = event_findings(spark, sf_dir)
    known = policy.checked_baseline(policy.baseline_of(found.where("ts < TIMESTAMP '2024-01-11'"), ["rule_id", "path"]), 2)
    return policy.beyond_baseline(found.where("ts >= TIMESTAMP '2024-01-11'"), known, ["rule_id", "path"], salts=16).select("seq", "rule_id", "path")


@query("""SELECT event_type, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-11' EXCEPT ALL SELECT event_type, user_id FROM events WHERE ts < TIMESTAMP '2024-01-11'""")
def added_items_bag(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "user_id", "ts", "event_id")
    late, early = e.where("ts >= TIMESTAMP '2024-01-11'"), e.where("ts < TIMESTAMP '2024-01-11'")
    return policy.new_items(late, early, ["event_type", "user_id"], ["event_id"]).select("event_type", "user_id")


@query(f"""WITH {_FOUND} SELECT rule_id, path, line, min(seq) AS seq FROM f GROUP BY rule_id, path, line""")
def first_findings(spark, sf_dir):
    return policy.first_of_each(event_findings(spark, sf_dir)).select("rule_id", "path", "line", "seq")


_DAY = "CAST(date_diff('day', DATE '1992-01-01', CAST({} AS DATE)) AS BIGINT)"


def _day(column: str):
    return F.date_diff(F.to_date(column), F.lit("1992-01-01").cast("date")).cast("long")


def _millis(column: str):
    """Milliseconds since 1970 as the column's wall clock shows them, whatever the session's zone."""
    second = F.floor(F.expr(f"extract(SECOND FROM {column})") * 1000).cast("long")
    minute = F.datediff(column, F.lit("1970-01-01").cast("date")).cast("long") * 1440 + F.hour(column) * 60 + F.minute(column)
    return minute * 60_000 + second


def _scope(spark: SparkSession, sf_dir: str, days: int) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), _day("o_orderdate").alias("start_line"), (_day("o_orderdate") + days).alias("end_line"))


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey
  AND {_DAY.format('l_shipdate')} <= {_DAY.format('o_orderdate')} + 30 AND {_DAY.format('l_shipdate')} + l_linenumber >= {_DAY.format('o_orderdate')})""")
def scope_overlap(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), "l_orderkey", "l_linenumber", "l_partkey", _day("l_shipdate").alias("line"), (_day("l_shipdate") + F.col("l_linenumber")).alias("end_line"))
    return policy.in_changed_lines(found, _scope(spark, sf_dir, 30)).select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"""WITH i AS (SELECT l_suppkey, l_returnflag = 'R' AS hit FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND {_DAY.format('l_shipdate')} BETWEEN {_DAY.format('o_orderdate')} AND {_DAY.format('o_orderdate')} + 400))
SELECT l_suppkey, count(*) AS coverable, count(*) FILTER (hit) AS covered, CAST(count(*) FILTER (hit) * 100 // count(*) AS BIGINT) AS percent, count(*) FILTER (hit) * 100 // count(*) < 33 AS finding FROM i GROUP BY l_suppkey""")
def changed_coverage(spark, sf_dir):
    hits = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_orderkey").cast("string").alias("path"), _day("l_shipdate").alias("line"), (F.col("l_returnflag") == "R").cast("long").alias("hits"))
    out = measure.changed_coverage(hits, _scope(spark, sf_dir, 400), ["l_suppkey"])
    return out.withColumn("finding", measure.coverage_finding(F.col("percent"), 33))


# ---- reports ---------------------------------------------------------------------


@query(f"""WITH {_FOUND}, n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line, rule_id, seq) AS rn, count(*) OVER (PARTITION BY path) AS total FROM f)
SELECT path, string_agg('[' || severity || '] ' || rule_id || ' ' || path || ':' || line || ' ' || evidence, chr(10) ORDER BY rn) FILTER (rn <= 5) || CASE WHEN max(total) > 5 THEN chr(10) || (max(total) - 5) || ' omitted' ELSE '' END AS report FROM n GROUP BY path""")
def top5_findings(spark, sf_dir):
    return report.compact(event_findings(spark, sf_dir).withColumn("title", F.col("evidence")), "path")


@query(f"""WITH {_FOUND} SELECT seq, rule_id AS "rule", CASE severity WHEN 'error' THEN 'error' WHEN 'warning' THEN 'warning' ELSE 'note' END AS level, path AS uri, CAST(line AS VARCHAR) AS start_line, CAST(line AS VARCHAR) AS end_line,
  rule_id || ' Evidence: ' || evidence || ' Fix: none' AS message, rule_id || ':' || path || ':' || evidence AS fingerprint FROM f""")
def sarif_results(spark, sf_dir):
    f = event_findings(spark, sf_dir).withColumns({"title": F.col("rule_id"), "recommendation": F.lit("none"), "confidence": F.lit("heuristic"), "blocking": F.lit(False), "end_line": F.lit(None).cast("long")})
    keyed = f.withColumn("path", F.concat_ws("|", F.col("seq").cast("string"), "path"))
    r = report.sarif_results(keyed).withColumn("seq", F.substring_index("path", "|", 1).cast("long"))
    get = lambda p: F.get_json_object("result", p)
    strip = lambda c: F.regexp_replace(c, "[0-9]+\\|", "")
    place = "$.locations[0].physicalLocation"
    return r.select("seq", get("$.ruleId").alias("rule"), get("$.level").alias("level"), strip(get(f"{place}.artifactLocation.uri")).alias("uri"), get(f"{place}.region.startLine").alias("start_line"), get(f"{place}.region.endLine").alias("end_line"), get("$.message.text").alias("message"), strip(get("$.partialFingerprints.finding")).alias("fingerprint"))


@query("""SELECT o_orderkey, 'FG-CHECK-' || upper(regexp_replace(o_orderpriority, '[^A-Za-z0-9]', '-', 'g')) AS "rule", CASE WHEN o_orderstatus = 'F' THEN 'error' ELSE 'warning' END AS level, 'run failed: ' || CASE WHEN o_orderkey % 2 = 0 THEN 'bad ' || o_orderkey ELSE 'command failed' END AS message FROM orders WHERE o_orderstatus <> 'O'""")
def sarif_checks(spark, sf_dir):
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    output = F.when(key % 2 == 0, F.concat(F.lit(" \n\nbad "), key.cast("string"), F.lit("\nmore"))).otherwise(" \n ")
    c = o.select(F.col("o_orderpriority").alias("name"), F.lit("run").alias("command"), (F.col("o_orderstatus") == "F").alias("required"), (F.col("o_orderstatus") == "O").alias("success"), key.cast("int").alias("exit_code"), output.alias("output"), F.lit(False).alias("cached"))
    get = lambda p: F.get_json_object("result", p)
    return report.sarif_checks(c).select(get("$.properties.exitCode").cast("long").alias("o_orderkey"), get("$.ruleId").alias("rule"), get("$.level").alias("level"), get("$.message.text").alias("message"))


# ---- measures --------------------------------------------------------------------


@query("SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS detected FROM documents GROUP BY source")
def language_detect(spark, sf_dir):
    return measure.detected(table(spark, sf_dir, "documents"), "source", "lang")


@query("""WITH v AS (SELECT p_brand, p_size AS a, p_partkey % 10 AS b, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey % 7 END AS c FROM part WHERE p_partkey % 11 <> 0),
m AS (SELECT p_brand, max({'a': a, 'b': b, 'c': c}) AS t FROM v GROUP BY p_brand) SELECT p_brand, t.a || '.' || t.b || '.' || t.c AS latest FROM m""")
def latest_version(spark, sf_dir):
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    patch = F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("."), (key % 7).cast("string")))
    text = F.concat(F.lit("v"), F.col("p_size").cast("string"), F.lit("."), (key % 10).cast("string"), patch, F.when(key % 5 == 0, "-rc1").otherwise(""))
    text = F.when(key % 11 == 0, "1.2.3.4").otherwise(text)
    best = p.select("p_brand", T.version_triple(text).alias("v")).where("v IS NOT NULL").groupBy("p_brand").agg(F.max("v").alias("v"))
    return best.select("p_brand", F.concat_ws(".", F.col("v.major").cast("string"), F.col("v.minor").cast("string"), F.col("v.patch").cast("string")).alias("latest"))


@query("SELECT c_custkey, CAST(20 * ((c_acctbal > 0)::INT + (c_acctbal > 1000)::INT + (c_nationkey % 2 = 0)::INT + (c_mktsegment = 'BUILDING')::INT + (c_custkey % 3 = 0)::INT) AS INTEGER) AS score FROM customer")
def completeness_score(spark, sf_dir):
    facts = [F.col("c_acctbal") > 0, F.col("c_acctbal") > 1000, F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment") == "BUILDING", F.col("c_custkey") % 3 == 0]
    return table(spark, sf_dir, "customer").select("c_custkey", measure.completeness(*facts).alias("score"))


@query("""SELECT d.lang, count(*) FILTER (quality = 1 AND n_chars > 1500) AS tp, count(*) FILTER (quality <> 1 AND n_chars > 1500) AS fp, count(*) FILTER (quality = 1 AND n_chars <= 1500) AS fn,
  coalesce(count(*) FILTER (quality = 1 AND n_chars > 1500) / nullif(count(*) FILTER (n_chars > 1500), 0), 1.0) AS precision, coalesce(count(*) FILTER (quality = 1 AND n_chars > 1500) / nullif(count(*) FILTER (quality = 1), 0), 1.0) AS recall
FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.lang""")
def precision_recall(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return measure.precision_recall(d.select("lang", (F.col("quality") == 1).alias("expected"), (F.col("n_chars") > 1500).alias("found")), ["lang"])


@query("""SELECT source, sha256(count(*) || ':' || sum(CAST(('0x' || substr(h, 1, 15)) AS BIGINT)) || ':' || sum(CAST(('0x' || substr(h, 16, 15)) AS BIGINT))) AS fingerprint
FROM (SELECT source, sha256(doc_id || ':' || sha256(text)) AS h FROM documents) x GROUP BY source""")
def dependency_fingerprint(spark, sf_dir):
    return measure.fingerprint(table(spark, sf_dir, "documents").withColumn("path", F.col("doc_id").cast("string")), ["source"], "path", "text")


@query("SELECT o_custkey, CAST(least(greatest(sum(o_orderkey % 900) + 120, 600), 3600) AS BIGINT) AS seconds FROM orders GROUP BY o_custkey")
def stop_timeout(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(measure.stop_timeout(F.sum(F.col("o_orderkey") % 900)).alias("seconds"))


# ---- graph -----------------------------------------------------------------------

# a tree of parts, with a ring at its root
_EDGES = "e AS (SELECT p_partkey AS src, CASE WHEN p_partkey < 3 THEN (p_partkey + 1) % 3 ELSE p_partkey // 3 END AS dst FROM part)"


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(key.alias("src"), F.when(key < 3, (key + 1) % 3).otherwise(F.floor(key / 3)).cast("long").alias("dst"))


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, CAST(dst AS BIGINT) AS dst FROM r")
def call_closure(spark, sf_dir):
    return closure.reach(part_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {_EDGES}, r AS (SELECT src, src AS dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)
SELECT src AS name, CAST(bit_or(CASE WHEN p_size % 10 = 0 THEN 1 WHEN p_size % 10 = 1 THEN 2 ELSE 0 END) AS INTEGER) AS sinks, bool_or(p_size = 7) AS authorized FROM r JOIN part ON p_partkey = dst GROUP BY src""")
def wrapper_summaries(spark, sf_dir):
    size = F.col("p_size")
    f = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.when(size % 10 == 0, 1).when(size % 10 == 1, 2).otherwise(0).alias("sinks"), (size == 7).alias("authorized"), F.lit(False).alias("is_source"))
    calls = part_edges(spark, sf_dir).select(F.col("src").alias("caller"), F.col("dst").alias("terminal"), F.lit(False).alias("in_return"))
    return closure.summaries(f, calls).select("name", "sinks", "authorized")


# ---- sessions --------------------------------------------------------------------


@query("""WITH n AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM n),
a AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS attempts FROM s) SELECT event_id, attempts, attempts - 1 AS stalled, attempts > 3 OR attempts - 1 >= 2 AS exhausted FROM a""")
def retry_budget(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return sessions.retry_budget(e, "user_id", ["ts", "event_id"], "event_type").select("event_id", "attempts", "stalled", "exhausted")


def _anchor_sql(keys: str, ms: int, gap: str) -> str:
    names = [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"e.{k} = r.{k}" for k in names)
    return f"""WITH RECURSIVE e AS (SELECT {keys}, {{'a': epoch_ms(ts), 'b': event_id}} AS x FROM events),
r AS (SELECT {keys}, min(x) AS x FROM e GROUP BY {keys} UNION ALL
  SELECT {", ".join(f"r.{k}" for k in names)}, min(e.x) AS x FROM r JOIN e ON {same} AND e.x.a - r.x.a {gap} {ms} GROUP BY {", ".join(f"r.{k}" for k in names)})
SELECT e.x.b AS event_id, r.x IS NOT NULL AS recorded FROM e LEFT JOIN r ON {same} AND r.x.b = e.x.b"""


@query(_anchor_sql("user_id", 6 * 3600 * 1000, ">="))
def replay_anchor(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", _millis("ts").alias("at"), F.col("event_id").alias("tie"))
    return sessions.anchored(e, ["user_id"], "at", "tie", 6 * 3600 * 1000).select(F.col("tie").alias("event_id"), "recorded")


@query(_anchor_sql("user_id, event_type", 24 * 3600 * 1000, ">"))
def ttl_cache(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", _millis("ts").alias("at"), F.col("event_id").alias("tie"))
    return sessions.anchored(e, ["user_id", "event_type"], "at", "tie", 24 * 3600 * 1000 + 1).select(F.col("tie").alias("event_id"), "recorded")


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_user FROM conversations""")
def sticky_source(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))
    return sessions.sticky(c, "conv_id", ["turn"], F.when(F.col("role") == "user", F.col("n")), "last_user").select("conv_id", "turn", "last_user")


_SCOPES = [("en", "en"), ("fr", "fr/1"), ("fr", "fr/2"), ("de", ".")]


@query(rf"""WITH {_PATH}, p AS (SELECT *, substr(path, 1, 2) AS lang FROM paths), s(lang, scope) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _SCOPES)})
SELECT page_id, path FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.lang = p.lang AND (scope = '.' OR path = scope OR starts_with(path, scope || '/')))""")
def scope_drift(spark, sf_dir):
    p = paths(table(spark, sf_dir, "pages")).withColumn("lang", F.substring("path", 1, 2))
    declared = F.broadcast(spark.createDataFrame(_SCOPES, "lang string, scope string"))
    return sessions.scope_drift(p, declared, "lang", "path").select("page_id", "path")


# ---- streams ---------------------------------------------------------------------


def _drained(stream: DataFrame, name: str) -> DataFrame:
    """All that a stream has now, through a file sink in the shared folder."""
    spark = stream.sparkSession
    base = f"{closure.shared_folder(spark)}/vetra-{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")


@query(_anchor_sql("user_id, event_type", 24 * 3600 * 1000, ">"))
def stream_ttl_cache(spark, sf_dir):
    e = _event_stream(spark, sf_dir).select("user_id", "event_type", _millis("ts").alias("at"), F.col("event_id").alias("tie"))
    return _drained(streams.ttl_reuse(e, ["user_id", "event_type"], 24 * 3600 * 1000), "ttl").select(F.col("tie").alias("event_id"), "recorded")


@query("""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id AS seq, epoch_ms(ts) AS ms, event_type AS f, value > 10 AS blocked, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS rn FROM events),
r(session, rn, seq, last, att, stl, key, since, d, da, ds, decision, replayed, attempts, stalled) AS (
  SELECT DISTINCT session, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), 0, 0, CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), 0, 0, CAST(NULL AS VARCHAR), false, 0, 0 FROM e
  UNION ALL
  SELECT session, rn, seq, CASE WHEN rp THEN last ELSE f END, CASE WHEN rp THEN att WHEN blocked THEN a1 ELSE 0 END, CASE WHEN rp THEN stl WHEN blocked THEN s1 ELSE 0 END,
    CASE WHEN rp OR NOT blocked THEN key ELSE f END, CASE WHEN rp OR NOT blocked THEN since ELSE ms END, CASE WHEN rp OR NOT blocked THEN d ELSE n END, CASE WHEN rp OR NOT blocked THEN da ELSE a1 END, CASE WHEN rp OR NOT blocked THEN ds ELSE s1 END,
    CASE WHEN rp THEN d WHEN blocked THEN n ELSE 'pass' END, rp, CASE WHEN rp THEN da WHEN blocked THEN a1 ELSE 0 END, CASE WHEN rp THEN ds WHEN blocked THEN s1 ELSE 0 END
  FROM (SELECT *, CASE WHEN a1 > 3 OR s1 >= 2 THEN 'stop' ELSE 'block' END AS n FROM (
    SELECT e.session, e.rn, e.seq, e.f, e.ms, e.blocked, r.last, r.att, r.stl, r.key, r.since, r.d, r.da, r.ds, r.key IS NOT NULL AND r.key = e.f AND e.ms >= r.since AND e.ms - r.since < 3600000 AS rp,
      CASE WHEN r.last = e.f THEN r.att + 1 ELSE 1 END AS a1, CASE WHEN r.last = e.f THEN r.stl + 1 ELSE 0 END AS s1 FROM r JOIN e ON e.session = r.session AND e.rn = r.rn + 1) x) y)
SELECT session, seq, decision, replayed, attempts, stalled FROM r WHERE rn > 0""")
def stream_stop_decisions(spark, sf_dir):
    e = _event_stream(spark, sf_dir)
    stops = e.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), _millis("ts").alias("at_ms"), F.col("event_type").alias("fingerprint"), (F.col("value") > 10).alias("blocked"))
    return _drained(streams.stop_decisions(stops, window=3600 * 1000), "stops")


