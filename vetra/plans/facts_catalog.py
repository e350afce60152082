"""Queries of the smaller operators: predicates over texts, change lists, checks, baselines on storage, reports, symbols."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import measure, policy, rules
from ..operators.closure import shared_folder
from ..sources import files, syntax
from . import report, store
from .catalog import _FOUND, event_findings, query, table
from .code_catalog import _NESTED, code


def _of(key: Column, *values: str | Column) -> Column:
    """One of the values, by the key modulo their number."""
    return F.element_at(F.array(*(F.lit(v) if isinstance(v, str) else v for v in values)), (key % len(values) + 1).cast("int"))


# ---- text --------------------------------------------------------------------------


@query(r"""WITH x AS (SELECT p_partkey AS k, ['from requests import a', 'requests2.get', 'my-requests x', '"requests"'][p_partkey % 4 + 1] AS imported, p_name || ' "' || p_type || '" ' || ['''q''', '`z', 'n', '"open'][p_partkey % 4 + 1] AS quoted,
  ['Eval (x)', 'evaluate(x)', 'a.eval(x)', 'my_eval(x)'][p_partkey % 4 + 1] AS called, ['db.query', 'dbx.query', 'a::db->q', '$db:q'][p_partkey % 4 + 1] AS name, ['requireAuth(x)', 'author', 'user_role_permission', 'none'][p_partkey % 4 + 1] AS route FROM part)
SELECT k AS p_partkey, regexp_matches(imported, '(^|[^A-Za-z0-9_-])requests($|[^A-Za-z0-9_-])') AS package, regexp_replace(quoted, '"[^"]*("|$)|''[^'']*(''|$)|`[^`]*(`|$)', ' ', 'g') AS bare, regexp_matches(regexp_replace(lower(called), '\s', '', 'g'), '(^|[^a-z0-9_])eval\(') AS call,
  list_contains(regexp_split_to_array(name, '[.:$>-]'), 'db') AS receiver, len(list_filter(regexp_split_to_array(lower(route), '[^a-z0-9_]+'), lambda w: regexp_matches(w, '^auth$|auth$|^authoriz|permission|policy|role|guard|middleware'))) > 0 AS access FROM x""")
def text_predicates(spark, sf_dir):
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    quoted = F.concat("p_name", F.lit(' "'), "p_type", F.lit('" '), _of(key, "'q'", "`z", "n", '"open'))
    return p.select(
        "p_partkey", T.contains_name(_of(key, "from requests import a", "requests2.get", "my-requests x", '"requests"'), "requests").alias("package"), T.without_strings(quoted).alias("bare"),
        T.contains_call(_of(key, "Eval (x)", "evaluate(x)", "a.eval(x)", "my_eval(x)"), "eval").alias("call"), T.has_receiver(_of(key, "db.query", "dbx.query", "a::db->q", "$db:q"), ["db"]).alias("receiver"),
        rules.access_control(_of(key, "requireAuth(x)", "author", "user_role_permission", "none")).alias("access"),
    )


@query(r"""WITH x AS (SELECT o_orderkey AS k, ['FOO=1 env cargo test', 'npm run ' || o_orderkey, '  test A=b make all ', 'env'][o_orderkey % 4 + 1] AS command, ['My_Profile', 'bad profile!', ' a-b ', ''][o_orderkey % 4 + 1] AS profile,
  ['ok-' || o_orderkey, 'a b', 'x/y', 'A.b_c'][o_orderkey % 4 + 1] AS session, ['DB: t' || o_orderkey || '/ ', 'url:', 'none', 'Url:http://h//'][o_orderkey % 4 + 1] AS res, ['cargo audit', 'a.b-c', 'x_y z', 'lint'][o_orderkey % 4 + 1] AS name FROM orders)
SELECT k AS o_orderkey, list_filter(regexp_split_to_array(trim(command), '\s+'), lambda t: NOT contains(t, '=') AND t NOT IN ('env', 'test', ''))[1] AS token, CASE WHEN regexp_matches(replace(lower(trim(profile)), '_', '-'), '^[a-z0-9-]{1,64}$') THEN replace(lower(trim(profile)), '_', '-') END AS profile,
  regexp_full_match(session, '[A-Za-z0-9._-]{1,128}') AS valid, CASE WHEN regexp_matches(res, ':\s*[^\s/]') THEN lower(split_part(res, ':', 1)) || ':' || rtrim(trim(substr(res, strpos(res, ':') + 1)), '/') END AS resource, regexp_replace(name, '[^A-Za-z0-9-]', '_', 'g') AS slug FROM x""")
def command_facts(spark, sf_dir):
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    text = key.cast("string")
    return o.select(
        "o_orderkey", T.first_command_token(_of(key, "FOO=1 env cargo test", F.concat(F.lit("npm run "), text), "  test A=b make all ", "env")).alias("token"), T.task_profile(_of(key, "My_Profile", "bad profile!", " a-b ", "")).alias("profile"),
        T.valid_session_id(_of(key, F.concat(F.lit("ok-"), text), "a b", "x/y", "A.b_c")).alias("valid"), T.normalized_resource(_of(key, F.concat(F.lit("DB: t"), text, F.lit("/ ")), "url:", "none", "Url:http://h//")).alias("resource"),
        T.command_slug(_of(key, "cargo audit", "a.b-c", "x_y z", "lint")).alias("slug"),
    )


@query(r"""SELECT o_orderkey, array_to_string(list_sort(list_distinct(['src/' || o_custkey || '.py', 'b.txt'])), ',') AS paths FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, '' FROM orders WHERE o_orderkey % 2 <> 0""")
def patch_files(spark, sf_dir):
    patch = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("*** Begin\n*** Update File: src/"), F.col("o_custkey").cast("string"), F.lit(".py\n@@\n*** Add File: b.txt\n*** Delete File: b.txt\n"))).otherwise("ls *** Add File: x")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(T.patch_paths(patch), ",").alias("paths"))


# ---- changes ------------------------------------------------------------------------


@query("""WITH c AS (SELECT CAST(c_custkey AS VARCHAR) || '.py' AS path, c_custkey AS k FROM customer)
SELECT path, CAST(CASE WHEN k % 5 = 0 THEN 1 ELSE k % 9 + 1 END AS BIGINT) AS start_line, CAST(CASE WHEN k % 5 = 0 THEN 9223372036854775807 ELSE k % 9 + 2 END AS BIGINT) AS end_line FROM c WHERE k % 7 <> 0 AND k % 5 IN (0, 1, 2)""")
def status_scope(spark, sf_dir):
    """Untracked files are whole, changed ones by their hunks, gone ones not at all."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    path = F.concat(key.cast("string"), F.lit(".py"))
    record = F.when(key % 5 == 0, F.concat(F.lit("?? "), path)).when(key % 5 == 1, F.concat(F.lit("R  "), path, F.lit("\x00old "), path)).when(key % 5 == 2, F.concat(F.lit(" M "), path))
    status = files.status_paths(c.where(record.isNotNull()).select(F.concat(record, F.lit("\x00")).alias("value")))
    ranges = files.hunks(c.select(path.alias("path"), F.concat(F.lit("@@ -1 +"), (key % 9 + 1).cast("string"), F.lit(",2 @@")).alias("hunk_header")))
    return files.changed_scope(c.limit(0).select(path.alias("path")), status, ranges, c.where(key % 7 != 0).select(path.alias("path")))


@query("SELECT bool_and(CASE n_nationkey % 4 WHEN 2 THEN n_regionkey <> 2 ELSE true END) AS documentation_only FROM nation WHERE n_regionkey = 1 OR n_nationkey % 4 <> 2")
def documentation_changes(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where("n_regionkey = 1 OR n_nationkey % 4 <> 2")
    path = F.when((F.col("n_nationkey") % 4 == 2) & (F.col("n_regionkey") == 2), "tests/x.md").otherwise(_of(F.col("n_nationkey"), "docs/a.md", "README.TXT", "b.rst", "img.svg"))
    return measure.documentation_only(n.select(path.alias("path")))


@query("""WITH c AS (SELECT o_orderkey, ['dependency-audit', 'lint', 'sbom-x', 'test', 'license'][o_orderkey % 5 + 1] AS name, ['a/Cargo.lock', 'src/a.py', 'requirements-dev.txt', 'x.csproj'][o_orderkey % 4 + 1] AS path FROM orders)
SELECT o_orderkey, name FROM c WHERE name IN ('lint', 'test') OR path <> 'src/a.py'""")
def applicable_checks(spark, sf_dir):
    key = F.col("o_orderkey")
    c = table(spark, sf_dir, "orders").select("o_orderkey", _of(key, "dependency-audit", "lint", "sbom-x", "test", "license").alias("name"), _of(key, "a/Cargo.lock", "src/a.py", "requirements-dev.txt", "x.csproj").alias("path"))
    return measure.applicable(c, files.is_dependency(F.col("path"))).select("o_orderkey", "name")


# ---- baselines, reports -----------------------------------------------------------------


@query(f"WITH {_FOUND} SELECT rule_id, path, evidence, arg_min(severity, seq) AS severity, count(*) AS count, (SELECT count(*) FROM f) AS total FROM f GROUP BY rule_id, path, evidence")
def stored_baseline(spark, sf_dir):
    path = f"{shared_folder(spark)}/vetra-baseline-{uuid.uuid4().hex}"
    store.write_baseline(event_findings(spark, sf_dir), path)
    known = store.read_baseline(spark, path)
    return known.select("rule_id", "path", "evidence", "severity", "count", F.lit(store.baseline_total(known)).cast("long").alias("total"))


@query(f"WITH {_FOUND} SELECT seq, rule_id, path, line, row_number() OVER (ORDER BY path, line, rule_id, seq) AS place FROM f")
def ordered_findings(spark, sf_dir):
    """The order of a report; places are counted task by task after a sort by ranges, whose tasks are in order."""
    out = report.ordered(event_findings(spark, sf_dir)).select("seq", "rule_id", "path", "line", F.spark_partition_id().alias("task"), (F.monotonically_increasing_id() % (1 << 33)).alias("at"))
    path = f"{shared_folder(spark)}/vetra-ordered-{uuid.uuid4().hex}"
    out.write.parquet(path)
    out = spark.read.parquet(path)
    sizes = out.groupBy("task").agg(F.count("*").alias("n"))  # one row a task
    before = sizes.select("task", F.coalesce(F.sum("n").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return out.join(F.broadcast(before), "task").select("seq", "rule_id", "path", "line", (F.col("at") + F.col("before") + 1).alias("place"))


@query("""WITH e AS (SELECT event_id, event_type AS m, ['claude', 'cursor', 'codex', 'antigravity', 'openclaw'][event_id % 5 + 1] AS host, ['block', 'stop', 'pass'][event_id % 3 + 1] AS d FROM events)
SELECT event_id, CASE host || ' ' || d WHEN 'claude block' THEN '{"decision":"block","reason":"' || m || '"}' WHEN 'codex block' THEN '{"decision":"block","reason":"' || m || '"}' WHEN 'cursor block' THEN '{"followup_message":"' || m || '"}'
  WHEN 'antigravity block' THEN '{"decision":"continue","reason":"' || m || '"}' WHEN 'openclaw block' THEN '{"action":"revise","reason":"' || m || '"}' WHEN 'cursor stop' THEN '{}' WHEN 'antigravity stop' THEN '{"decision":"stop","reason":"' || m || '"}'
  WHEN 'openclaw stop' THEN '{"action":"finalize","reason":"' || m || '"}' WHEN 'claude stop' THEN '{"continue":false,"stopReason":"' || m || '","systemMessage":"' || m || '"}' WHEN 'codex stop' THEN '{"continue":false,"stopReason":"' || m || '","systemMessage":"' || m || '"}'
  WHEN 'cursor pass' THEN '{}' WHEN 'antigravity pass' THEN '{"decision":"stop"}' ELSE '' END AS answer FROM e""")
def host_answers(spark, sf_dir):
    key = F.col("event_id")
    host = _of(key, "claude", "cursor", "codex", "antigravity", "openclaw")
    return table(spark, sf_dir, "events").select("event_id", report.host_decision(host, _of(key, "block", "stop", "pass"), F.col("event_type")).alias("answer"))


@query("""SELECT sha256(count(*) || ':' || sum(CAST(('0x' || substr(h, 1, 15)) AS BIGINT)) || ':' || sum(CAST(('0x' || substr(h, 16, 15)) AS BIGINT))) AS fingerprint
FROM (SELECT sha256(o_orderkey || chr(0) || o_orderstatus || chr(0) || o_custkey) AS h FROM orders WHERE o_orderstatus <> 'F') x""")
def workspace_state(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus"))
    return measure.workspace_fingerprint(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("repository"), status.alias("status"), F.col("o_custkey").cast("string").alias("fingerprint")))


@query(f"""WITH {_FOUND} SELECT CASE WHEN seq % 3 = 0 THEN path ELSE 'r' || (seq % 3) || '/' || path END AS path, rule_id, line FROM f""")
def prefixed_findings(spark, sf_dir):
    found = event_findings(spark, sf_dir).withColumn("repository", _of(F.col("seq"), ".", "r1", "r2"))
    return policy.prefixed(found, "repository", "path").select("path", "rule_id", "line")


# ---- code ------------------------------------------------------------------------------

_NAMES = r"""list_filter(regexp_split_to_array(regexp_replace(regexp_replace(t, '"[^"]*"', ' ', 'g'), '''[^'']*''', ' ', 'g'), '[^A-Za-z0-9_]+'), lambda w: regexp_matches(w, '^[A-Za-z_]') AND w NOT IN ('as', 'const', 'from', 'import', 'let', 'mut', 'require', 'use', 'var'))"""


@query(f"WITH {_NESTED} SELECT DISTINCT path, unnest({_NAMES}) AS symbol FROM ln WHERE ext IN ('ts', 'js', 'py', 'go') AND regexp_matches(t, '^(import |from |use )')")
def imported_symbols(spark, sf_dir):
    return rules.symbols(code(spark, sf_dir)).where("class = 'local'").select("path", "symbol")


@query(r"""SELECT p_partkey || '.' || ['py', 'rs', 'js', 'py'][p_partkey % 4 + 1] AS path, CAST(p_size % 5 + 2 AS BIGINT) AS line, ['not implemented', 'todo!', 'not implemented', ''][p_partkey % 4 + 1] AS placeholder FROM part WHERE p_partkey % 4 < 3""")
def placeholder_lines(spark, sf_dir):
    key = F.col("p_partkey")
    body = _of(key, "def later():\n    raise NotImplementedError('x')\n", 'fn later() {\n  todo!("x")\n}\n', "function later() {\n  throw new NotImplementedError('x');\n}\n", "def done():\n    return 'todo'\n")
    pad = F.repeat(_of(key, "# n\n", "// n\n", "// n\n", "# n\n"), (F.col("p_size") % 5).cast("int"))
    f = table(spark, sf_dir, "part").select(F.concat(key.cast("string"), F.lit("."), _of(key, "py", "rs", "js", "py")).alias("path"), F.concat(pad, body).alias("content"))
    return rules.placeholders(syntax.nodes(f)).groupBy("path", "line").agg(F.max("placeholder").alias("placeholder"))
