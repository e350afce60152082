"""Queries over source code: a file for each row of ``part``, made of templates, and SQL that finds by lines what the rules find by syntax."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payload
from ..operators import clones, detect, policy, rules
from ..operators.closure import cut
from ..sources import files as sources
from ..sources import syntax
from ..sources.files import Config
from . import gate
from .catalog import query, table

#: Extension, first characters and last characters of a comment, text.  ``{k}`` is the part's key, ``{ifs}`` and ``{items}`` grow with its size.
TEMPLATES = [
    ("ts", "//", "", "import { db } from './db';\nfunction go_{k}(xs) {\n  for (const x of xs) {\n    const y = xs.find(z => z.id === x);\n    db.query('q');\n    for (const w of y) { use(w); }\n  }\n}\n"),
    ("py", "#", "", "import requests\ndef pull_{k}(u):\n    return requests.get(u)\ndef each_{k}(us):\n    for u in us:\n        pull_{k}(u)\n"),
    ("py", "#", "", "import sqlalchemy\nengine = sqlalchemy.make()\ndef many_{k}(xs):\n    for x in xs:\n        engine.execute(x)\n        xs.index(x)\n        sorted(xs)\n"),
    ("py", "#", "", "def branchy_{k}(x):\n{ifs}    return x\n"),
    ("py", "#", "", "try:\n    go()\nexcept ValueError:\n    pass\nrows = [{items}0]\n"),
    ("py", "#", "", "def (:\n"),
    ("js", "//", "", "function show(req) {\n  const v = req.query.name;\n  el.innerHTML = v;\n  const s = escapeHtml(req.query.name);\n  other.innerHTML = s;\n  eval(v);\n}\napp.post('/x', save);\napp.put('/y', requireAuth, save);\n"),
    ("py", "#", "", "import hashlib, pickle, yaml\nhashlib.md5(b'x')\npickle.loads(data)\nyaml.load(s, Loader=yaml.SafeLoader)\nKEY = 'AKIA{k16}'\n"),
    ("ts", "//", "", "async function f_{k}(xs) {\n  await Promise.all(xs.map(x => fetch(x)));\n  await Promise.all(known);\n}\n"),
    ("sql", "--", "", "select 1;\nselect * from t_{k};\nselect a, b from t;\n"),
    ("yaml", "#", "", "# AKIA{k16}\nkey: AKIA{k16}\nother: none\n"),
    ("vue", "<!--", "-->", "<template>\n<p>for x</p>\n</template>\n<script>\nfor (const a of b) {\n  for (const c of a) { use(c); }\n}\n</script>\n"),
    ("py", "#", "", "def safe_{k}(xs):\n    for x in range(3):\n        for y in range(4):\n            use(x)\n"),
    ("rb", "#", "", "def go_{k}(xs)\n  xs.each do |x|\n    ys.each { |y| use(y) }\n  end\nend\n"),
    ("js", "//", "", "function allowed_{k}(xs) {\n  for (const x of xs) {\n    // vetra: allow FG-ALG-001 -- few of them\n    for (const y of x) { use(y); }\n  }\n  return xs;\n}\n"),
    ("js", "//", "", "function read_{k}(req) {\n  const p = req.query.file;\n  fs.readFile(p);\n  eval(other);\n}\n"),
    ("go", "//", "", "package m\nimport \"net/http\"\nfunc Get{k}(us []string) {\n\tfor _, u := range us {\n\t\thttp.Get(u)\n\t}\n}\n"),
    ("ts", "//", "", "async function calls_{k}(us) {\n  for (const u of us) {\n    await client.get(u);\n  }\n}\n"),
    ("ts", "//", "", "function loadOrder_{k}(x) {\n  open(x);\n  read(x);\n  check(x);\n  close(x);\n  return x;\n}\n"),
    ("ts", "//", "", "function orderSave_{k}(x) {\n  if (x) { close(x); }\n  check(x);\n  read(x);\n  open(x);\n  return 1;\n}\n"),
    ("js", "//", "", "function source_{k}(req) {\n  return req.query.name;\n}\nfunction runs_{k}() {\n  const v = source_{k}();\n  eval(v);\n}\n"),
    ("py", "#", "", "def later_{k}():\n    raise NotImplementedError('x')\n"),
    ("lua", "--", "", "for i = 1, 2 do\n  for j = 1, 2 do\n    f(j)\n  end\nend\n"),
]
_IF, _ITEM = "    if x == 1:\n        pass\n", "1, "


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files (path, content), one for each part."""
    n = len(TEMPLATES)
    key, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda i: F.element_at(F.array(*(F.lit(t[i]) for t in TEMPLATES)), (key % n + 1).cast("int"))
    text = pick(3)
    for name, value in (("{k16}", F.lpad(key.cast("string"), 16, "0")), ("{k}", key.cast("string")), ("{ifs}", F.repeat(F.lit(_IF), (size % 20).cast("int"))), ("{items}", F.repeat(F.lit(_ITEM), (size * 2).cast("int")))):
        text = F.replace(text, F.lit(name), value)
    pad = F.repeat(F.concat(pick(1), F.lit(" note"), pick(2), F.lit("\n")), (size % 5).cast("int"))
    return table(spark, sf_dir, "part").select(F.concat(key.cast("string"), F.lit("."), pick(0)).alias("path"), F.concat(pad, text).alias("content"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _pick(i: int) -> str:
    return f"[{', '.join(_quoted(t[i]) for t in TEMPLATES)}][p_partkey % {len(TEMPLATES)} + 1]"


_CODE = f"""code AS (SELECT p_partkey AS k, p_partkey || '.' || {_pick(0)} AS path, {_pick(0)} AS ext, repeat({_pick(1)} || ' note' || {_pick(2)} || chr(10), CAST(p_size % 5 AS BIGINT)) ||
  replace(replace(replace(replace({_pick(3)}, '{{k16}}', lpad(CAST(p_partkey AS VARCHAR), 16, '0')), '{{k}}', CAST(p_partkey AS VARCHAR)), '{{ifs}}', repeat({_quoted(_IF)}, CAST(p_size % 20 AS BIGINT))), '{{items}}', repeat('{_ITEM}', CAST(p_size * 2 AS BIGINT))) AS content FROM part)"""

# Lines with their indentation; the loops around a line are those above it, further left, with nothing as far left between.
_NESTED = f"""{_CODE},
ln AS (SELECT path, ext, content, n, t, length(t) - length(ltrim(t, ' ' || chr(9))) AS ind, ext NOT IN ('sql', 'yaml') AND length(content) - length(replace(content, '(', '')) <> length(content) - length(replace(content, ')', '')) AS broken
  FROM (SELECT path, ext, content, unnest(string_split(content, chr(10))) AS t, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS n FROM code) x WHERE trim(t) <> ''),
lp AS (SELECT path, n, ind FROM ln WHERE regexp_matches(t, '^\\s*for\\b|\\.each\\b') AND NOT broken AND (ext <> 'vue' OR n > 3)),
dp AS (SELECT ln.*, (SELECT count(*) FROM lp WHERE lp.path = ln.path AND lp.n < ln.n AND lp.ind < ln.ind AND NOT EXISTS (SELECT 1 FROM ln m WHERE m.path = ln.path AND m.n > lp.n AND m.n < ln.n AND m.ind <= lp.ind)) AS depth FROM ln)""".replace("\\\\", "\\")

_FOUND = _NESTED + r""",
vr AS (SELECT path, regexp_extract(t, '(?:const|let) (\w+) = ', 1) AS v, bool_and((contains(t, 'req.query') OR contains(t, ' = source_')) AND NOT contains(t, 'escapeHtml')) AS dirty FROM ln WHERE regexp_matches(t, '(?:const|let) \w+ = ') GROUP BY ALL),
us AS (SELECT dp.path, dp.n, dp.t, coalesce(vr.dirty, false) AS dirty FROM dp LEFT JOIN vr ON vr.path = dp.path AND vr.v = regexp_extract(dp.t, '(?:innerHTML = |eval\(|readFile\()(\w+)', 1)),
wr AS (SELECT path, regexp_extract(content, 'def (\w+)\([^)]*\):\n\s+return requests\.get', 1) AS w FROM code WHERE contains(content, 'import requests')),
found AS (
  SELECT 'FG-ALG-001' AS rule_id, path, n AS line FROM dp WHERE depth > 0 AND regexp_matches(t, '^\s*for\b|\.each\b') AND NOT regexp_matches(t, 'range\(\d+\)')
  UNION ALL SELECT 'FG-ALG-002', path, n FROM dp WHERE depth > 0 AND ((ext IN ('js', 'ts') AND regexp_matches(t, '\.(find|includes|indexOf)\(')) OR (ext = 'py' AND contains(t, '.index(')))
  UNION ALL SELECT 'FG-ALG-003', path, n FROM dp WHERE depth > 0 AND contains(t, 'sorted(')
  UNION ALL SELECT 'FG-DB-001', path, n FROM dp WHERE depth > 0 AND contains(t, 'engine.execute(') AND contains(content, 'import sqlalchemy')
  UNION ALL SELECT 'FG-DB-002', path, n FROM dp WHERE depth > 0 AND contains(t, 'db.query(')
  UNION ALL SELECT 'FG-DB-005', path, n FROM ln WHERE ext = 'sql' AND regexp_matches(t, '(?i)\bselect\s+\*\s+from\b')
  UNION ALL SELECT 'FG-NET-001', dp.path, n FROM dp LEFT JOIN wr ON wr.path = dp.path WHERE (depth > 0 AND (contains(t, coalesce(w, '?') || '(') OR contains(t, 'http.Get('))) OR regexp_matches(t, '\.map\(.*\bfetch\(')
  UNION ALL SELECT 'FG-NET-002', path, n FROM dp WHERE depth > 0 AND contains(t, 'client.get(')
  UNION ALL SELECT 'FG-CON-001', path, n FROM ln WHERE regexp_matches(t, 'Promise\.all\(\w+\.map\(')
  UNION ALL SELECT 'FG-CPLX-001', path, n FROM ln WHERE starts_with(t, 'def branchy') AND len(regexp_extract_all(content, '\n +if ')) + 1 > 15
  UNION ALL SELECT 'FG-ERR-001', a.path, a.n FROM ln a JOIN ln b ON b.path = a.path AND b.n = a.n + 1 WHERE starts_with(a.t, 'except') AND trim(b.t) = 'pass'
  UNION ALL SELECT 'FG-ARCH-001', path, n FROM ln WHERE starts_with(t, 'rows = [') AND length(t) - length(replace(t, ',', '')) + 1 >= 50
  UNION ALL SELECT DISTINCT 'FG-PARSE-001', path, 1 FROM ln WHERE broken
  UNION ALL SELECT 'FG-SEC-001', path, n FROM ln WHERE regexp_matches(t, 'AKIA[0-9A-Z]{16}') AND NOT starts_with(t, '#')
  UNION ALL SELECT 'FG-SEC-002', path, n FROM us WHERE contains(t, 'eval(') AND NOT dirty
  UNION ALL SELECT 'FG-SEC-003', path, n FROM us WHERE contains(t, 'eval(') AND dirty
  UNION ALL SELECT 'FG-SEC-004', path, n FROM ln WHERE contains(t, 'hashlib.md5(')
  UNION ALL SELECT 'FG-SEC-005', path, n FROM ln WHERE contains(t, 'pickle.loads(')
  UNION ALL SELECT 'FG-SEC-006', path, n FROM us WHERE contains(t, 'innerHTML = ') AND dirty
  UNION ALL SELECT 'FG-SEC-007', path, n FROM us WHERE contains(t, 'fs.readFile(') AND dirty
  UNION ALL SELECT 'FG-AUTH-001', path, n FROM ln WHERE regexp_matches(t, 'app\.(post|put)\(') AND NOT regexp_matches(t, '(?i)auth')
)"""


@query(f"WITH {_FOUND} SELECT rule_id, path, CAST(line AS BIGINT) AS line FROM found")
def rule_findings(spark, sf_dir):
    return rules.findings(code(spark, sf_dir)).select("rule_id", "path", "line")


# Functions by patterns: braces end at the start of a line, a Python function here with its file.
_FUNCTIONS = _NESTED + r""",
fx AS (SELECT path, CASE WHEN ext IN ('js', 'ts') THEN 'javascript' ELSE 'python' END AS family, CASE WHEN ext IN ('js', 'ts') THEN regexp_extract(content, '(?s)((?:function) \w+\(.*?\n\})', 1) ELSE rtrim(regexp_extract(content, '(?s)(def branchy\w+\(.*)', 1), chr(10)) END AS body, content FROM code WHERE ext IN ('js', 'ts', 'py')),
fn AS (SELECT path, family, body, length(content[:strpos(content, body)]) - length(replace(content[:strpos(content, body)], chr(10), '')) + 1 AS line, regexp_replace(body, '_\d+', '', 'g') AS canonical, len(string_split(body, chr(10))) AS lines FROM fx WHERE body <> ''),
g2 AS (SELECT *, first_value({'path': path, 'line': line, 'body': body}) OVER (PARTITION BY family, canonical ORDER BY path, line) AS f FROM fn WHERE lines >= 6),
dry2 AS (SELECT path, CAST(line AS BIGINT) AS line, f.path AS other, CAST(f.line AS BIGINT) AS other_line FROM g2 WHERE path <> f.path AND body <> f.body),
w3 AS (SELECT *, unnest(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_extract(body, 'function (\w+)', 1), '([a-z])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda w: length(w) >= 4)) AS word,
  array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_replace(body, 'function \w+\(', ''), '(?:^|[^a-zA-Z.]|\.)(open|read|check|close|find|query|use|escapehtml|eval)\(', 1))), ',') AS calls FROM fn WHERE lines >= 6 AND family = 'javascript'),
g3 AS (SELECT *, first_value({'path': path, 'line': line, 'c': canonical}) OVER (PARTITION BY word, calls ORDER BY path, line) AS f FROM w3 WHERE len(string_split(calls, ',')) >= 3),
dry3 AS (SELECT path, CAST(line AS BIGINT) AS line, f.path AS other, CAST(f.line AS BIGINT) AS other_line FROM g3 WHERE path <> f.path AND canonical <> f.c)"""


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # read three times, so written once instead of parsing all files again
    return clones.functions(cut(syntax.nodes(code(spark, sf_dir)).where("kind IN ('function', 'call')"), "nodes"))


@query(f"WITH {_FUNCTIONS} SELECT * FROM dry2")
def renamed_functions(spark, sf_dir):
    return clones.renamed_clones(_functions(spark, sf_dir))


@query(f"WITH {_FUNCTIONS} SELECT * FROM dry3")
def same_calls(spark, sf_dir):
    return clones.same_operations(_functions(spark, sf_dir))


# ---- the gate ---------------------------------------------------------------------

_SETTINGS = """version = 2
[gate]
mode = "strict"
coverage_minimum = 50
coverage_report = "lcov.info"
[rules.FG-DB-002]
enabled = false
[rules.FG-ERR-001]
severity = "error"
[rules.FG-SEC-005]
block = false
"""
# Changed lines: the first lines of six files in seven; known findings: those of one file in ten; hits: of every file's second line.
_GATE = _FUNCTIONS + _FOUND.removeprefix(_NESTED) + r""",
sev(rule_id, severity) AS (VALUES ('FG-ALG-001', 'warning'), ('FG-ALG-002', 'warning'), ('FG-ALG-003', 'warning'), ('FG-DB-001', 'error'), ('FG-DB-005', 'warning'), ('FG-NET-001', 'warning'), ('FG-NET-002', 'info'), ('FG-CON-001', 'warning'),
  ('FG-CPLX-001', 'warning'), ('FG-SEC-001', 'error'), ('FG-SEC-002', 'info'), ('FG-SEC-003', 'info'), ('FG-SEC-004', 'warning'), ('FG-SEC-005', 'warning'), ('FG-SEC-006', 'warning'), ('FG-SEC-007', 'info'), ('FG-AUTH-001', 'info'),
  ('FG-ERR-001', 'error'), ('FG-DRY-002', 'info'), ('FG-DRY-003', 'info'), ('FG-ARCH-001', 'warning'), ('FG-PARSE-001', 'info'), ('FG-COV-001', 'warning')),
mk AS (SELECT path, n, regexp_extract(t, 'vetra: allow (FG-\S+) --', 1) AS rule_id FROM ln WHERE contains(t, 'vetra: allow ')),
un AS (SELECT rule_id, path, line FROM found f WHERE NOT EXISTS (SELECT 1 FROM mk WHERE mk.path = f.path AND mk.rule_id = f.rule_id AND f.line IN (mk.n, mk.n + 1))
  UNION ALL SELECT 'FG-DRY-002', path, line FROM dry2 UNION ALL SELECT 'FG-DRY-003', path, line FROM dry3),
sc AS (SELECT p_partkey, p_size % 5 + 5 AS last FROM part WHERE p_partkey % 7 <> 0),
ins AS (SELECT DISTINCT rule_id, path, line FROM un JOIN sc ON p_partkey = CAST(string_split(path, '.')[1] AS BIGINT) WHERE line <= last OR (rule_id = 'FG-CPLX-001' AND line <= last)
  UNION ALL SELECT 'FG-COV-001', 'lcov.info', 1 FROM (SELECT count(*) AS n, count(*) FILTER (p_partkey % 3 = 0) AS c FROM sc) x WHERE n > 0 AND c * 100 // n < 50),
ga AS (SELECT rule_id, path, CAST(line AS BIGINT) AS line, severity, rule_id <> 'FG-SEC-005' AND severity <> 'info' AS blocking FROM ins JOIN sev USING (rule_id) WHERE NOT (path <> 'lcov.info' AND coalesce(try_cast(string_split(path, '.')[1] AS BIGINT), 1) % 10 = 3))"""


def _gate(spark: SparkSession, sf_dir: str) -> gate.Gate:
    files, part = code(spark, sf_dir), table(spark, sf_dir, "part")
    config = Config.from_toml(_SETTINGS)
    key = F.split_part("path", F.lit("."), F.lit(1)).cast("long")
    scope = files.select("path", key.alias("p_partkey")).join(part.select("p_partkey", "p_size"), "p_partkey").where("p_partkey % 7 <> 0").select("path", F.lit(1).cast("long").alias("start_line"), (F.col("p_size") % 5 + 5).cast("long").alias("end_line"))
    found = cut(gate.scan(files, config), "scanned")
    known = policy.baseline_of(found.where(key % 10 == 3))
    hits = files.select("path", F.lit(2).cast("long").alias("line"), F.when(key % 3 == 0, 1).otherwise(0).cast("long").alias("hits"))
    checks = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), (F.col("n_regionkey") == 1).alias("required"), (F.col("n_nationkey") % 2 == 0).alias("success"))
    return gate.run(files, config, scope=scope, baseline=known, coverage=hits, checks=checks, scanned=found)


@query(f"WITH {_GATE} SELECT * FROM ga")
def gate_run(spark, sf_dir):
    return _gate(spark, sf_dir).findings.select("rule_id", "path", "line", "severity", "blocking")


@query(f"""WITH {_GATE}, ch AS (SELECT count(*) FILTER (n_nationkey % 2 = 0) AS ok, count(*) FILTER (n_nationkey % 2 <> 0) AS bad, count(*) FILTER (n_nationkey % 2 <> 0 AND n_regionkey = 1) AS rf FROM nation),
s AS (SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS info, count(*) FILTER (blocking) AS blocking, count(*) AS n_findings FROM ga)
SELECT s.*, ok AS checks_passed, bad AS checks_failed, CASE WHEN rf > 0 OR blocking > 0 THEN 'blocked' WHEN n_findings > 0 OR bad > 0 THEN 'warning' ELSE 'passed' END AS status FROM s, ch""")
def gate_verdict(spark, sf_dir):
    return _gate(spark, sf_dir).summary


# ---- detection and payloads ----------------------------------------------------------

_MANIFEST = """CASE c_custkey % 4 WHEN 0 THEN 'package.json' WHEN 1 THEN 'Cargo.toml' WHEN 2 THEN 'pyproject.toml' ELSE 'src/a.' || ['rb', 'kt', 'sql', 'txt'][c_custkey % 3 + 1] END"""
_DEPS = """['next', 'vitest', 'typeorm', 'left-pad', '@prisma/client']"""


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files (project, path, content): a file for each customer, a project for each nation and segment."""
    key = F.col("c_custkey")
    pick = lambda xs, by: F.element_at(F.array(*(F.lit(x) for x in xs)), (by + 1).cast("int"))
    dep = pick(["next", "vitest", "typeorm", "left-pad", "@prisma/client"], key % 5)
    path = F.when(key % 4 == 0, "package.json").when(key % 4 == 1, "Cargo.toml").when(key % 4 == 2, "pyproject.toml").otherwise(F.concat(F.lit("src/a."), pick(["rb", "kt", "sql", "txt"], key % 3)))
    json = F.concat(F.lit('{"dependencies": {"'), dep, F.lit('": "1"}, "scripts": {"test": "x", "lint": "y"}}'))
    content = F.when(key % 4 == 0, json).when(key % 4 == 2, F.when(key % 3 == 0, "[tool.pytest]\n[tool.ruff]").otherwise("[project]")).otherwise("")
    return table(spark, sf_dir, "customer").select(F.concat_ws("/", "c_mktsegment", key.cast("string")).alias("project"), path.alias("path"), content.alias("content"))


_FILES = f"""fl AS (SELECT c_mktsegment || '/' || c_custkey AS project, c_custkey AS k, {_MANIFEST} AS path, {_DEPS}[c_custkey % 5 + 1] AS dep FROM customer)"""


@query(f"""WITH {_FILES} SELECT project, 'language' AS kind, CASE WHEN path = 'package.json' THEN 'JavaScript/TypeScript' WHEN path = 'Cargo.toml' THEN 'Rust' WHEN path = 'pyproject.toml' THEN 'Python' WHEN path LIKE '%.rb' THEN 'Ruby' WHEN path LIKE '%.kt' THEN 'Java/Kotlin' WHEN path LIKE '%.sql' THEN 'SQL' END AS label
  FROM fl WHERE path NOT LIKE '%.txt'
UNION ALL SELECT project, 'package_manager', CASE path WHEN 'package.json' THEN 'npm' WHEN 'Cargo.toml' THEN 'Cargo' ELSE 'pip' END FROM fl WHERE path IN ('package.json', 'Cargo.toml', 'pyproject.toml')
UNION ALL SELECT project, 'test', 'cargo test' FROM fl WHERE path = 'Cargo.toml' UNION ALL SELECT project, 'test', 'pytest' FROM fl WHERE path = 'pyproject.toml' AND k % 3 = 0
UNION ALL SELECT project, CASE dep WHEN 'next' THEN 'framework' WHEN 'vitest' THEN 'test' ELSE 'database' END, CASE dep WHEN 'next' THEN 'Next.js' WHEN 'vitest' THEN 'Vitest' WHEN 'typeorm' THEN 'TypeORM' ELSE 'Prisma' END FROM fl WHERE path = 'package.json' AND dep <> 'left-pad'""")
def detected_tools(spark, sf_dir):
    return detect.detected(manifests(spark, sf_dir))


@query(f"""WITH {_FILES}, c AS (
  SELECT project, unnest(['format', 'lint', 'test', 'build', 'dependency-audit', 'supply-chain']) AS name, unnest(['cargo fmt --all -- --check', 'cargo clippy --workspace --all-targets --all-features -- -D warnings', 'cargo test --workspace', 'cargo build --workspace', 'cargo audit --deny warnings', 'cargo deny check']) AS command, unnest([true, true, true, true, false, false]) AS enabled FROM fl WHERE path = 'Cargo.toml'
  UNION ALL SELECT project, unnest(['lint', 'test', 'dependency-audit', 'sbom']), unnest(['npm run lint', 'npm run test', 'npm audit', 'npm sbom --sbom-format cyclonedx']), unnest([true, true, false, false]) FROM fl WHERE path = 'package.json'
  UNION ALL SELECT project, unnest(['dependency-audit', 'license', 'sbom']), unnest(['pip-audit', 'pip-licenses --format=json', 'cyclonedx-py environment --output-format JSON']), unnest([false, false, false]) FROM fl WHERE path = 'pyproject.toml'
  UNION ALL SELECT project, unnest(['test', 'lint', 'format']), unnest(['pytest', 'ruff check .', 'ruff format --check .']), unnest([true, true, true]) FROM fl WHERE path = 'pyproject.toml' AND k % 3 = 0),
o AS (SELECT project, 'test' AS name, 'own' AS command FROM fl WHERE k % 2 = 0)
SELECT project, name, command, true AS added FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.project = c.project AND o.name = c.name) UNION ALL SELECT project, name, command, false FROM o""")
def suggested_commands(spark, sf_dir):
    files = manifests(spark, sf_dir)
    own = files.where(F.split_part("project", F.lit("/"), F.lit(2)).cast("long") % 2 == 0).select("project", F.lit(0).alias("seq"), F.lit("test").alias("name"), F.lit("own").alias("command"), F.lit(True).alias("enabled"))
    return detect.reconciled(own, detect.commands(files)).select("project", "name", "command", "added")


@query(r"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'user-' || user_id ELSE 'default' END AS session,
  CASE event_id % 4 WHEN 0 THEN 'src/' || user_id || '.py' WHEN 1 THEN 'outside:/etc/' || user_id WHEN 2 THEN 'a' || user_id || '.txt,b.txt' ELSE '' END AS paths,
  CASE WHEN event_id % 2 = 0 THEN 'table:t' || user_id || ',tool:' || event_type ELSE 'mcp:' || event_type || '/a/b_c,url:http://x/' || user_id END AS resources FROM events""")
def tool_payloads(spark, sf_dir):
    e, key, user = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id").cast("string")
    paths = (
        F.when(key % 4 == 0, F.concat(F.lit('"file_path": "./src/x/../'), user, F.lit('.py"'))).when(key % 4 == 1, F.concat(F.lit('"nested": [{"path": "/etc/'), user, F.lit('"}]')))
        .when(key % 4 == 2, F.concat(F.lit('"command": "x\\n*** Add File: b.txt\\n*** Update File: a'), user, F.lit('.txt\\n"'))).otherwise(F.lit('"file-path": "no/key"'))
    )
    other = F.when(key % 2 == 0, F.concat(F.lit('"Table": "t'), user, F.lit('/"'))).otherwise(F.concat(F.lit('"endpoint": "http://x/'), user, F.lit('"')))
    args = F.concat(F.lit("{"), paths, F.lit(", "), other, F.lit("}"))
    session = F.when(key % 3 == 0, F.concat(F.lit('"conversationId": "user-'), user, F.lit('", '))).otherwise("")
    named = F.when(key % 2 == 0, F.concat(F.lit('"toolName": "'), F.col("event_type"), F.lit('", "tool_input": '), args)).otherwise(F.concat(F.lit('"toolCall": {"name": "mcp__'), F.col("event_type"), F.lit('__a__b_c", "args": '), args, F.lit("}")))
    facts = payload.facts(F.concat(F.lit("{"), session, named, F.lit("}")))
    return e.select("event_id", facts.alias("f")).select("event_id", "f.session", F.array_join("f.paths", ",").alias("paths"), F.array_join("f.resources", ",").alias("resources"))


@query(rf"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path FROM pages)
SELECT path, bool_or(page_id % 3 <> 0) AS exists FROM p GROUP BY path""")
def changed_partition(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1).alias("path"))
    listed = p.groupBy("page_id").agg(F.concat(F.max("path"), F.lit("\x00"), F.max("path"), F.lit("\x00")).alias("value"))
    every, there = sources.partitioned(sources.diff_paths(listed), p.where("page_id % 3 <> 0"))
    gone = every.join(there, "path", "left_anti")
    return there.select("path", F.lit(True).alias("exists")).unionByName(gone.select("path", F.lit(False).alias("exists")))
