"""What projects are made of: languages, frameworks, tools and the checks they suggest, from their files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.files import components, dependency_names, extension

#: Directories without sources of the project (fixed values).
SKIPPED = [".git", "target", "node_modules", "vendor", ".venv", "venv", "dist", "build", ".next"]
#: Extension -> language (fixed values).
LANGUAGES = {
    "Rust": "rs", "Go": "go", "Python": "py pyi", "JavaScript/TypeScript": "js jsx mjs cjs ts tsx mts cts", "Java/Kotlin": "java kt kts", "Swift": "swift", "Dart": "dart", "C#": "cs", "C/C++": "c h cc cpp cxx hpp", "PHP": "php",
    "Ruby": "rb", "Shell": "sh bash zsh fish", "Lua": "lua", "Elixir": "ex exs", "Erlang": "erl hrl", "Scala": "scala sc", "R": "r", "SQL": "sql", "Terraform/HCL": "tf hcl", "Solidity": "sol", "Zig": "zig", "Vue SFC": "vue",
    "Svelte": "svelte", "Protocol Buffers": "proto",
}
#: Package -> kind and label (fixed values).
PACKAGES = [
    ("next", "framework", "Next.js"), ("react", "framework", "React"), ("vue", "framework", "Vue"), ("svelte", "framework", "Svelte"), ("@angular/core", "framework", "Angular"), ("express", "framework", "Express"),
    ("fastify", "framework", "Fastify"), ("@nestjs/core", "framework", "NestJS"), ("react-native", "framework", "React Native"), ("expo", "framework", "Expo"), ("@capacitor/core", "framework", "Capacitor"),
    ("electron", "framework", "Electron"), ("@langchain/core", "framework", "LangChain"), ("@openai/agents", "framework", "OpenAI Agents SDK"), ("ai", "framework", "Vercel AI SDK"),
    ("prisma", "database", "Prisma"), ("@prisma/client", "database", "Prisma"), ("typeorm", "database", "TypeORM"), ("sequelize", "database", "Sequelize"), ("drizzle-orm", "database", "Drizzle ORM"), ("mongoose", "database", "Mongoose"),
    ("vitest", "test", "Vitest"), ("jest", "test", "Jest"), ("@playwright/test", "test", "Playwright"), ("cypress", "test", "Cypress"),
]
#: Root file -> kind and label (fixed values).
MARKERS = [
    ("Cargo.toml", "language", "Rust"), ("Cargo.toml", "package_manager", "Cargo"), ("Cargo.toml", "test", "cargo test"), ("go.mod", "language", "Go"), ("go.mod", "package_manager", "Go modules"), ("go.mod", "test", "go test"),
    ("pyproject.toml", "language", "Python"), ("requirements.txt", "language", "Python"), ("setup.py", "language", "Python"), ("package.json", "language", "JavaScript/TypeScript"), ("pom.xml", "language", "Java/Kotlin"),
    ("pom.xml", "package_manager", "Maven"), ("pom.xml", "test", "Maven test"), ("build.gradle", "language", "Java/Kotlin"), ("build.gradle.kts", "language", "Java/Kotlin"), ("Package.swift", "language", "Swift"),
    ("Package.swift", "package_manager", "Swift Package Manager"), ("Package.swift", "test", "swift test"), ("pubspec.yaml", "language", "Dart"), ("pubspec.yaml", "package_manager", "pub"), ("composer.json", "language", "PHP"),
    ("composer.json", "package_manager", "Composer"), ("Gemfile", "language", "Ruby"), ("Gemfile", "package_manager", "Bundler"), ("schema.prisma", "database", "Prisma"), ("prisma/schema.prisma", "database", "Prisma"),
]
#: Root file -> suggested checks: name, command, enabled (fixed values).
COMMANDS = [
    ("Cargo.toml", "format", "cargo fmt --all -- --check", True), ("Cargo.toml", "lint", "cargo clippy --workspace --all-targets --all-features -- -D warnings", True), ("Cargo.toml", "test", "cargo test --workspace", True),
    ("Cargo.toml", "build", "cargo build --workspace", True), ("Cargo.toml", "dependency-audit", "cargo audit --deny warnings", False), ("Cargo.toml", "supply-chain", "cargo deny check", False),
    ("go.mod", "format", "gofmt -l . | awk 'NF { found=1 } END { exit found }'", True), ("go.mod", "test", "go test ./...", True), ("go.mod", "lint", "go vet ./...", True), ("go.mod", "build", "go build ./...", True),
    ("go.mod", "dependency-audit", "govulncheck ./...", False), ("pom.xml", "test", "mvn test", True), ("pom.xml", "build", "mvn package -DskipTests", True), ("Package.swift", "test", "swift test", True),
    ("Package.swift", "build", "swift build", True), ("composer.json", "dependency-audit", "composer audit", False), ("Gemfile", "dependency-audit", "bundle audit check --update", False),
]
#: Text of pyproject.toml -> suggested checks (fixed values).
PYTHON_COMMANDS = [("pytest", "test", "pytest"), ("ruff", "lint", "ruff check ."), ("ruff", "format", "ruff format --check ."), ("mypy", "typecheck", "mypy ."), ("pyright", "typecheck", "pyright")]
#: Script of package.json -> name of the check, the first of each name counts (fixed values).
SCRIPTS = [
    ("format:check", "format"), ("format", "format"), ("lint", "lint"), ("typecheck", "typecheck"), ("type-check", "typecheck"), ("test", "test"), ("test:unit", "test"), ("build", "build"), ("audit", "dependency-audit"),
    ("licenses", "license"), ("license", "license"), ("sbom", "sbom"),
]
#: Lock file -> label, runner and name of the package manager, the first counts (fixed values).
LOCKS = [("pnpm-lock.yaml", "pnpm", "pnpm", "pnpm"), ("yarn.lock", "Yarn", "yarn", "yarn"), ("bun.lockb", "Bun", "bun run", "bun"), ("bun.lock", "Bun", "bun run", "bun"), (None, "npm", "npm run", "npm")]


def _dim(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def labels(names: DataFrame, catalog: list = PACKAGES, by: str = "project") -> DataFrame:
    """(by, kind, label) of dependency names (by, name) that a catalog knows, distinct."""
    known = _dim(names.sparkSession, catalog, "name string, kind string, label string")
    return names.join(known, "name").select(by, "kind", "label").distinct()


def _has(root: DataFrame, *names: str) -> Column:
    return F.coalesce(F.bool_or(F.col("path").isin(*names)), F.lit(False))


def managers(files: DataFrame) -> DataFrame:
    """(project, label, runner, manager) of projects with a package.json: by the first lock file, else npm."""
    roots = files.where(F.col("path").isin("package.json", *(x[0] for x in LOCKS if x[0]))).groupBy("project").agg(F.collect_set("path").alias("at")).where(F.array_contains("at", "package.json"))
    pick = F.lit(None).cast("struct<label:string,runner:string,manager:string>")
    for lock, *names in reversed(LOCKS):
        one = F.struct(*(F.lit(n).alias(k) for n, k in zip(names, ("label", "runner", "manager"))))
        pick = one if lock is None else F.when(F.array_contains("at", lock), one).otherwise(pick)
    return roots.select("project", pick.alias("x")).select("project", "x.*")


def detected(files: DataFrame) -> DataFrame:
    """(project, kind, label), distinct, of the files (project, path, content) of many projects; order by label for a report."""
    spark = files.sparkSession
    pairs = [F.lit(x) for name, exts in LANGUAGES.items() for e in exts.split() for x in (e, name)]
    kept = files.where(~F.arrays_overlap(components(F.col("path")), F.array(*(F.lit(d) for d in SKIPPED))))
    language = F.try_element_at(F.create_map(*pairs), T.ascii_lower(extension(F.col("path"))))
    out = [kept.select("project", F.lit("language").alias("kind"), language.alias("label")).where("label IS NOT NULL")]
    marks = _dim(spark, MARKERS, "path string, kind string, label string")
    out.append(files.join(marks, "path").select("project", "kind", "label"))
    out.append(labels(dependency_names(files.where("path = 'package.json'"), "project", "content").select("project", "name")))
    out.append(managers(files).select("project", F.lit("package_manager").alias("kind"), "label"))
    root = files.groupBy("project").agg(
        _has(files, "pyproject.toml", "requirements.txt", "setup.py").alias("python"), _has(files, "poetry.lock").alias("poetry"), _has(files, "uv.lock").alias("uv"), _has(files, "pom.xml").alias("maven"),
        _has(files, "build.gradle", "build.gradle.kts").alias("gradle"), F.bool_or(F.col("path").rlike("(?i)^[^/]+\\.(sln|csproj)$")).alias("dotnet"), F.bool_or(F.col("path").rlike("^(db/)?migrations/")).alias("migrations"),
        F.coalesce(F.bool_or((F.col("path") == "pytest.ini") | ((F.col("path") == "pyproject.toml") & F.contains("content", F.lit("pytest")))), F.lit(False)).alias("pytest"),
        _has(files, "pubspec.yaml").alias("dart"), F.coalesce(F.bool_or((F.col("path") == "pubspec.yaml") & F.col("content").rlike("(?m)^\\s*flutter:\\s*$")), F.lit(False)).alias("flutter"),
    )
    say = lambda when, kind, label: F.when(when, F.struct(F.lit(kind).alias("kind"), (label if isinstance(label, Column) else F.lit(label)).alias("label")))
    facts = [
        say(F.col("python"), "package_manager", F.when(F.col("poetry"), "Poetry").when(F.col("uv"), "uv").otherwise("pip")), say(F.col("python") & F.col("pytest"), "test", "pytest"),
        say(F.col("gradle") & ~F.col("maven"), "package_manager", "Gradle"), say(F.col("dotnet"), "language", "C#"), say(F.col("dotnet"), "package_manager", "NuGet"), say(F.col("dotnet"), "test", "dotnet test"),
        say(F.col("migrations"), "database", "SQL migrations"), say(F.col("flutter"), "framework", "Flutter"), say(F.col("dart"), "test", F.when(F.col("flutter"), "flutter test").otherwise("dart test")),
    ]
    out.append(root.select("project", F.explode(F.array_compact(F.array(*facts))).alias("x")).select("project", "x.*"))
    return reduce(DataFrame.unionByName, out).distinct()


def commands(files: DataFrame) -> DataFrame:
    """(project, seq, name, command, enabled): the checks that the files of each project suggest, in the order of detection.

    A later command of a name that is taken has its tool behind the name, and a number where that is taken, too.
    """
    spark = files.sparkSession
    fixed = _dim(spark, [(f, i, n, c, e) for i, (f, n, c, e) in enumerate(COMMANDS)], "path string, seq int, name string, command string, enabled boolean")
    out = [files.join(fixed, "path").select("project", "seq", "name", "command", "enabled")]
    python = _dim(spark, [(w, 100 + i, n, c) for i, (w, n, c) in enumerate(PYTHON_COMMANDS)], "word string, seq int, name string, command string")
    toml = files.where("path = 'pyproject.toml'").join(python, F.contains("content", F.col("word")))
    out.append(toml.select("project", "seq", "name", "command", F.lit(True).alias("enabled")))
    keys = F.json_object_keys(F.get_json_object("content", "$.scripts"))
    node = files.where("path = 'package.json'").select("project", F.coalesce(keys, F.array().cast("array<string>")).alias("scripts")).join(managers(files), "project")
    wanted = _dim(spark, [(s, 200 + i, n) for i, (s, n) in enumerate(SCRIPTS)], "script string, seq int, name string")
    runs = node.join(wanted, F.array_contains("scripts", F.col("script"))).groupBy("project", "name", "runner").agg(F.min(F.struct("seq", "script")).alias("x"))
    out.append(runs.select("project", "x.seq", "name", F.concat_ws(" ", "runner", "x.script").alias("command"), F.lit(True).alias("enabled")))
    optional = lambda rows, seq, name, command: rows.select("project", F.lit(seq).alias("seq"), F.lit(name).alias("name"), command.alias("command"), F.lit(False).alias("enabled"))
    out.append(optional(node.where(~F.array_contains("scripts", "audit")), 300, "dependency-audit", F.concat("manager", F.lit(" audit"))))
    out.append(optional(node.where((F.col("manager") == "npm") & ~F.array_contains("scripts", "sbom")), 301, "sbom", F.lit("npm sbom --sbom-format cyclonedx")))
    root = files.groupBy("project").agg(
        _has(files, "pyproject.toml", "requirements.txt", "setup.py").alias("python"), _has(files, "build.gradle", "build.gradle.kts").alias("gradle"), _has(files, "pom.xml").alias("maven"), _has(files, "gradlew").alias("wrapper"),
        F.bool_or(F.col("path").rlike("(?i)^[^/]+\\.(sln|csproj)$")).alias("dotnet"), _has(files, "pubspec.yaml").alias("dart"),
        F.coalesce(F.bool_or((F.col("path") == "pubspec.yaml") & F.col("content").rlike("(?m)^\\s*flutter:\\s*$")), F.lit(False)).alias("flutter"),
    )
    gradle = F.when(F.col("wrapper"), "./gradlew").otherwise("gradle")
    say = lambda when, seq, name, command, enabled=True: F.when(when, F.struct(F.lit(seq).alias("seq"), F.lit(name).alias("name"), (command if isinstance(command, Column) else F.lit(command)).alias("command"), F.lit(enabled).alias("enabled")))
    by_gradle = F.col("gradle") & ~F.col("maven")
    facts = [
        say(F.col("python"), 150, "dependency-audit", "pip-audit", False), say(F.col("python"), 151, "license", "pip-licenses --format=json", False), say(F.col("python"), 152, "sbom", "cyclonedx-py environment --output-format JSON", False),
        say(by_gradle, 400, "test", F.concat(gradle, F.lit(" test"))), say(by_gradle, 401, "build", F.concat(gradle, F.lit(" build -x test"))), say(F.col("dart"), 410, "format", "dart format --output=none --set-exit-if-changed ."),
        say(F.col("dart"), 411, "lint", "dart analyze"), say(F.col("dart"), 412, "test", F.when(F.col("flutter"), "flutter test").otherwise("dart test")), say(F.col("dotnet"), 420, "format", "dotnet format --verify-no-changes"),
        say(F.col("dotnet"), 421, "test", "dotnet test"), say(F.col("dotnet"), 422, "build", "dotnet build --no-restore"),
    ]
    out.append(root.select("project", F.explode(F.array_compact(F.array(*facts))).alias("x")).select("project", "x.*"))
    every = reduce(DataFrame.unionByName, out).groupBy("project", "name", "command").agg(F.min("seq").alias("seq"), F.first("enabled").alias("enabled"))
    tool = F.lower(F.regexp_replace(F.regexp_replace(F.split("command", "\\s+")[0], "^[./]+", ""), "[^A-Za-z0-9]", "-"))
    place = F.row_number().over(W.partitionBy("project", "name").orderBy("seq"))
    again = F.row_number().over(W.partitionBy("project", "name", "taken", "tool").orderBy("seq"))
    every = every.withColumn("tool", tool).withColumn("taken", place > 1).withColumn("again", again)
    name = F.when(~F.col("taken"), F.col("name")).otherwise(F.concat("name", F.lit("-"), "tool", F.when(F.col("again") > 1, F.concat(F.lit("-"), F.col("again").cast("string"))).otherwise("")))
    return every.select("project", "seq", name.alias("name"), "command", "enabled")


def reconciled(own: DataFrame, found: DataFrame) -> DataFrame:
    """A project's own commands, untouched, and of the detected ones the first of each name it doesn't have."""
    first = found.groupBy("project", "name").agg(F.min(F.struct("seq", "command", "enabled")).alias("x")).select("project", "x.seq", "name", "x.command", "x.enabled")
    return own.withColumn("added", F.lit(False)).unionByName(first.join(own, ["project", "name"], "left_anti").withColumn("added", F.lit(True)))


def described(found: DataFrame) -> DataFrame:
    """(project, report): what was detected, a line for each kind, labels in order."""
    rows = found.groupBy("project", "kind").agg(F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("labels"))
    return rows.groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "labels"))), lambda r: F.concat(r["kind"], F.lit(": "), r["labels"])), "\n").alias("report"))
