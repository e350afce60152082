"""File, line, diff, coverage and manifest sources."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

#: Directories that are never scanned, extensions that are (fixed values).
EXCLUDED_DIRS = [".git", ".vetra", "node_modules", "target", "dist", "build", "coverage", "vendor", ".next", ".turbo"]
SOURCE_EXTENSIONS = (
    "rs go py pyi js jsx mjs cjs ts tsx mts cts java kt kts swift dart sql rb php cs cpp cc cxx c h hpp sh bash zsh astro fish "
    "lua ex exs erl hrl scala sc r tf hcl sol zig vue svelte proto"
).split()
CONFIG_EXTENSIONS = ["yaml", "yml", "json", "toml", "ini", "conf", "properties"]
DOC_EXTENSIONS = "md mdx markdown rst adoc asciidoc org txt text png jpg jpeg gif webp svg ico pdf".split()
FIXTURE_DIRS = ["test", "tests", "__tests__", "spec", "specs", "fixtures", "testdata"]
#: Files whose change means other dependencies (fixed values).
DEPENDENCY_FILES = (
    "Cargo.toml Cargo.lock package.json package-lock.json pnpm-lock.yaml yarn.lock bun.lock bun.lockb pyproject.toml poetry.lock uv.lock go.mod go.sum pom.xml build.gradle build.gradle.kts gradle.lockfile "
    "Package.swift Package.resolved pubspec.yaml pubspec.lock Gemfile Gemfile.lock composer.json composer.lock packages.lock.json Directory.Packages.props mix.exs mix.lock rebar.config rebar.lock deps.edn project.clj"
).split()
#: Extension -> language family (fixed values).
FAMILIES = {
    "javascript": "js jsx mjs cjs ts mts cts tsx", "rust": "rs", "go": "go", "python": "py pyi", "java": "java", "kotlin": "kt kts", "csharp": "cs", "c": "c", "cpp": "cpp cc cxx h hpp",
    "ruby": "rb", "php": "php", "swift": "swift", "dart": "dart", "shell": "sh bash zsh", "zig": "zig", "lua": "lua", "scala": "scala sc", "solidity": "sol", "elixir": "ex exs",
    "erlang": "erl hrl", "r": "r", "hcl": "tf hcl",
}


def components(path: Column) -> Column:
    return F.split(path, "/")


def file_name(path: Column) -> Column:
    return F.element_at(components(path), -1)


def extension(path: Column) -> Column:
    return F.when(file_name(path).rlike("^.+\\.[^.]*$"), F.element_at(F.split(file_name(path), "\\."), -1))


def is_excluded(path: Column) -> Column:
    return F.arrays_overlap(components(path), F.array(*(F.lit(d) for d in EXCLUDED_DIRS)))


def is_test_path(path: Column) -> Column:
    named = F.exists(components(path), lambda c: T.ascii_lower(c).isin("test", "tests", "__tests__"))
    return named | file_name(path).rlike("(_test\\.go|_test\\.rs)$|\\.test\\.|\\.spec\\.")


def is_source(path: Column) -> Column:
    return F.coalesce(extension(path).isin(SOURCE_EXTENSIONS), F.lit(False))


def is_secret_text(path: Column) -> Column:
    name = T.ascii_lower(file_name(path))
    return (name == "dockerfile") | F.startswith(name, F.lit(".env")) | F.coalesce(T.ascii_lower(extension(path)).isin(CONFIG_EXTENSIONS), F.lit(False))


def is_documentation(path: Column) -> Column:
    fixture = F.exists(components(path), lambda c: T.ascii_lower(c).isin(FIXTURE_DIRS))
    return F.coalesce(T.ascii_lower(extension(path)).isin(DOC_EXTENSIONS), F.lit(False)) & ~fixture


def is_dependency(path: Column) -> Column:
    name = file_name(path)
    return name.isin(DEPENDENCY_FILES) | name.rlike("^requirements.*\\.txt$|\\.csproj$")


def family(path: Column) -> Column:
    pairs = [F.lit(x) for name, exts in FAMILIES.items() for e in exts.split() for x in (e, name)]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def scan(spark: SparkSession, root: str, max_bytes: int = 1_000_000, include_tests: bool = False, extra_excludes: list[str] | None = None, paths: DataFrame | None = None, ignore: str = "") -> DataFrame:
    """files(path, ext, length, content, is_test, kind) under ``root``; paths are relative to it and predicates see only them.

    Larger files and those that aren't UTF-8 are left out, as are those that an
    ignore file above them, the project's exclude file or ``ignore`` (rules of
    all projects) names.  ``paths`` (path) are read instead, whatever ignore files say; an empty one scans nothing.
    """
    from . import project

    wanted = project.Wanted(max_bytes, include_tests, tuple(extra_excludes or ()))
    if paths is None:
        files = project.load(spark, root, wanted, ignore)
    else:
        files = project.load_paths(root, paths.select(T.portable_path(F.col("path"), root.rstrip("/")).alias("path")), wanted)
    path = F.col("path")
    kind = F.when(extension(path).isin("vue", "svelte", "astro"), "component").when(extension(path) == "sql", "sql").when(is_source(path), "code").otherwise("secret_text")
    return files.select("path", extension(path).alias("ext"), "length", "content", is_test_path(path).alias("is_test"), kind.alias("kind"))


def lines(files: DataFrame, text: str = "content", *keys: str) -> DataFrame:
    """(keys, line, text): numbered from 1."""
    keys = keys or ("path",)
    return files.select(*keys, F.posexplode(T.lines_of(F.col(text))).alias("at", "text")).select(*keys, (F.col("at") + 1).cast("long").alias("line"), "text")


def embedded_scripts(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ordinal, script, is_ts): bodies of script elements, in order."""
    tags = F.regexp_extract_all(F.col(text), F.lit("(?is)(<script\\b[^>]*>)(.*?)</script>"), F.lit(1))
    bodies = F.regexp_extract_all(F.col(text), F.lit("(?is)(<script\\b[^>]*>)(.*?)</script>"), F.lit(2))
    out = files.select(key, F.posexplode(F.arrays_zip(tags.alias("tag"), bodies.alias("body"))).alias("at", "s"))
    return out.select(key, (F.col("at") + 1).cast("long").alias("ordinal"), F.col("s.body").alias("script"), F.col("s.tag").rlike("(?i)lang\\s*=\\s*[\"']?ts").alias("is_ts"))


def masked_script(text: Column) -> Column:
    """Everything but the script bodies blanked, line breaks kept, so that lines stay where they are."""
    whole = "(?is)(.*?)(?:(<script\\b[^>]*>)(.*?)(</script>)|\\z)"
    part = lambda k: F.regexp_extract_all(text, F.lit(whole), F.lit(k))
    blank = lambda s: F.regexp_replace(s, "[^\\n]", " ")
    pieces = F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), part(4).alias("d"))
    return F.array_join(F.transform(pieces, lambda p: F.concat(blank(p["a"]), blank(p["b"]), p["c"], blank(p["d"]))), "")


def masked_frontmatter(text: Column) -> Column:
    """As :func:`masked_script`, with the block between two ``---`` lines at the head of the file kept, too."""
    head = F.regexp_extract(text, "(?s)^(\\s*---[ \\t]*\\r?\\n.*?\\n---[ \\t]*)(?=\\r?\\n|\\z)", 1)
    body = F.substring(text, F.length(head) + 1, F.length(text))
    return F.concat(F.regexp_replace(head, "(?m)^([ \\t]*)---[ \\t]*$", "$1   "), masked_script(body))


# ---- diffs -------------------------------------------------------------------

_HUNK = "^@@ \\S+ \\+(\\d+)(?:,(\\d+))?"


def hunks(headers: DataFrame) -> DataFrame:
    """scope(path, start_line, end_line) of (path, hunk_header); hunks that add nothing are dropped."""
    start = F.regexp_extract("hunk_header", _HUNK, 1).try_cast("long")
    count = F.coalesce(F.regexp_extract("hunk_header", _HUNK, 2).try_cast("long"), F.lit(1))
    return headers.where(F.col("hunk_header").rlike(_HUNK)).select("path", start.alias("start_line"), (start + count - 1).alias("end_line")).where("end_line >= start_line")


def status_paths(porcelain: DataFrame, column: str = "value") -> DataFrame:
    """(path, untracked) of NUL-separated status records; after a rename or copy the next record is its source."""
    records = F.filter(F.split(F.col(column), "\\x00"), lambda r: r != "")
    state = F.expr("named_struct('skip', false, 'out', CAST(array() AS array<struct<path:string,untracked:boolean>>))")

    def step(acc: Column, r: Column) -> Column:
        one = F.struct(F.substring(r, 4, 1 << 30).alias("path"), F.startswith(r, F.lit("??")).alias("untracked"))
        take = F.struct(F.substring(r, 1, 2).rlike("[RC]").alias("skip"), F.concat(acc["out"], F.array(one)).alias("out"))
        return F.when(acc["skip"], F.struct(F.lit(False).alias("skip"), acc["out"].alias("out"))).otherwise(take)

    return porcelain.select(F.explode(F.aggregate(records, state, step, lambda a: a["out"])).alias("r")).select("r.path", "r.untracked").distinct()


def changed_scope(diff_paths: DataFrame, status: DataFrame, ranges: DataFrame, existing: DataFrame) -> DataFrame:
    """scope rows for every changed file that exists; whole files where untracked, none where only lines went."""
    paths = diff_paths.select("path").union(status.select("path")).distinct().join(existing.select("path").distinct(), "path", "left_semi")
    new = paths.join(status.where("untracked").select("path").distinct(), "path", "left_semi").select("path", F.lit(1).cast("long").alias("start_line"), F.lit((1 << 63) - 1).alias("end_line"))
    return new.unionByName(ranges.join(paths, "path", "left_semi").join(new.select("path"), "path", "left_anti"))


def partitioned(changed: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All changed paths, and those of them that still exist."""
    every = changed.select("path").distinct()
    return every, every.join(existing.select("path").distinct(), "path", "left_semi")


def diff_paths(names: DataFrame, column: str = "value") -> DataFrame:
    """(path) of NUL-separated name listings of a diff against a revision; paths are portable and distinct."""
    parts = F.filter(F.split(F.col(column), "\\x00"), lambda r: r != "")
    return names.select(F.explode(parts).alias("path")).select(T.portable_path(F.col("path")).alias("path")).distinct()


def committed(files: DataFrame, previous: DataFrame) -> DataFrame:
    """(path, content, before): files beside their committed version, null for a new one."""
    return files.select("path", "content").join(previous.select("path", F.col("content").alias("before")), "path", "left")


# ---- coverage, manifests, settings --------------------------------------------


#: Lines of a coverage report that one window takes.
LCOV_SLICE = 100_000


def lcov(report: DataFrame, root: str | None = None) -> DataFrame:
    """(path, line, hits) of (at, value), the lines of a report in order.

    ``SF:`` sets the file and it stays set.  A report is cut into slices of its
    order; what a slice hands on to the next is the file it ends with, so no
    window holds more than a slice.
    """
    named = report if "report" in report.columns else report.withColumn("report", F.lit(0))
    opens = F.when(F.startswith("value", F.lit("SF:")), F.substring("value", 4, 1 << 30))
    named = named.withColumns({"vetra_slice": F.floor(F.col("at") / LCOV_SLICE), "vetra_sf": opens})
    inside = W.partitionBy("report", "vetra_slice").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    ends = named.where("vetra_sf IS NOT NULL").groupBy("report", "vetra_slice").agg(F.max_by("vetra_sf", "at").alias("vetra_end"))
    slices = named.select("report", "vetra_slice").distinct().join(ends, ["report", "vetra_slice"], "left")
    before = F.last("vetra_end", ignorenulls=True).over(W.partitionBy("report").orderBy("vetra_slice").rowsBetween(W.unboundedPreceding, -1))
    slices = slices.select("report", "vetra_slice", before.alias("vetra_before"))
    named = named.withColumn("vetra_here", F.last("vetra_sf", ignorenulls=True).over(inside)).join(slices, ["report", "vetra_slice"]).withColumn("path", F.coalesce("vetra_here", "vetra_before"))
    data = "^DA:(\\d+),(-?\\d+)"
    hit = named.where(F.col("value").rlike(data) & F.col("path").isNotNull())
    return hit.select(T.portable_path(F.col("path"), root).alias("path"), F.regexp_extract("value", data, 1).cast("long").alias("line"), F.regexp_extract("value", data, 2).cast("long").alias("hits"))


def dependency_names(manifests: DataFrame, key: str, json: str) -> DataFrame:
    """(key, name) of the dependency maps of JSON manifests, distinct."""
    kinds = ["dependencies", "devDependencies", "peerDependencies"]
    parsed = F.from_json(json, ", ".join(f"{k} map<string,string>" for k in kinds))
    names = F.flatten(F.array(*(F.coalesce(F.map_keys(parsed[k]), F.array().cast("array<string>")) for k in kinds)))
    return manifests.select(key, F.explode(F.array_distinct(names)).alias("name"))


#: Tables of a settings file, their keys and the fields that these set (fixed values of the format).
SETTINGS = {
    "": {"version": "version", "mode": "mode"},
    "project": {"name": "project"},
    "scan": {k: k for k in ("enabled", "max_file_bytes", "include_tests", "extra_excludes", "duplicate_block_lines", "coverage_report", "taint_sources", "trusted_sanitizers")} | {"min_changed_coverage": "coverage_minimum"},
    "focus": {"enabled": "focus", "max_retries": "max_retries", "no_progress_limit": "no_progress_limit", "auto_poke": "auto_poke", "max_auto_pokes": "max_auto_pokes", "min_confidence": "minimum_confidence", "min_hill_climbability": "minimum_completeness"},
    "policies": {"warnings_block": "warnings_block"},
    "update": {"policy": "update_policy"},
    # names of this library for the same settings
    "gate": {k: k for k in ("mode", "warnings_block", "coverage_minimum", "coverage_report")},
    "loop": {k: k for k in ("max_retries", "no_progress_limit", "max_auto_pokes", "minimum_confidence", "minimum_completeness", "command_timeout_seconds")},
    "coverage": {k: k for k in ("coverage_minimum", "coverage_report")},
}
#: Keys of a command and of a rule, with the kinds of their values (fixed values of the format).
COMMAND_KEYS = {"name": str, "command": str, "required": bool, "enabled": bool, "timeout_seconds": int}
RULE_KEYS = {"enabled": bool, "severity": str, "block": bool}
SEVERITIES = ("info", "warning", "error")


@dataclass(frozen=True)
class Config:
    """Settings with their defaults."""

    version: int = 2
    project: str | None = None
    enabled: bool = True
    mode: str = "focus"
    warnings_block: bool | None = None
    max_file_bytes: int = 1_000_000
    include_tests: bool = False
    duplicate_block_lines: int = 6
    command_timeout_seconds: int = 600
    focus: bool = True
    max_retries: int = 3
    no_progress_limit: int = 2
    auto_poke: bool = True
    max_auto_pokes: int = 3
    minimum_confidence: int = 80
    minimum_completeness: int = 80
    coverage_minimum: int | None = None
    coverage_report: str | None = None
    extra_excludes: tuple[str, ...] = ()
    taint_sources: tuple[str, ...] = ()
    trusted_sanitizers: tuple[str, ...] = ()
    update_policy: str = "auto"
    commands: tuple = ()
    rules: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.version not in (1, 2):
            raise ValueError(f"unsupported settings version {self.version}")
        if self.coverage_minimum is not None and (not 0 <= self.coverage_minimum <= 100 or not self.coverage_report):
            raise ValueError("a coverage minimum is 0 to 100 and needs a report")

    @classmethod
    def from_toml(cls, text: str) -> Config:
        """Settings from a file; tables and keys that no setting has, and values of the wrong kind, are refused."""
        raw = tomllib.loads(text)
        known: dict = {}
        for name, part in {"": {k: v for k, v in raw.items() if not isinstance(v, dict | list)}, **{k: v for k, v in raw.items() if isinstance(v, dict | list)}}.items():
            if name == "commands":
                known["commands"] = tuple({"required": True, "enabled": True, "timeout_seconds": 600} | _checked(f"commands.{i}", c, COMMAND_KEYS) for i, c in enumerate(part))
                if any(not {"name", "command"} <= set(c) for c in known["commands"]):
                    raise ValueError("a command needs a name and what it runs")
            elif name == "rules":
                known["rules"] = {k: _checked(f"rules.{k}", v, RULE_KEYS) for k, v in part.items()}
                if any(v.get("severity", "info") not in SEVERITIES for v in known["rules"].values()):
                    raise ValueError(f"a severity is one of {', '.join(SEVERITIES)}")
            else:
                if name not in SETTINGS or not isinstance(part, dict):
                    raise ValueError(f"unknown table {name}")
                for key, value in part.items():
                    if key not in SETTINGS[name]:
                        raise ValueError(f"unknown setting {name}.{key}".replace(" .", " "))
                    to = SETTINGS[name][key]
                    like = cls.__dataclass_fields__[to].type
                    kind = tuple if like.startswith("tuple") else bool if like.startswith("bool") else int if like.startswith("int") else str
                    value = tuple(value) if isinstance(value, list) else value
                    if not isinstance(value, kind) or kind is int and isinstance(value, bool):
                        raise ValueError(f"{name}.{key} has the wrong kind of value")
                    known[to] = value
        return cls(**known)

    def rule_rows(self, spark: SparkSession) -> DataFrame:
        rows = [(k, v.get("enabled"), v.get("severity"), v.get("block")) for k, v in self.rules.items()]
        return spark.createDataFrame(rows, "rule_id string, enabled boolean, severity string, block boolean")


def _checked(name: str, values: dict, kinds: dict) -> dict:
    for key, value in values.items():
        if key not in kinds or not isinstance(value, kinds[key]) or kinds[key] is int and isinstance(value, bool):
            raise ValueError(f"unknown or wrong setting {name}.{key}")
    return values
