"""The gate: files to findings to a verdict, every step in its order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clones, measure, policy, rules
from ..operators.closure import cut
from ..schema import BASELINE, FINDING, RULES
from ..sources import files as sources
from ..sources import syntax
from ..sources.files import Config


@dataclass(frozen=True)
class Gate:
    findings: DataFrame
    summary: DataFrame


def completed(rows: DataFrame) -> DataFrame:
    """Rows (rule_id, severity, path, line, evidence) as findings: title and confidence by rule, ``heuristic`` for one that no rule table knows."""
    meta = rows.sparkSession.createDataFrame([(r, c, t) for r, _, c, t in RULES], "rule_id string, confidence string, title string")
    out = rows.join(F.broadcast(meta), "rule_id", "left")
    return out.select(
        "rule_id", F.coalesce("title", "rule_id").alias("title"), "severity", F.coalesce("confidence", F.lit("heuristic")).alias("confidence"), F.lit(False).alias("blocking"), "path", "line",
        F.lit(None).cast("long").alias("end_line"), "evidence", F.concat(F.lit("Review: "), F.lower(F.coalesce("title", "rule_id"))).alias("recommendation"), F.lit(1 << 40).cast("long").alias("seq"),
    )


def scan(files: DataFrame, config: Config, paths: DataFrame | None = None, scope: DataFrame | None = None) -> DataFrame:
    """Findings over files (path, content): rules, then suppression, then clones, then the changed lines.

    ``paths`` (path) narrows what is reported; symbols, calls and clones are
    taken from all files.  ``scope`` (path, start_line, end_line) keeps findings
    that overlap a changed range.  A disabled project has no findings.
    """
    spark = files.sparkSession
    if not config.enabled:
        return spark.createDataFrame([], FINDING)
    path = F.col("path")
    every = files.select("path", "content").where(~sources.is_excluded(path))
    if not config.include_tests:
        every = every.where(~sources.is_test_path(path))
    for part in config.extra_excludes:
        every = every.where(~F.contains("path", F.lit(part)))
    # read by every step below, so dealt out and written once
    every = cut(syntax.spread(every), "files")
    files = every.where(F.octet_length("content") <= config.max_file_bytes)
    nodes = cut(syntax.nodes(files, dealt=True), "nodes")
    found = rules.findings(files, list(config.taint_sources), list(config.trusted_sanitizers), nodes, include_tests=True)  # tests are out already if they are to be
    shown = files if paths is None else files.join(paths.select("path").distinct(), "path", "left_semi")
    if paths is not None:
        found = found.join(paths.select("path").distinct(), "path", "left_semi")
    found = policy.suppress(found, policy.suppressions(sources.lines(shown.where(F.contains("content", F.lit(policy.MARKER))))))
    size = config.duplicate_block_lines
    # repeated lines are looked for in files of any size
    code = every.where(sources.is_source(path))
    focus = None if paths is None else paths.select("path")
    same = clones.duplicate_findings(code, "path", "content", size, focus, exact=True).unionByName(clones.function_findings(clones.functions(nodes, size), size, focus))
    found = found.unionByName(completed(same).select(found.columns))
    return found if scope is None else policy.in_changed_lines(found, scope).select(found.columns)


def run(
    files: DataFrame, config: Config, paths: DataFrame | None = None, scope: DataFrame | None = None, baseline: DataFrame | None = None, coverage: DataFrame | None = None, checks: DataFrame | None = None, scanned: DataFrame | None = None,
) -> Gate:
    """Findings and verdict over files (path, content); ``scanned`` are their findings by :func:`scan` without a scope, if they are there already.

    After :func:`scan` come the coverage of changed lines (with a scope and a
    configured minimum; ``coverage`` (path, line, hits) is null where the report
    is missing), the first of equal findings, overrides by rule, the baseline,
    what blocks, and the summary with the results of ``checks``.
    """
    spark = files.sparkSession
    scope = None if scope is None else cut(scope, "scope")  # read by up to four steps
    found = scan(files, config, paths, scope) if scanned is None else scanned if scope is None else policy.in_changed_lines(scanned, scope).select(scanned.columns)
    if config.enabled and scope is not None and config.coverage_minimum is not None:
        found = found.unionByName(completed(measure.coverage_findings(coverage, scope, config.coverage_report, config.coverage_minimum)).select(found.columns))
    known = spark.createDataFrame([], BASELINE) if baseline is None else baseline
    found = cut(found, "found")
    found = cut(policy.gate(found, config.rule_rows(spark), known, config.mode, config.version, config.warnings_block, policy.slices_of(found)), "gate")
    if checks is not None and scope is not None:
        changed = scope.agg(F.coalesce(F.bool_or(sources.is_dependency(F.col("path"))), F.lit(False)).alias("vetra_changed"))
        checks = measure.applicable(checks.join(F.broadcast(changed), F.lit(True)), F.col("vetra_changed")).drop("vetra_changed")
    return Gate(found, policy.summary(found, checks))
