"""Reports of a gate: text, bounded text, SARIF, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

#: Findings and characters of the bounded report.
COMPACT_FINDINGS = 5
COMPACT_CHARS = 2000


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("path", "line", "rule_id", "seq")


def finding_line() -> Column:
    return F.concat(F.lit("["), "severity", F.lit("] "), "rule_id", F.lit(" "), "path", F.lit(":"), F.col("line").cast("string"), F.lit(" "), "title")


def compact(findings: DataFrame, by: str, checks: DataFrame | None = None) -> DataFrame:
    """(by, report): the first findings in order, how many more there are, the failed checks, at most COMPACT_CHARS characters.

    Of a failed check the first line of its output that isn't blank is shown; ``checks`` has a column ``by``, too.
    """
    w = W.partitionBy(by).orderBy("path", "line", "rule_id", "seq")
    top = findings.withColumn("n", F.row_number().over(w)).where(F.col("n") <= COMPACT_FINDINGS)
    total = findings.groupBy(by).agg(F.count("*").alias("total"))
    shown = top.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("n", finding_line().alias("text")))).alias("rows")).join(total, by)
    more = F.when(F.col("total") > COMPACT_FINDINGS, F.concat(F.lit("\n"), (F.col("total") - COMPACT_FINDINGS).cast("string"), F.lit(" omitted"))).otherwise("")
    shown = shown.select(by, F.concat(F.array_join(F.transform("rows", lambda r: r["text"]), "\n"), more).alias("text"))
    if checks is None:
        return shown.select(by, T.truncated_within(F.col("text"), COMPACT_CHARS).alias("report"))
    line = F.concat(F.lit("[check] "), "name", F.lit(": "), first_nonblank(F.col("output")))
    failed = checks.where("NOT success").groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", line.alias("line")))), lambda r: r["line"]), "\n").alias("failed"))
    return shown.join(failed, by, "full").select(by, T.truncated_within(F.concat_ws("\n", "text", "failed"), COMPACT_CHARS).alias("report"))


def first_nonblank(output: Column, default: str = "command failed") -> Column:
    return F.coalesce(F.try_element_at(F.filter(T.lines_of(output), lambda s: T.trimmed(s) != ""), F.lit(1)), F.lit(default))


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF 2.1.0 result a finding, as JSON."""
    text = F.concat("title", F.lit(" Evidence: "), "evidence", F.lit(" Fix: "), "recommendation")
    region = F.struct(F.col("line").alias("startLine"), F.coalesce("end_line", "line").alias("endLine"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), T.sarif_level(F.col("severity")).alias("level"), F.struct(text.alias("text")).alias("message"), F.array(place).alias("locations"),
        F.struct(F.concat_ws(":", "rule_id", "path", "evidence").alias("finding")).alias("partialFingerprints"), F.struct("confidence", "blocking").alias("properties"),
    )
    return findings.select("path", "line", "rule_id", F.to_json(result).alias("result"))


def sarif_checks(checks: DataFrame) -> DataFrame:
    result = F.struct(
        T.check_rule_id(F.col("name")).alias("ruleId"), F.when(F.col("required"), "error").otherwise("warning").alias("level"),
        F.struct(F.concat("command", F.lit(" failed: "), first_nonblank(F.col("output"))).alias("text")).alias("message"), F.struct("required", "cached", F.col("exit_code").alias("exitCode")).alias("properties"),
    )
    return checks.where("NOT success").select("name", F.to_json(result).alias("result"))


def text_report(findings: list, checks: list, summary: dict, name: str = "gate") -> str:
    """A report for people, of collected rows."""
    out = [f"{name}: {summary['status']}", f"Findings: {summary['errors']} error(s), {summary['warnings']} warning(s), {summary['info']} info"]
    out += [f"  [{f['severity']}] {f['rule_id']} {f['path']}:{f['line']} {f['title']}\n      {f['evidence']}\n      {f['recommendation']}" for f in findings]
    for c in checks:
        out.append(f"  [{'PASS' if c['success'] else 'FAIL'}] {c['name']} ({c['duration_ms']} ms): {c['command']}")
        if not c["success"]:
            out += [f"      {line}" for line in (c["output"] or "").splitlines()[:20]]
    return "\n".join(out)


def host_decision(host: Column, decision: Column, message: Column) -> Column:
    """A stop decision (pass, block, stop) as each host wants it; an empty text where a host wants nothing.

    The hosts with forms of their own are cursor, antigravity and openclaw; all others take a block or no continuation as JSON.
    """
    json = lambda **parts: F.to_json(F.struct(*(v.alias(k) for k, v in parts.items())))
    passes = F.when(host == "cursor", "{}").when(host == "antigravity", json(decision=F.lit("stop"))).otherwise("")
    block = (
        F.when(host == "cursor", json(followup_message=message)).when(host == "antigravity", json(decision=F.lit("continue"), reason=message))
        .when(host == "openclaw", json(action=F.lit("revise"), reason=message)).otherwise(json(decision=F.lit("block"), reason=message))
    )
    stop = (
        F.when(host == "cursor", "{}").when(host == "antigravity", json(decision=F.lit("stop"), reason=message)).when(host == "openclaw", json(action=F.lit("finalize"), reason=message))
        .otherwise(json(**{"continue": F.lit(False), "stopReason": message, "systemMessage": message}))
    )
    return F.when(decision == "pass", passes).when(decision == "block", block).when(decision == "stop", stop)


#: Paths, resources and declared items that a warning names at most.
SHOWN_OUTSIDE, SHOWN_DECLARED = 3, 6


def scope_warning(paths: Column, resources: Column, scopes: Column, declared: Column) -> Column:
    """What a tool call touches outside the declared scopes and resources, the first of each; null if nothing."""
    held = lambda x, all_: F.exists(all_, lambda s: ((s == ".") & ~F.startswith(x, F.lit("outside:"))) | (x == s) | F.startswith(x, F.concat(s, F.lit("/"))))
    apart = F.filter(paths, lambda p: ~held(p, scopes))
    away = F.filter(F.filter(resources, lambda r: ~F.startswith(r, F.lit("tool:"))), lambda r: ~F.exists(declared, lambda d: (r == d) | F.startswith(r, F.concat(d, F.lit("/")))))
    some = lambda label, xs, n: F.when(F.size(xs) > 0, F.concat(F.lit(label), F.array_join(F.slice(xs, F.lit(1), F.lit(n)), ", ")))
    text = F.concat_ws("; ", some("outside paths: ", apart, SHOWN_OUTSIDE), some("outside resources: ", away, SHOWN_OUTSIDE), some("declared: ", F.concat(scopes, declared), SHOWN_DECLARED))
    return F.when((F.size(apart) > 0) | (F.size(away) > 0), text)


def context_answer(host: Column, text: Column) -> Column:
    """Context for a session as each host wants it: plain text, or JSON with the event's name."""
    named = F.to_json(F.struct(F.struct(F.lit("SessionStart").alias("hookEventName"), text.alias("additionalContext")).alias("hookSpecificOutput")))
    return F.when(host == "cursor", F.to_json(F.struct(text.alias("additional_context")))).when(host == "plain", text).otherwise(named)


def doctor(tools: DataFrame) -> DataFrame:
    """(line) of tools (name, required, version): what is there and what is missing, in order of the name."""
    state = F.when(F.col("version").isNotNull(), F.concat(F.lit("ok "), "name", F.lit(" "), "version")).when(F.col("required"), F.concat(F.lit("missing "), "name")).otherwise(F.concat(F.lit("optional "), "name", F.lit(" not found")))
    return tools.orderBy("name").select(state.alias("line"))
