"""Scalar column helpers over text, paths and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space of all scripts, which Java's plain ``\s`` isn't: as a set of characters, and as a pattern.
BLANKS = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SPACE = "[\\t-\\r \\x85\\xA0\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def ascii_lower(s: Column) -> Column:
    return F.translate(s, _UPPER, _LOWER)


def lines_of(text: Column) -> Column:
    """Lines without their ends: a final line break opens no line, an empty text has none."""
    body = F.regexp_replace(text, "\\n\\z", "")
    whole = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))
    return F.transform(whole, lambda s: F.when(F.endswith(s, F.lit("\r")), F.left(s, F.length(s) - 1)).otherwise(s))


def trimmed(s: Column) -> Column:
    return F.btrim(s, F.lit(BLANKS))


def normalized_line(s: Column) -> Column:
    """Trimmed, white space collapsed; null for blank, comment and import lines."""
    t = trimmed(s)
    skip = (t == "") | t.rlike("^(//|#|/\\*|\\*|import |use |package )")
    return F.when(~skip, F.regexp_replace(t, f"{SPACE}+", " "))


def identifiers(s: Column) -> Column:
    return F.filter(F.split(s, "[^A-Za-z0-9_]+"), lambda x: x.rlike("^[A-Za-z_]"))


def compact_code(s: Column) -> Column:
    return F.lower(F.regexp_replace(s, f"{SPACE}+", ""))


def contains_name(s: Column, name: str) -> Column:
    """The name stands in ``s`` between characters that are no part of names."""
    return s.rlike(f"(^|[^A-Za-z0-9_-])\\Q{name}\\E($|[^A-Za-z0-9_-])")


def quoted_value(s: Column) -> Column:
    """What stands between the first two double quotes, or else the first two single ones."""
    double = F.when(s.rlike('"[^"]*"'), F.regexp_extract(s, '"([^"]*)"', 1))
    return F.coalesce(double, F.when(s.rlike("'[^']*'"), F.regexp_extract(s, "'([^']*)'", 1)))


def without_strings(s: Column) -> Column:
    """Quoted regions blanked, an open one to the end; backslashes mean nothing."""
    return F.regexp_replace(s, "(\"[^\"]*(\"|$)|'[^']*('|$)|`[^`]*(`|$))", " ")


def contains_call(s: Column, name: str) -> Column:
    return ascii_lower(F.regexp_replace(s, f"{SPACE}+", "")).rlike(f"(?<![a-z0-9_])\\Q{name}\\E\\(")


def assignment(s: Column) -> Column:
    """struct(left, right) of ``left := right`` or ``left = right``, or null."""
    walrus = F.when(F.instr(s, ":=") > 0, F.struct(F.substring_index(s, ":=", 1).alias("left"), F.regexp_replace(s, "^(?s).*?:=", "").alias("right")))
    plain = "(?s)^(.*?)(?<![=!<>])=(?![=>])(.*)$"
    single = F.when(s.rlike(plain), F.struct(F.regexp_extract(s, plain, 1).alias("left"), F.regexp_extract(s, plain, 2).alias("right")))
    return F.coalesce(walrus, single)


def terminal_name(s: Column) -> Column:
    return F.try_element_at(F.filter(F.split(s, "[.:>]"), lambda x: x != ""), F.lit(-1))


def normalized_method(s: Column) -> Column:
    return F.regexp_replace(F.replace(ascii_lower(s), F.lit("_"), F.lit("")), "async$", "")


def has_receiver(s: Column, names: list[str]) -> Column:
    return F.arrays_overlap(F.split(s, "[.:$>-]"), F.array(*(F.lit(n) for n in names)))


#: Verbs that say nothing of a function's domain (fixed values).
DOMAIN_VERBS = ["build", "create", "delete", "export", "handle", "import", "process", "update"]


def domain_tokens(name: Column) -> Column:
    """Sorted distinct lower-case parts of a camel or snake name: four letters or more, no common verb."""
    parts = F.split(F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2")), "[^a-z0-9]+")
    return F.array_sort(F.array_distinct(F.filter(parts, lambda p: (F.length(p) >= 4) & ~p.isin(DOMAIN_VERBS))))


def truncated(s: Column, limit: int) -> Column:
    """At most ``limit`` characters, then an ellipsis if something went."""
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit), F.lit("…"))).otherwise(s)


def truncated_within(s: Column, limit: int) -> Column:
    """At most ``limit`` characters, the ellipsis included."""
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit - 1), F.lit("…"))).otherwise(s)


def truncated_output(s: Column, limit: int = 8000, marker: str = "\n… output truncated") -> Column:
    """Command output: trimmed if it is short, else cut and marked."""
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit), F.lit(marker))).otherwise(trimmed(s))


def portable_path(path: Column, root: str | None = None) -> Column:
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    if root:
        p = F.when(F.startswith(p, F.lit(root.rstrip("/") + "/")), F.substring(p, len(root.rstrip("/")) + 2, 1 << 30)).otherwise(p)
    return F.regexp_replace(p, "^(\\./)+", "")


def check_rule_id(name: Column) -> Column:
    return F.concat(F.lit("FG-CHECK-"), F.upper(F.regexp_replace(name, "[^A-Za-z0-9]", "-")))


def command_slug(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9-]", "_")


def sarif_level(severity: Column) -> Column:
    return F.when(severity == "error", "error").when(severity == "warning", "warning").otherwise("note")


def version_triple(s: Column) -> Column:
    """struct(major, minor, patch) of ``[v]1.2[.3][-suffix]``, or null."""
    pattern = "^v?(\\d+)\\.(\\d+)(?:\\.(\\d+))?(?:[-+].*)?$"
    part = lambda k: F.regexp_extract(s, pattern, k).try_cast("long")
    return F.when(s.rlike(pattern), F.struct(part(1).alias("major"), part(2).alias("minor"), F.coalesce(part(3), F.lit(0)).cast("long").alias("patch")))


def valid_session_id(s: Column) -> Column:
    return s.rlike("^[A-Za-z0-9._-]{1,128}$")


def normalized_resource(s: Column) -> Column:
    """``kind:value`` with a lower kind and no slash at the end; null if malformed."""
    kind, value = F.trim(F.lower(F.substring_index(s, ":", 1))), F.regexp_replace(F.trim(F.regexp_replace(s, "^[^:]*:", "")), "/+$", "")
    ok = (F.instr(s, ":") > 0) & (kind != "") & (value != "") & (F.length(s) <= 500) & ~s.rlike("\\p{Cntrl}")
    return F.when(ok, F.concat(kind, F.lit(":"), value))


def in_scope(path: Column, scope: Column) -> Column:
    """``.`` holds every path; else the path is the scope or lies under it."""
    return (scope == ".") | (path == scope) | F.startswith(path, F.concat(scope, F.lit("/")))


def first_command_token(command: Column) -> Column:
    tokens = F.filter(F.split(F.trim(command), "\\s+"), lambda t: ~F.contains(t, F.lit("=")) & ~t.isin("env", "test") & (t != ""))
    return F.try_element_at(tokens, F.lit(1))


def task_profile(s: Column) -> Column:
    p = F.translate(F.lower(F.trim(s)), "_", "-")
    return F.when(p.rlike("^[a-z0-9-]{1,64}$"), p)


def patch_paths(command: Column) -> Column:
    """Paths named by the file headers of a patch, sorted and distinct."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(command, F.lit("(?m)^\\*\\*\\* (?:Add|Update|Delete) File: (.+)$"), F.lit(1))))
