"""Line and text rules: credentials, SELECT *, weak cryptography."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Credential formats, wildcard projections and weak cryptography or TLS (fixed patterns).
CREDENTIAL = r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,255}|sk_(?:live|prod)_[A-Za-z0-9]{16,}|-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"
SELECT_ALL = r"(?i)\bSELECT\s+\*\s+FROM\b"
WEAK_CRYPTO = (
    r"(?i)createHash\s*\(\s*[\"'](?:md5|sha1)[\"']|hashlib\.(?:md5|sha1)\s*\(|MessageDigest\.getInstance\s*\(\s*[\"']SHA-?1[\"']"
    r"|rejectUnauthorized\s*:\s*false|verify\s*=\s*false|SSLv3|PROTOCOL_TLSv1\b|TLSv1(?:\.0)?[\"']"
)
#: An extension, off unless asked for: assignments of long hexadecimal tokens.
TOKEN_ASSIGNMENT = r"(?i)\btoken\s*=\s*[\"'][0-9a-f]{32,}[\"']"
REDACTED = "credential-like value redacted"


def credential_lines(lines: DataFrame, extension: bool = False) -> DataFrame:
    """Lines with a credential outside comments; the value never leaves this filter."""
    pattern = f"{CREDENTIAL}|{TOKEN_ASSIGNMENT}" if extension else CREDENTIAL
    comment = F.col("text").rlike("^\\s*(#|//|;)")
    return lines.where(F.col("text").rlike(pattern) & ~comment).drop("text").withColumn("evidence", F.lit(REDACTED))


def line_of(text: Column, prefix_length: Column) -> Column:
    """Line number of the place after so many characters."""
    prefix = F.substring(text, F.lit(1), prefix_length)
    return (F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit(""))) + 1).cast("long")


def match_lines(files: DataFrame, key: str, text: str, pattern: str, shown: bool = False) -> DataFrame:
    """(key, line) of every match of a pattern without groups; with ``shown`` what matched, too."""
    whole = f"(?s)(.*?)(?:({pattern})|\\z)"
    gaps, hits = F.regexp_extract_all(text, F.lit(whole), F.lit(1)), F.regexp_extract_all(text, F.lit(whole), F.lit(2))
    start = F.expr("named_struct('at', 0, 'out', CAST(array() AS array<struct<at:int,hit:string>>))")

    def step(acc: Column, p: Column) -> Column:
        at = acc["at"] + F.length(p["gap"])
        out = F.when(p["hit"] != "", F.concat(acc["out"], F.array(F.struct(at.alias("at"), p["hit"].alias("hit"))))).otherwise(acc["out"])
        return F.struct((at + F.length(p["hit"])).alias("at"), out.alias("out"))

    places = F.aggregate(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), start, step, lambda a: a["out"])
    rows = files.where(F.col(text).rlike(pattern)).select(key, text, F.explode(places).alias("x"))
    return rows.select(key, line_of(F.col(text), F.col("x.at")).alias("line"), *([F.col("x.hit").alias("hit")] if shown else []))


def select_all_lines(files: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """Every ``SELECT * FROM``, with the line it starts on."""
    return match_lines(files, key, text, SELECT_ALL)


def redacted(text: Column) -> Column:
    return F.regexp_replace(text, CREDENTIAL, "[redacted]")
