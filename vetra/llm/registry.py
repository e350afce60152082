"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

_QUERIES = {
    "op1_packing": "packing",
    "op2_language": "language",
    "op3_license_scan": "licenses",
    "op4_substring_dedup": "rlz",
    "op5_secrets": "secrets",
    "op6_warc_revisit": "warc",
    "op7_suffix_dedup": "suffix",
    "op8_fingerprints": "fingerprint",
    "op9_decontaminate": "decontaminate",
    "op10_minhash": "minhash",
    "op11_quality": "quality",
    "op12_merkle": "merkle",
    "op13_collocations": "collocations",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, module in _QUERIES.items():
        sql = getattr(importlib.import_module(f"{__package__}.{module}"), "ORACLE_SQL", {}).get(name)
        if sql:
            out[name] = sql
    return out
