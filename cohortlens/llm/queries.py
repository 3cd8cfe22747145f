"""The queries of this subpackage and the SQL of those that have some."""

from __future__ import annotations

from importlib import import_module

MODULES = ["toxicity", "mixing", "sharding", "bpe", "near_dup_vectors", "ann", "simhash", "html_text", "license_scan", "pii", "fill_in_middle", "piece_spans", "centroids"]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in getattr(import_module(f"{__package__}.{m}"), "ORACLE_SQL", {}).items()}
