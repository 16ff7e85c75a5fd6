"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("topk", "toxicity", "decontaminate", "chat", "neardup", "sharding", "lines", "mixing", "warc", "token_counts", "licenses", "periodic", "whitening")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f".{m}", __package__).QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in import_module(f".{m}", __package__).ORACLE_SQL.items()}
