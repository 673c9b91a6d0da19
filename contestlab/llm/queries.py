"""The queries opN_<name> of this subpackage and the SQL that says the same where SQL can."""

from __future__ import annotations

import importlib

#: Modules with QUERIES and ORACLES.
MODULES = ("chat", "exact", "jaccard", "language", "lexical", "mixing", "packing", "pages", "pitman_yor", "quality", "resampling", "transport", "warc")


def queries() -> dict:
    found = {}
    for m in MODULES:
        found |= importlib.import_module(f"contestlab.llm.{m}").QUERIES
    return found


def oracle_sql() -> dict:
    found = {}
    for m in MODULES:
        found |= getattr(importlib.import_module(f"contestlab.llm.{m}"), "ORACLES", {})
    return found
