"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from unitloom.llm import decontaminate, hmm, html_text, licenses, mixing, neighbours, simhash, suffix_dedup, toxicity, urls

MODULES = (decontaminate, hmm, html_text, licenses, mixing, neighbours, simhash, suffix_dedup, toxicity, urls)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
