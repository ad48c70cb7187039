"""All queries of the library outside the llm part."""

from __future__ import annotations

from skein.plans import analysis_queries, fact_queries, pipeline_queries, rule_queries

MODULES = (analysis_queries, fact_queries, pipeline_queries, rule_queries)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
