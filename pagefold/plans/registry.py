"""All queries of the engine by name, with their SQL."""

from __future__ import annotations

from pagefold.plans import analyses, answers, candidates, ensembles, extraction, fields, geometric, scalars, sequences

MODULES = (ensembles, geometric, scalars, sequences, analyses, extraction, candidates, fields, answers)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: q for m in MODULES for name, q in m.SQL.items()}
