"""All queries of the core library, with their SQL."""

from __future__ import annotations

from granaria.plans import audits, curation, evaluation, files, modelling, quality

MODULES = (quality, audits, curation, files, evaluation, modelling)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def sql() -> dict:
    return {name: text for module in MODULES for name, text in module.SQL.items()}
