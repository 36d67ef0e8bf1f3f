"""Registered queries: name -> (Spark query, equivalent SQL or None)."""

from __future__ import annotations


def all_checks() -> dict:
    from trapline.checks import context_checks, curation_checks, mining_checks, source_checks, vector_checks

    checks = {}
    for module in (curation_checks, context_checks, mining_checks, vector_checks, source_checks):
        repeated = checks.keys() & module.CHECKS.keys()
        if repeated:
            raise ValueError(f"registered twice: {sorted(repeated)}")
        checks.update(module.CHECKS)
    return checks
