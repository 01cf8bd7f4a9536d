"""Names of the engine's queries, with their Spark plans and their SQL."""

from __future__ import annotations

from folioscope.plans import audits, gaps, golds, layouts, sequences, star, stored, texts, trees, units, verdicts, word_files

FLAGSHIP = "pricing_summary"

_MODULES = (star, sequences, verdicts, trees, texts, layouts, gaps, audits, golds, word_files, stored, units)


def queries():
    """Query functions by name, over all plan modules."""
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    """SQL by query name, over all plan modules."""
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
