"""All queries outside the corpus subpackage."""

from __future__ import annotations

from . import features, jobs, more, rules, state
from .dialect import oracle

_ALL = features.QUERIES | jobs.QUERIES | more.QUERIES | rules.QUERIES | state.QUERIES
QUERIES = {k: run for k, (run, _) in _ALL.items()}
ORACLE_SQL = {k: oracle(sql) for k, (_, sql) in _ALL.items() if sql}
