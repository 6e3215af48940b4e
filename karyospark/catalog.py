"""All registered queries of the gene-order jobs and their SQL."""

from __future__ import annotations

from karyospark.plans import queries_groups, queries_hits, queries_more, queries_pairs, queries_rest

MODULES = [queries_hits, queries_pairs, queries_groups, queries_rest, queries_more]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
