"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, embedding_join, fertility, hard_negatives, licences, line_dedup, middle, mixing, quality, sharding, simhash, topk_search, url_filters

MODULES = [fertility, line_dedup, simhash, embedding_join, url_filters, bpe, sharding, mixing, quality, licences, middle, hard_negatives, topk_search]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
