"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from datelore.llm import bpe, chat, decontaminate, jaccard, language, licenses, packing, prefixes, shards, spelling, toxicity, urls, vectors

_MODULES = (vectors, urls, shards, language, toxicity, chat, decontaminate, licenses, jaccard, bpe, packing, spelling, prefixes)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in getattr(module, "ORACLE_SQL", {}).items()}
