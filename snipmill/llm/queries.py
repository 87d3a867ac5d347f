"""The registered queries of this subpackage, with their SQL twins."""

from __future__ import annotations

from snipmill.llm import (
    byte_pieces, embedding_pairs, fill_middle, language_model, mixing, pieces, quality, simhash, term_search, token_counts,
    token_files, toxicity, warc,
)

_MODULES = [token_files, pieces, warc, token_counts, language_model, quality, mixing, toxicity, simhash, embedding_pairs,
            byte_pieces, fill_middle, term_search]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
