"""Imports the modules that register queries."""

from tablewise.llm import backoff_queries, bpe_queries, embeddings_queries, exact_queries, html_queries, licenses_queries, mixing_queries, negatives_queries, quality_queries, ranking_queries, simhash_queries, substring_queries, urls_queries  # noqa: F401
from tablewise.llm.registry import ORACLES, QUERIES  # noqa: F401
