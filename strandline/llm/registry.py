"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from strandline.llm import queries_pages, queries_text

QUERIES = queries_text.QUERIES | queries_pages.QUERIES
ORACLES = queries_text.ORACLES | queries_pages.ORACLES
