"""Registered queries with their SQL."""

from docloom.plans import archive_queries, codec_queries, content_queries, document_queries, file_queries, layout_queries, number_queries, pdf_queries, shape_queries, text_queries, value_queries  # noqa: F401
from docloom.plans.registry import ORACLES, QUERIES  # noqa: F401
