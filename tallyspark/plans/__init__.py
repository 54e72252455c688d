"""The query catalogue and the SQL that says the same."""

from tallyspark.plans import file_queries, handler_queries, layout_queries, page_queries, parse_queries, period_queries, run_queries, store_queries, upload_queries
from tallyspark.plans.catalogue import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "file_queries", "handler_queries", "layout_queries", "page_queries", "parse_queries", "period_queries", "run_queries", "store_queries", "upload_queries"]
