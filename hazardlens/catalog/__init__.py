"""The registered queries: each pairs a DataFrame job over the given tables with the SQL that checks it."""

from hazardlens.catalog.registry import all_queries, all_sql  # noqa: F401
