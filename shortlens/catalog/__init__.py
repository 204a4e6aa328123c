from shortlens.catalog import clustering, relational, tables, text  # noqa: F401
from shortlens.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
