"""Cross-study tabular analytics on Spark DataFrames."""

from assaylens.api import Repository
from assaylens.errors import DataError, QueryError

__all__ = ["DataError", "QueryError", "Repository"]
