"""All queries of the library's own operators."""

from ranklode.plans import extra, learning, more, preparation, retrieval
from ranklode.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "extra", "learning", "more", "preparation", "retrieval"]
