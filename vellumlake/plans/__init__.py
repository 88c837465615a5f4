"""The engine's queries over the test tables, each with the same in SQL."""

from .queries import QUERIES, SQL, flagship

__all__ = ["QUERIES", "SQL", "flagship"]
