"""Search: a collection, AND over metadata keys of OR over values, order, page."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import matching_ids
from .vector import sorted_with_rank

SORTS = {"addedAt": "added_at", "updatedAt": "updated_at", "key": "key"}
DEFAULT_LIMIT = 50
TOP = 10_000  # rows that each task keeps for a page, at most


@dataclass(frozen=True)
class Query:
    """An immutable query; `of` turns it into a DataFrame."""

    collection: str
    filters: dict[str, list[str]] = field(default_factory=dict)
    sort: str = ""
    asc: bool = False
    limit: int | None = None
    offset: int = 0

    def where(self, key: str, *values: str) -> Query:
        return replace(self, filters={**self.filters, key: list(values)})

    def order_by(self, sort: str, asc: bool = True) -> Query:
        return replace(self, sort=sort, asc=asc)

    def page(self, limit: int, offset: int = 0) -> Query:
        return replace(self, limit=limit, offset=offset)

    def matches(self, docs: DataFrame, index: DataFrame | None = None) -> DataFrame:
        """All documents that match, in no order.  With a materialised index the ids come from it by a semi join."""
        here = docs.where(F.col("collection") == self.collection)
        if not self.filters:
            return here
        if any(not v for v in self.filters.values()):
            return here.where(F.lit(False))
        if index is not None:
            ids = matching_ids(index, self.collection, self.filters)
            return here.join(ids, here["id"] == ids["doc_id"], "left_semi")
        for k, values in self.filters.items():
            here = here.where(F.coalesce(F.arrays_overlap(F.col("meta")[k], F.array(*map(F.lit, values))), F.lit(False)))
        return here

    def _by(self) -> list[Column]:
        field_ = SORTS.get(self.sort)
        by = [F.col(field_).asc() if self.asc else F.col(field_).desc()] if field_ else []
        return [*by, F.col("id").asc()]

    def ordered(self, df: DataFrame) -> DataFrame:
        """By the sort field, then by id; unknown or no sort: by id."""
        return df.orderBy(*self._by())

    def of(self, docs: DataFrame, index: DataFrame | None = None, total: bool = False) -> DataFrame:
        """The page that is asked for; with total, the number of all matches beside each row.

        A page is found on its sort columns alone and its few documents are fetched after, so contents are never sorted.
        """
        found = self.matches(docs, index)
        if self.limit is None:
            return self.ordered(found)
        limit = self.limit if self.limit > 0 else DEFAULT_LIMIT
        keys = ["collection", "id"] + ([SORTS[self.sort]] if self.sort in SORTS else [])
        offset = max(0, self.offset)
        if offset + limit <= TOP:
            ids = self.ordered(found.select(*keys)).offset(offset).limit(limit).select("collection", "id")
        else:  # a deep page: no task can hold all rows before it
            ids = sorted_with_rank(found.select(*keys), *self._by()).where(F.col("rank").between(offset + 1, offset + limit)).select("collection", "id")
        small = F.broadcast(ids) if limit <= TOP else ids
        page = docs.where(F.col("collection") == self.collection).join(small, ["collection", "id"], "left_semi")
        if total:
            page = page.crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("total"))))  # one row
        return self.ordered(page)


def get_by_key(docs: DataFrame, aliases: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents under exact spellings (collection, key, lang) of `wanted`, by way of the alias table."""
    ids = aliases.join(wanted.select("collection", "key", "lang").distinct(), ["collection", "key", "lang"]).select("collection", "id", F.col("key").alias("asked_key"), F.col("lang").alias("asked_lang"))
    return ids.join(docs, ["collection", "id"])
