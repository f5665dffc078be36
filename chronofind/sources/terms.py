"""The inverted index of a store: which items of which folder hold a term.

A table of terms covers a set of item folders and never changes. Its rows (field, term, place, ids) are made from blocks of
items and lie block by block in the order of field and term, so that a query reads the pages of its own words. Folders that a
commit has put in since are scanned; rows of folders that are gone are passed over. What the terms of a query
leave over is tested again on the items, so that answers are those of a scan.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofind.operators.grouping import inverted
from chronofind.operators.search import HEAD, Index, revision_filter
from chronofind.plans.compiler import POSTED, All, Any, Has, tokens_of
from chronofind.plans.parser import Group
from chronofind.plans.phrase import wildcard_regex

from .store import Store

#: A store whose covered folders hold no more bytes than this is scanned: that costs less than a look at the terms.
SCAN_BELOW = 256 << 20
#: A query that finds no more items than this reads them by their ids; one that finds more reads the folders they are in.
BY_ID = 1000
_TERMS = "field string, term string, place string, ids array<string>"
#: Bytes of a row group of a table of terms.
_GROUP = 16 << 20
_PLACE = r"((?:live|closed)/[^/]+(?:/bucket=\d+)?)/[^/]+$"


def index_terms(store: Store) -> None:
    """Makes a table of terms for the item folders that have none. Each task inverts the items it reads, block by block:
    nothing is shuffled, sorted by strings or read twice."""
    m = store.manifest()
    current = {*m["live"].values(), *m["closed"]}
    tables = [t for t in m.get("inverted", []) if current & set(t["items"])]
    missing = sorted(current - {f for t in tables for f in t["items"]})
    if missing:
        place = F.regexp_extract("_metadata.file_path", _PLACE, 1).alias("place")
        rows = store.parquet(missing).select(place, "id", *[tokens_of(f).alias(f) for f in POSTED])
        folder = f"terms/v{m['version'] + 1}-{uuid.uuid4().hex[:8]}"
        rows.mapInArrow(inverted, _TERMS).write.option("parquet.block.size", _GROUP).parquet(f"{store.root}/{folder}")
        tables.append({"folder": folder, "items": missing, "bytes": sum(map(store.size, missing))})
    if tables != m.get("inverted", []) or "terms" in m:
        m["inverted"] = tables
        m.pop("terms", None)  # tables with a row for each item of a term, as they were made before
        m["version"] += 1
        store.put(m)


class StoredIndex(Index):
    """What a store holds when this is made, asked by its terms. with_terms: if some of it has none and it is not scanned anyway, they
    are made when a query first asks for them."""

    def __init__(self, store: Store, strict: bool = True, by_id: int = BY_ID, scan_below: int = SCAN_BELOW, with_terms: bool = False):
        self.store, self.by_id, self.scan_below = store, by_id, scan_below
        m = self._open()
        current = {*m["live"].values(), *m["closed"]}
        self.with_terms = with_terms and bool(self.uncovered) and sum(map(store.size, current)) > scan_below
        super().__init__(self._read(sorted(current)), m["properties"].get("single_revision", False), strict)

    def _open(self) -> dict:
        m = self.store.manifest()
        current = {*m["live"].values(), *m["closed"]}
        tables = m.get("inverted", [])
        listed = {f for t in tables for f in t["items"]}
        self.covered, self.uncovered = sorted(listed & current), sorted(current - listed)
        self.scanned = sum(t["bytes"] for t in tables) <= self.scan_below
        self.terms = self.store.parquet([t["folder"] for t in tables])
        if self.terms is not None and listed - current:
            self.terms = self.terms.filter(F.col("place").isin(self.covered))
        return m

    def _make_terms(self) -> None:
        if self.with_terms:
            self.with_terms = False
            index_terms(self.store)
            self._open()

    def _read(self, folders: list[str]) -> DataFrame | None:
        found = self.store.parquet(folders)
        return None if found is None else found.drop("bucket")

    def count_terms(self, field: str, expressions: list[str]) -> int:
        if field in POSTED:
            self._make_terms()
        if self.terms is None or field not in POSTED:
            return super().count_terms(field, expressions)
        found = self.terms.filter(_matches(field, expressions)).select("term")
        if self.uncovered:
            found = found.unionByName(self._read(self.uncovered).select(F.explode(tokens_of(field)).alias("term")).filter(F.col("term").rlike("(?s)" + "|".join(expressions))))
        return found.distinct().count()

    def matching(self, tree: Group, first: int = HEAD, last: int | None = None) -> DataFrame:
        found = self.narrowed(tree)
        when = None if self.single_revision else revision_filter(first, last)
        return (found if when is None else found.filter(when)).filter(self.compiler.predicate(tree))

    def narrowed(self, tree: Group) -> DataFrame:
        """The items that may be found, by the terms that the query can't do without."""
        if self.scanned and not self.with_terms:
            return self.items
        need = self.compiler.needs(tree)
        if need is not None:
            self._make_terms()
        if need is None or self.terms is None or self.scanned:
            return self.items
        tests: dict[Has, Column] = {}
        _collect(need, tests)
        rows = self.terms.filter(reduce(or_, tests.values(), F.lit(False)))
        rows = rows.select("place", F.explode("ids").alias("id"), *[test.alias(f"t{i}") for i, test in enumerate(tests.values())])
        held = rows.groupBy("place", "id").agg(F.lit(True).alias("any"), *[F.bool_or(f"t{i}").alias(f"t{i}") for i in range(len(tests))])
        held = held.filter(_formula(need, list(tests)))
        counts = held.groupBy("place").count().collect()  # folders, not items
        places = [r[0] for r in counts]
        few = [r[0] for r in held.select("id").collect()] if sum(r[1] for r in counts) <= self.by_id else None
        narrow = self._read(places)
        if narrow is None:
            narrow = self.items.filter(F.lit(False))
        elif few is not None:
            narrow = narrow.filter(F.col("id").isin(few))
        return narrow.unionByName(self._read(self.uncovered)) if self.uncovered else narrow


def _matches(field: str, expressions: list[str]) -> Column:
    """Terms of a field by expressions; what all begin with is compared first, which the files can be asked for."""
    begins = [F.startswith(F.col("term"), F.lit(re.match(r"\^(\w*)", e)[1])) for e in expressions]
    return (F.col("field") == field) & reduce(or_, begins) & F.col("term").rlike("(?s)" + "|".join(expressions))


def _collect(need: Has | All | Any, into: dict[Has, Column]) -> None:
    if isinstance(need, Has):
        into[need] = _matches(need.field, [wildcard_regex(w) for w in need.words]) if need.wild else (F.col("field") == need.field) & F.col("term").isin(list(need.words))
    else:
        for part in need.parts:
            _collect(part, into)


def _formula(need: Has | All | Any, order: list[Has]) -> Column:
    if isinstance(need, Has):
        return F.col(f"t{order.index(need)}")
    parts = [_formula(p, order) for p in need.parts]
    return reduce(and_, parts, F.lit(True)) if isinstance(need, All) else reduce(or_, parts, F.lit(False))
