"""Search over items: revision modes, hits, order, pages."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from chronofind.functions import scalars as S
from chronofind.operators.rank import ranked
from chronofind.plans.compiler import Compiler, content_words, tokens_of
from chronofind.plans.parser import Group, normalise, parse

HEAD, ALL = S.HEAD, S.ALL
PAGE = 16


def revision_filter(first: int = HEAD, last: int | None = None) -> Column | None:
    """None: all revisions. HEAD: what is live. Else: what is valid somewhere between the two."""
    last = first if last is None else last
    if first == ALL:
        return None
    if first == HEAD:
        return F.col("rev_last") == HEAD
    if first > HEAD:
        return F.lit(False)
    return (F.col("rev_last") >= first) & (F.col("rev_first") <= min(last, HEAD))


def parse_range(text: str) -> tuple[int, int]:
    """The revision box: `all`, `head`, one number, or two numbers in any order (the second may be `head`)."""
    if re.search(r"\ball\b", text, re.IGNORECASE):
        return ALL, ALL
    numbers = sorted(int(x) for x in re.findall(r"\d{1,8}", text)[:2])
    head = re.search(r"\bhead\b", text, re.IGNORECASE)
    if not numbers:
        return HEAD, HEAD
    if head:
        return numbers[0], HEAD
    return numbers[0], numbers[-1]


def from_url(parameters: dict[str, str]) -> tuple[str, int, int]:
    """(query, first, last) of a search address: parameters q, f and l; both revisions are head unless they are given."""
    return parameters.get("q", ""), int(parameters.get("f", HEAD)), int(parameters.get("l", HEAD))


class Index:
    """A DataFrame of analysed items that can be asked."""

    def __init__(self, items: DataFrame, single_revision: bool = False, strict: bool = True):
        """strict: a wildcard that stands for more than MAX_WILDCARD_TERMS terms is an error."""
        self.items, self.single_revision = items, single_revision
        self.compiler = Compiler(self.count_terms, strict)

    def count_terms(self, field: str, expressions: list[str]) -> int:
        """Different terms of a field that match, over the whole index."""
        found = F.filter(F.array_distinct(tokens_of(field)), lambda t: t.rlike("(?s)" + "|".join(expressions)))
        return self.items.select(F.explode(found).alias("t")).agg(F.count_distinct("t")).first()[0]

    def query(self, text: str, first: int = HEAD, last: int | None = None, normalised: bool = False) -> DataFrame:
        """The items that a query finds. normalised: the query is trimmed, lower-cased and gets forward slashes first."""
        tree = parse(normalise(text) if normalised else text)
        return self.matching(tree, first, last)

    def matching(self, tree: Group, first: int = HEAD, last: int | None = None) -> DataFrame:
        found = self.items
        when = None if self.single_revision else revision_filter(first, last)
        if when is not None:  # a plain comparison, pushed down to the files, goes first
            found = found.filter(when)
        return found.filter(self.compiler.predicate(tree))

    def by_relevance(self, text: str, first: int = HEAD, last: int | None = None) -> DataFrame:
        """The items that a query finds with their `score`, the best first, by its plain content words; ties by id."""
        tree = parse(text)
        words = sorted(w[1:-1] if w.startswith("^") else w for w in content_words(tree)[0])
        scored = Index(ranked(self.items, words), self.single_revision) if words else Index(self.items.withColumn("score", F.lit(0.0)), self.single_revision)
        return scored.matching(tree, first, last).orderBy(F.desc("score"), "id")

    def hit_by_id(self, item_id: str) -> dict | None:
        rows = self.items.filter(F.col("id") == item_id).limit(2).collect()
        return rows[0].asDict(recursive=True) if len(rows) == 1 else None

    def result(self, text: str, first: int = HEAD, last: int | None = None) -> Result:
        began = time.monotonic()
        found = self.query(text, first, last)
        n = found.count()
        return Result(text, n, (time.monotonic() - began) * 1000, found)


@dataclass
class Result:
    query: str
    total: int
    elapsed_ms: float
    items: DataFrame

    def hits(self) -> DataFrame:
        return hits(self.items)


def hits(items: DataFrame) -> DataFrame:
    """What is shown of an item."""
    size = F.coalesce(S.unpacked_size(F.col("size_packed")), F.lit(0))
    return items.select(
        "id", "path", S.folder(F.col("path")).alias("folder"), S.file_name(F.col("path")).alias("file"), "author",
        F.col("rev_first").alias("revision"), S.pretty_revision(F.col("rev_first")).alias("rev_first"), S.pretty_revision(F.col("rev_last")).alias("rev_last"),
        size.alias("size_in_bytes"), S.size_display(size).alias("size"), S.timestamp_text(F.col("ts")).alias("modified"),
        F.concat(F.coalesce("author", F.lit("")), F.lit(": "), F.coalesce(S.timestamp_text(F.col("ts")), F.lit("")), F.lit(" - "), S.pretty_revision(F.col("rev_first")), F.lit(":"), S.pretty_revision(F.col("rev_last")), F.lit(" - "), S.size_display(size)).alias("summary"),
        S.link(F.col("id")).alias("link"), F.concat(S.pretty_revision(F.col("rev_first")), F.lit(":"), S.pretty_revision(F.col("rev_last"))).alias("range"),
    )


def by_path(items: DataFrame) -> DataFrame:
    return items.orderBy(F.lower("path"), "id")


def page(items: DataFrame, number: int, size: int = PAGE) -> DataFrame:
    """The number-th page, from 0, in path order."""
    return by_path(items).offset(number * size).limit(size)


def viewed(items: DataFrame) -> DataFrame:
    """What the item view shows: content only of text of at most 512 KiB, nothing but the message of a revision."""
    text = F.col("mime").isNull() | F.startswith("mime", F.lit("text"))
    shown = (F.col("size_bytes") <= 512 * 1024) & text & (F.col("kind") != "revision")
    return items.select("id", "path", "author", "ts", "message", F.when(F.col("kind") != "revision", F.col("props")).alias("props"), F.when(F.coalesce(shown, F.lit(False)), F.col("content")).alias("content"))


def truncated(items: DataFrame, cap: int) -> tuple[DataFrame, Observation]:
    """items, and an observation that counts those whose content reached the term cap while they are written."""
    seen = Observation("truncated")
    return items.observe(seen, F.count_if(F.size("content_tokens") >= cap).alias("n")), seen
