"""Change log to items with validity intervals.

Changes are (revision, change, path) with change one of Add, Modify, Replace, Delete, and is_copy.
A version of a path is valid from the revision that opens it to the one before the next event of the
path, or to HEAD. Deleting (or replacing) a folder is an event of everything below it; whatever was not
open is not touched by that. Everything is joins and one window over paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofind.functions.scalars import HEAD

#: Event order inside one revision of a path: closing comes before opening.
KINDS = ("Delete", "Replace", "Modify", "Add")


def checked_kind(change: Column) -> Column:
    return F.when(change.isin(*KINDS), change).otherwise(F.raise_error(F.concat(F.lit("unknown change "), change)))


def flatten(revisions: DataFrame) -> DataFrame:
    """(revision, change, path, is_copy) of a log with a `changes` array."""
    return revisions.select("revision", F.inline("changes"))


def ancestors(path: Column) -> Column:
    """All folders above a path, without the root: equality on them takes the place of prefix comparisons."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n > 2, F.transform(F.sequence(F.lit(2), n - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def path_filter(changes: DataFrame, pattern: str | None = "/tags/") -> DataFrame:
    """Drops the changes whose path the regular expression is found in."""
    return changes if not pattern else changes.filter(~F.col("path").rlike(pattern))


def children(paths: DataFrame, parents: DataFrame) -> DataFrame:
    """(parent columns, child): what lies below each parent, at any depth. paths: (path), parents: (path, ...)."""
    below = paths.select(F.col("path").alias("child"), F.explode(ancestors(F.col("path"))).alias("path"))
    return parents.withColumn("path", F.rtrim(F.col("path"), F.lit("/"))).join(below, "path")


def expand_copies(changes: DataFrame, listing: DataFrame) -> DataFrame:
    """Adds an Add for everything below an added or replaced copy. listing: (revision, path), what exists at the revisions of copies."""
    copies = changes.filter("is_copy and change in ('Add', 'Replace')").select("revision", "path")
    below = listing.select("revision", F.col("path").alias("child"), F.explode(ancestors(F.col("path"))).alias("path"))
    more = copies.join(below, ["revision", "path"]).select("revision", F.lit("Add").alias("change"), F.col("child").alias("path"), F.lit(True).alias("is_copy"))
    return _explicit_first(changes.withColumn("_implied", F.lit(0)).unionByName(more.withColumn("_implied", F.lit(1))))


def expand_sources(changes: DataFrame, known: DataFrame) -> DataFrame:
    """Adds an Add for everything below the source of a copied folder. changes: with copy_from and copy_revision (null: the
    revision before); known: (path, rev_first, rev_last), versions of what lies below the sources."""
    copies = changes.filter("is_copy and copy_from is not null and change in ('Add', 'Replace')")
    copies = copies.select("revision", F.col("path").alias("target"), F.rtrim(F.col("copy_from"), F.lit("/")).alias("path"), F.coalesce("copy_revision", F.col("revision") - 1).alias("at"))
    below = known.select(F.col("path").alias("child"), "rev_first", "rev_last", F.explode(ancestors(F.col("path"))).alias("path"))
    found = copies.join(below, "path").filter("rev_first <= at and at <= rev_last")
    child = F.concat("target", F.substr("child", F.length("path") + 1))
    more = found.select("revision", F.lit("Add").alias("change"), child.alias("path"), F.lit(True).alias("is_copy"))
    return _explicit_first(changes.select("revision", "change", "path", "is_copy").withColumn("_implied", F.lit(0)).unionByName(more.withColumn("_implied", F.lit(1))))


def expand_deletes(changes: DataFrame) -> DataFrame:
    """Adds a Delete of every path below a deleted or replaced one; `_implied` marks them."""
    opened = changes.filter("change <> 'Delete'").select("path").distinct()
    gone = changes.filter("change in ('Delete', 'Replace')").select("revision", "path")
    more = children(opened, gone).select("revision", F.lit("Delete").alias("change"), F.col("child").alias("path"), F.lit(False).alias("is_copy"))
    return _explicit_first(changes.withColumn("_implied", F.lit(0)).unionByName(more.withColumn("_implied", F.lit(1))))


def _explicit_first(changes: DataFrame) -> DataFrame:
    """Of a revision's changes of one path: those that stand in the log if there are any, each kind once."""
    w = Window.partitionBy("path", "revision")
    changes = changes.withColumn("_least", F.min("_implied").over(w)).filter("_implied = _least")
    return changes.groupBy("revision", "path", "change").agg(F.max("is_copy").alias("is_copy"))


def intervals(events: DataFrame) -> DataFrame:
    """(path, rev_first, rev_last, ...): one row per version. events: (revision, change, path, ...), at most one per kind."""
    order = F.array_position(F.array(*map(F.lit, KINDS)), checked_kind(F.col("change")))
    w = Window.partitionBy("path").orderBy("revision", order)
    closed = F.lead("revision").over(w) - 1
    out = events.withColumn("rev_last", F.coalesce(closed, F.lit(HEAD)).cast("int")).filter("change <> 'Delete'")
    # a version that is closed in the revision that opened it was never there
    return out.filter("rev_last >= revision").withColumn("rev_first", F.col("revision").cast("int")).drop("revision", "change", "is_copy")


def highest_revision(items: DataFrame) -> DataFrame:
    """(path, revision): the first revision of the version that is live, 0 where the last one is closed."""
    last = F.max_by("rev_last", "rev_first")
    return items.groupBy("path").agg(F.when(last == HEAD, F.max("rev_first")).otherwise(F.lit(0)).cast("int").alias("revision"))


#: Levels of dyadic stretches that revisions are cut in: the largest revision is below 2 ^ LEVELS.
LEVELS = 27


def as_of(items: DataFrame, revisions: DataFrame) -> DataFrame:
    """Every item version once for each of the revisions at which it is valid. revisions: (revision), each once.

    An interval is cut in at most 2 * LEVELS dyadic stretches and a revision lies in one stretch of each level, so the two
    meet by equality, at most once."""
    cut = F.expr(f"""aggregate(sequence(0, {LEVELS}), struct(rev_first as l, rev_last + 1 as r, cast(array() as array<struct<level: int, node: int>>) as cover), (s, i) -> if(s.l >= s.r, s, struct(
        cast((s.l + 1) div 2 as int) as l, cast(s.r div 2 as int) as r,
        concat(s.cover, filter(array(struct(i as level, s.l as node), struct(i as level, s.r - 1 as node)), (x, k) -> if(k = 0, s.l, s.r) % 2 = 1)) as cover)), s -> s.cover)""")
    stretches = F.explode(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda i: F.struct(i.alias("level"), F.call_function("shiftright", F.col("revision"), i).cast("int").alias("node"))))
    wanted = revisions.select("revision", stretches.alias("_stretch"))
    return items.withColumn("_stretch", F.explode(cut)).join(wanted, "_stretch").drop("_stretch")


def chunks(start: int, stop: int, interval: int) -> list[tuple[int, int]]:
    return [(a, min(a + interval - 1, stop)) for a in range(start, stop + 1, interval)]
