"""Keeping an index current: micro-batches of revisions.

Each batch turns its changes into versions together with the live items of the paths it touches, and
upserts them. Ids are deterministic, so replaying a batch changes nothing; revisions that the
index has already are passed over, and a revision that comes after a later one was indexed is an error.
Changes are structs (change, path, is_copy), with copy_from and copy_revision where the log names the
sources of copies: what lay below a copied folder is added with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronofind.functions.scalars import HEAD
from chronofind.operators.history import ancestors, expand_deletes, expand_sources, intervals, path_filter
from chronofind.operators.items import prepared, revision_items
from chronofind.sources.store import Store
from chronofind.sources.terms import index_terms

COMMIT_INTERVAL = 1000
OPTIMIZE = 25

Enrich = Callable[[DataFrame], DataFrame]


def versions(changes: DataFrame, live: DataFrame | None) -> DataFrame:
    """(path, rev_first, rev_last) that a batch of changes opens or closes. live: (path, rev_first) open before it."""
    changes = changes.select("revision", "change", "path", "is_copy")
    if live is not None:
        # of the live versions only those that a change can touch: of its path or below it
        names = changes.select(F.col("path").alias("_name")).distinct()
        live = live.withColumn("_name", F.explode(F.concat(F.array("path"), ancestors(F.col("path"))))).join(names, "_name", "left_semi").select("path", "rev_first").distinct()
        # each takes part as the event that opened it
        before = live.select(F.col("rev_first").alias("revision"), F.lit("Add").alias("change"), "path", F.lit(False).alias("is_copy"))
        changes = changes.unionByName(before)
    return intervals(expand_deletes(changes))


class LateRevision(ValueError):
    pass


def with_copies(changes: DataFrame, store: Store, exclude: str | None) -> DataFrame:
    """changes with what lies below copied folders; copies of copies are followed until nothing is added. What a round adds
    is written beside the index, so that plans don't grow with the rounds."""
    plain = changes.select("revision", "change", "path", "is_copy")
    if "copy_from" not in changes.columns or not changes.filter("is_copy and copy_from is not null").limit(1).count():
        return plain
    with store.scratch() as written:
        changes = written(changes)
        sources = written(changes.filter("is_copy and copy_from is not null").select(F.rtrim(F.col("copy_from"), F.lit("/")).alias("_name")).distinct())
        items = store.items()
        old = None if items is None else written(_below(items.filter("kind = 'item'"), sources))
        live = None if old is None else old.filter(F.col("rev_last") == HEAD).select("path", "rev_first")
        count, more = 0, changes.select("revision", "change", "path", "is_copy")
        while True:
            known = written(_below(versions(more, live), sources))
            if old is not None:  # versions of the index end where the batch closes them
                known = known.unionByName(old.join(known.select("path", "rev_first"), ["path", "rev_first"], "left_anti"))
            more = written(path_filter(expand_sources(changes, known), exclude))
            n = more.count()
            if n == count:
                return store.kept(more)
            count = n


def _below(found: DataFrame, sources: DataFrame) -> DataFrame:
    names = F.explode(ancestors(F.col("path"))).alias("_name")
    return found.select("path", "rev_first", "rev_last", names).join(sources, "_name", "left_semi").select("path", "rev_first", "rev_last").distinct()


def apply_batch(store: Store, revisions: DataFrame, enrich: Enrich | None = None, exclude: str | None = "/tags/", properties: dict | None = None) -> int:
    """Indexes the revisions that the store does not have. Returns the last one."""
    done = store.properties()["revision"]
    if done and not store.properties()["single_revision"]:  # an index without closed versions can't tell
        again = revisions.filter(F.col("revision") <= done).select(F.col("revision").cast("int").alias("rev_first"))
        if again.limit(1).count():
            late = again.join(store.items().filter("kind = 'revision'").select("rev_first"), "rev_first", "left_anti").agg(F.min("rev_first")).first()[0]
            if late is not None:
                raise LateRevision(f"revision {late} comes after revision {done}")
    revisions = revisions.filter(F.col("revision") > done)
    last = revisions.agg(F.max("revision")).first()[0]
    if last is None:
        return done
    changes = with_copies(path_filter(revisions.select("revision", F.inline("changes")), exclude), store, exclude)
    live = store.live()
    live = None if live is None else live.filter("kind = 'item'").select("path", "rev_first")
    opened = versions(changes, live)
    if live is not None:  # versions that the batch did not touch stay as they are
        opened = opened.join(live.withColumn("rev_last", F.lit(HEAD)), ["path", "rev_first", "rev_last"], "left_anti")
    rows = prepared(enrich(opened) if enrich else opened)
    rows = rows.unionByName(revision_items(revisions), allowMissingColumns=True)
    store.upsert(rows, {"revision": int(last)} | (properties or {}))
    return int(last)


def run(spark: SparkSession, log: DataFrame, store: Store, checkpoint: str, enrich: Enrich | None = None, exclude: str | None = "/tags/", optimize: int = OPTIMIZE) -> StreamingQuery:
    """Starts a query that indexes a streaming log and ends when all that is there has been read."""

    def batch(df: DataFrame, number: int) -> None:
        with store.writing():
            apply_batch(store, df, enrich, exclude)
        if optimize and (number + 1) % optimize == 0:
            store.compact()
            index_terms(store)

    return log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
