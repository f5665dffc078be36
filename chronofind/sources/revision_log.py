"""Reading a change log: the connector protocol and its Parquet form.

A repository is two tables: `revisions` (revision, author, ts, message, changes array of (change, path,
is_copy)) and `nodes` (path, revision, is_dir, size, content, props), one row per path and revision
that changed it.
"""

from __future__ import annotations

import uuid
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofind.operators.history import children, flatten


class Repository(Protocol):
    def revisions(self, first: int, last: int) -> DataFrame: ...

    def nodes(self) -> DataFrame: ...


class ParquetRepository:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def revisions(self, first: int, last: int) -> DataFrame:
        """The log between two revisions, in the order that they are given; no nulls in author and message."""
        low, high = sorted((first, last))
        log = self.spark.read.parquet(f"{self.path}/revisions").filter(F.col("revision").between(low, high))
        log = log.withColumn("author", F.coalesce("author", F.lit(""))).withColumn("message", F.coalesce("message", F.lit("")))
        return log.orderBy(F.col("revision").asc() if first <= last else F.col("revision").desc())

    def changes(self, first: int, last: int) -> DataFrame:
        return flatten(self.revisions(first, last))

    def nodes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/nodes")

    def youngest(self) -> int:
        return self.spark.read.parquet(f"{self.path}/revisions").agg(F.coalesce(F.max("revision"), F.lit(0))).first()[0]

    def repository_id(self) -> str:
        """The same for one place, whenever it is asked."""
        return str(uuid.uuid5(uuid.NAMESPACE_URL, self.path))

    def message(self, revision: int) -> str:
        row = self.revisions(revision, revision).select("message").first()
        return row[0] if row else ""

    def children(self, path: str, live: DataFrame) -> DataFrame:
        """Everything below a path among the live items, itself excluded."""
        return children(live.select("path").distinct(), self.spark.createDataFrame([(path,)], "path string")).select(F.col("child").alias("path"))


def enriched(versions: DataFrame, nodes: DataFrame, revisions: DataFrame) -> DataFrame:
    """Versions with metadata and content of their first revision and that revision's author, time and message.
    Paths with `:`, `$` or a backslash have no metadata. Content whose line ends differ, although a property fixes them, is empty."""
    kinds = sum((F.col("content").rlike(x).cast("int") for x in (r"\r\n", r"(?<!\r)\n", r"\r(?!\n)")), F.lit(0))
    mixed = F.try_element_at("props", F.lit("svn:eol-style")).isNotNull() & (kinds > 1)
    nodes = nodes.withColumn("content", F.when(F.coalesce(mixed, F.lit(False)), F.lit("")).otherwise(F.col("content")))
    known = nodes.select("path", F.col("revision").alias("rev_first"), "is_dir", F.col("size").alias("size_bytes"), F.regexp_replace("content", "^﻿", "").alias("content"), "props")
    known = known.filter(~F.col("path").rlike(r"[:$\\]"))
    log = revisions.select(F.col("revision").alias("rev_first"), "author", "ts", "message")
    return versions.join(known, ["path", "rev_first"], "left").join(log, "rev_first", "left")
