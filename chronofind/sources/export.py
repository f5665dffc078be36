"""Result exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofind.functions import scalars as S


def export_rows(items: DataFrame) -> DataFrame:
    """Path, File, Author, Modified, Revision, Size in path order."""
    size = F.coalesce(S.unpacked_size(F.col("size_packed")), F.lit(0))
    ordered = items.orderBy(F.lower("path"), "id")
    return ordered.select(F.col("path").alias("Path"), S.file_name(F.col("path")).alias("File"), F.col("author").alias("Author"), S.timestamp_text(F.col("ts")).alias("Modified"), S.pretty_revision(F.col("rev_first")).alias("Revision"), size.alias("Size"))


def target_rows(items: DataFrame, external_uri: str) -> DataFrame:
    return items.orderBy(F.lower("path"), "id").select(F.concat(F.lit(external_uri), "path").alias("target"))


def write_tsv(items: DataFrame, path: str) -> None:
    export_rows(items).write.csv(path, sep="\t", header=True, quote="", escapeQuotes=False)


def write_targets(items: DataFrame, external_uri: str, path: str) -> None:
    target_rows(items, external_uri).write.text(path)
