"""Items: one row per path version, with its tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofind.functions.analyzer import MAX_TERMS, TOKENIZERS
from chronofind.functions.scalars import HEAD, packed_size

MAX_INDEXED_BYTES = 1 << 20
BINARY_OVERRIDE = r".(c|cpp|h|cs|js|vb|txt|html|aspx|ascx|htm|css)$"
#: Properties with a column of their own, and the one that is not indexed.
OWN = ("svn:externals", "svn:mime-type", "svn:mergeinfo")

_DEFAULTS = {
    "content": "string", "message": "string", "externals": "string", "author": "string", "mime": "string", "size_bytes": "long",
    "ts": "timestamp", "is_dir": "boolean", "props": "map<string,string>", "rev_first": "int", "rev_last": "int",
}


def indexable(path: Column, size: Column, is_dir: Column, mime: Column, override: str = BINARY_OVERRIDE) -> Column:
    """Whether content is indexed: a file of at most 1 MiB that is text, or is taken for text by its name."""
    sized = ~F.coalesce(is_dir, F.lit(False)) & (size > 0) & (size <= MAX_INDEXED_BYTES)
    return F.coalesce(sized & (path.rlike(f"(?i){override}") | mime.isNull() | F.startswith(mime, F.lit("text/"))), F.lit(False))


def from_properties(rows: DataFrame) -> DataFrame:
    """Splits off externals and mime type from a property map; values in lower case."""
    props = F.transform_values(F.coalesce("props", F.create_map().cast("map<string,string>")), lambda _, v: F.lower(v))
    rows = rows.withColumn("props", props)
    rows = rows.withColumn("externals", F.try_element_at("props", F.lit(OWN[0]))).withColumn("mime", F.try_element_at("props", F.lit(OWN[1])))
    return rows.withColumn("props", F.map_filter("props", lambda k, _: ~k.isin(*OWN)))


#: Tokenizers of the fields, by their names in TOKENIZERS; others may be given.
FIELDS = {"path": "path", "content": "simple", "message": "simple", "externals": "path"}


def analysed(rows: DataFrame, cap: int = MAX_TERMS, kind: Column | None = None, tokenizers: dict[str, str] | None = None) -> DataFrame:
    """Items with ids, lower-cased authors, packed sizes and token arrays. Missing columns become null, missing
    revisions HEAD."""
    return tokenised(prepared(rows, kind), cap, tokenizers)


def prepared(rows: DataFrame, kind: Column | None = None) -> DataFrame:
    """Items without their token arrays, which take more room than the texts."""
    for name, kind_of in _DEFAULTS.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, (F.lit(HEAD) if name.startswith("rev_") else F.lit(None)).cast(kind_of))
    rows = rows.withColumn("author", F.lower("author")).withColumn("kind", F.lit("item") if kind is None else kind)
    if "id" not in rows.columns:
        rows = rows.withColumn("id", F.when(F.startswith("path", F.lit("$")), F.col("path")).otherwise(F.concat("path", F.lit("@"), F.col("rev_first").cast("string"))))
    return rows.withColumn("size_packed", F.when(~F.coalesce("is_dir", F.lit(False)), packed_size(F.col("size_bytes"))))


def tokenised(rows: DataFrame, cap: int = MAX_TERMS, tokenizers: dict[str, str] | None = None) -> DataFrame:
    return rows.withColumns({
        **{f"{field}_tokens": TOKENIZERS[name](F.col(field), cap) for field, name in (FIELDS | (tokenizers or {})).items()},
        "prop_tokens": F.transform_values(F.coalesce("props", F.create_map().cast("map<string,string>")), lambda _, v: TOKENIZERS["simple"](v, cap)),
    })


def revision_items(revisions: DataFrame) -> DataFrame:
    """The items that stand for whole revisions, without tokens: searchable by author and message."""
    rows = revisions.select(F.concat(F.lit("$Revision "), F.col("revision").cast("string")).alias("path"), F.col("revision").cast("int").alias("rev_first"), F.col("revision").cast("int").alias("rev_last"), "author", "ts", "message")
    return prepared(rows, F.lit("revision"))
