"""A corpus pipeline: language ID, near-duplicates, benchmark decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` applies them to `documents` in
order, each stage's result being written in the shared folder and read again as the next one's
input. All stages but the last return the columns of their input; the last one returns the mixed corpus: every
text that is left, with the words that the mix takes of it.

Defined cases, for all stages: null and repeated ids are judged row by row; empty tables give empty results; texts of any
length are read whole; further columns travel along, whatever their names. A null or empty text is in no language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofind.llm import decontamination, language_id, mixing, pii, simhash
from chronofind.llm.common import discard, stored, table

#: A text whose n-grams are this far from every profile is in none of the languages: short texts share few n-grams with
#: the profile of their own language, long ones of other languages in the same script score up to about 0.25.
MIN_LANGUAGE_SCORE = 0.05
MIN_LONG_SCORE = 0.3
LONG_LETTERS = 200


def _fresh(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def _row_key() -> Column:
    """Names a row's text and id; rows of equal keys are equal in both (a null text counts as an empty one)."""
    text = F.sha2(F.coalesce("text", F.lit("")), 256)
    return F.sha2(F.concat(text, F.lit("|"), F.coalesce(F.sha2(F.col("doc_id").cast("string"), 256), F.lit(""))), 256)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language can be told; profiles are learned from the rows that have one.

    A null or empty text, or one without letters, goes. Repeated rows are judged alike."""
    pred, score = _fresh(docs, "_pred"), _fresh(docs, "_score")
    found = language_id.predict(docs, language_id.learn(docs), pred_col=pred, score_col=score)
    letters = F.length(F.regexp_replace("text", r"\P{L}+", ""))
    # letters are counted only where it matters
    near = F.when(F.col(score) >= MIN_LONG_SCORE, True).when(F.col(score) < MIN_LANGUAGE_SCORE, False).otherwise(letters < LONG_LETTERS)
    return found.filter((F.col(pred) != language_id.UNDETERMINED) & near).select(docs.columns)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: that of the smallest id (null ids last), then of the smallest key.

    Rows are named by text and id, so rows that share an id, or have none, are judged one by one. Texts meet the
    kept keys in one join, whose order also serves to drop equal rows."""
    key, order = _fresh(docs, "_row"), _fresh(docs, "_order")
    rows = docs.withColumn(key, _row_key())
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.col(key).alias("row"))
    found = simhash.near_duplicates(rows.withColumn(order, place), id_col=order)
    kept = stored(found.select(F.col("component_id.row").alias(key)).distinct())
    return rows.join(kept.hint("merge"), key, "left_semi").dropDuplicates([key]).select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that hold a passage of a test item; other texts under the same id, or under none, stay."""
    key = _fresh(docs, "_row")
    rows = docs.withColumn(key, _row_key())
    found = decontamination.contaminated(rows, table(spark, sf_dir, "benchmark"), id_col=key)
    found = stored(found.select(F.col("doc_id").alias(key)).distinct())
    return rows.join(found, key, "left_anti").select(docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows the text. All rows stay; equal rows get equal texts."""
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, text, size, source_size, target, taken): each text, its size in words and how many the mix takes.

    Rows without words stay, with nothing taken. Rows that are equal in id, source and text each have their own share."""
    key = F.to_json(F.struct("doc_id", "source", "hash"))
    told = ("size", "source_size", "target", "taken")
    places = stored(mixing.placed(docs).select(key.alias("key"), "copy", *told))
    repeated = places.filter("copy = 1").select("key")
    rows = docs.select("doc_id", "source", "text", mixing.text_hash(F.col("text")).alias("hash")).withColumn("key", key).drop("hash")
    # texts are dealt by key once; only rows that are repeated are numbered, to meet their copies
    first = rows.hint("merge").join(places.join(repeated, "key", "left_anti").drop("copy"), "key", "left")
    alone = first.filter("taken is not null")
    equal = first.filter("taken is null").select(*rows.columns)
    equal = equal.withColumn("copy", (F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0))) - 1).cast("long"))
    equal = equal.join(places, ["key", "copy"])
    names = ("doc_id", "source", "text", *told)
    return alone.select(*names).unionByName(equal.select(*names))


STAGES = [
    ("language ID", language_stage),
    ("SimHash near-dedup", near_dup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("mixing", mixing_stage),
]

#: SQL has no Smith-Waterman, BK-trees or permutations: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return docs
