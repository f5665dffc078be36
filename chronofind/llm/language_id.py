"""Language identification by rank-order profiles.

A profile is the list of the most frequent letter n-grams (1 to 3 letters, word edges marked), in
order of frequency. Profiles are learned from all texts of a language; a document's own profile is
compared with each by the out-of-place distance: the sum, over the document's n-grams, of how far
their rank is from the rank in the language profile, an n-gram that the profile lacks counting as
far as can be. The nearest language wins.

Counting is distributed: a task sums what it has read per language and n-gram, the sums meet in one
aggregation, and only the profiles (languages x `profile_size` rows) reach the driver.

Defined cases: `und` with score 0 if the text is null or has no letter, or if nothing was learned.
Languages at equal distance: the smaller name. N-grams of equal count rank by code points. Rows
with a null text or language teach nothing; a row with a null id counts as held out. Repeated rows
count as often as they stand. Texts of any length are read whole. Empty tables give empty results; further columns are not
read, and `predict` returns them, but for those that its own two replace.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

PROFILE_SIZE = 400
#: More languages than this are refused, which bounds what is sent to the tasks.
MAX_LANGUAGES = 1000
UNDETERMINED = "und"

_WORDS = re.compile(r"[^\W\d_]+")
_CHUNK = 400_000


def normalise(text: str) -> str:
    """Lower-cased letter runs with an underscore before, between and after; '' without letters."""
    words = "_".join(_WORDS.findall(text.lower()))
    if not words.replace("_", "").isalpha():  # digits of other kinds, such as superscripts
        words = "_".join(w for w in "".join(c if c.isalpha() else "_" for c in words).split("_") if w)
    return f"_{words}_" if words else ""


def codes(text: str) -> np.ndarray:
    """The n-grams of a normalised text, each packed in 63 bits."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    edge = c == ord("_")
    one = c[~edge]
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.concatenate([one, two[~(edge[:-1] & edge[1:])], three[~edge[1:-1]]])


def ranked(text: str, size: int) -> np.ndarray:
    """The most frequent n-grams of a normalised text, in order."""
    grams, n = np.unique(codes(text), return_counts=True)
    return grams[np.argsort(-n, kind="stable")[:size]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: dict[str, list[str]] = defaultdict(list)
    held: dict[str, int] = defaultdict(int)
    sums: dict[str, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)

    def merged(some: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        grams, at = np.unique(np.concatenate([g for g, _ in some]), return_inverse=True)
        return grams, np.bincount(at, weights=np.concatenate([n for _, n in some])).astype(np.int64)

    def take(lang: str) -> None:
        text = "".join(waiting.pop(lang))
        held[lang] = 0
        sums[lang].append(np.unique(codes(text), return_counts=True))
        if len(sums[lang]) > 8:
            sums[lang] = [merged(sums[lang])]

    for b in batches:
        for text, lang in zip(b.column(0), b.column(1), strict=True):
            norm, lang = normalise(text.as_py()), lang.as_py()
            if norm:
                waiting[lang].append(norm)
                held[lang] += len(norm)
                if held[lang] > _CHUNK:
                    take(lang)
    for lang in list(waiting):
        take(lang)
    for lang, some in sums.items():
        grams, n = merged(some)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * grams.size), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])


class Profiles:
    """Language names in order, the n-grams of all profiles and their ranks by language."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size = size
        self.langs = sorted({lang for lang, _, _ in rows})
        self.grams = np.array(sorted({g for _, g, _ in rows}), np.int64)
        self.ranks = np.full((self.grams.size + 1, len(self.langs)), -1, np.int32)
        at = {lang: i for i, lang in enumerate(self.langs)}
        where = np.searchsorted(self.grams, [g for _, g, _ in rows]) if rows else []
        for (lang, _, rank), g in zip(rows, where, strict=True):
            self.ranks[g, at[lang]] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        norm = normalise(text) if text else ""
        if not norm or not self.langs:
            return UNDETERMINED, 0.0
        grams = ranked(norm, self.size)
        where = np.searchsorted(self.grams, grams)
        where[where == self.grams.size] = self.grams.size - 1
        where = np.where(self.grams[where] == grams, where, self.grams.size)
        ranks = self.ranks[where]
        far = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(grams.size)[:, None])).sum(axis=0)
        best = int(np.argmin(far))
        return self.langs[best], 1.0 - float(far[best]) / (self.size * grams.size)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", profile_size: int = PROFILE_SIZE) -> Profiles:
    """Profiles from all rows of docs whose text and language are not null."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < profile_size).select("lang", "gram", "rank")
    found = top.limit(MAX_LANGUAGES * profile_size + 1).collect()
    if len(found) > MAX_LANGUAGES * profile_size:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return Profiles([tuple(r) for r in found], profile_size)


def predict(docs: DataFrame, profiles: Profiles, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with two more columns, which take the place of columns of their names."""
    at = docs.columns.index(text_col)
    kept = [i for i, c in enumerate(docs.columns) if c not in (pred_col, score_col)]
    schema = T.StructType([*(docs.schema.fields[i] for i in kept), T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [profiles.predict(t.as_py()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn(docs.filter(~held_out()))
    found = predict(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
