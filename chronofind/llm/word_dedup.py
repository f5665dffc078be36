"""Substring dedup over words by level-wise doubling.

A window of `window` words is repeated only if all shorter windows in it are. The levels are its
length halved and halved again (50, 25, 13); the shortest comes first, and only where a window of
one level is repeated in another document are the windows of twice its length looked at, until
the full length is reached. At the levels below the last, one shorter window stands for each full window:
the one with the smallest hash inside it, which depends on the window's words alone, so that equal
windows always ask for the same one and few are sent. At the last level all windows that are left are
compared, and each shard learns the smallest id that holds each of them.

A word's hash is its keyed BLAKE2b digest, and the last level compares windows by 128 bits made of both halves of
the digests, so no text can be written that is taken for another (and of 100 TB of words no two windows are
likely to be: about 4e-13).

Defined cases: a null text has no words. Rows of one id never remove each other's words, a null id
is larger than all others and null ids don't remove each other. Texts shorter than the window keep
everything. Repeated rows are each returned. An empty table gives an empty result; further columns
are not read.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table
from .shards import SENT, Known, Shard, answered, mix, nothing_sent, runs, send, sharded, sliding_min, where_in, window_hashes

WINDOW = 50
#: Windows below this many words are not halved any more.
SHORTEST = 20
_KEY = b"word windows"


def levels(window: int) -> list[int]:
    out = [window]
    while out[0] >= SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return out


class _Numbers(dict):
    """Numbers of words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Words:
    """The words of a shard's texts: two hashes and the text number of each."""

    def __init__(self, shard: Shard):
        numbers = _Numbers()
        found = [np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in (shard.text(i).split() for i in range(shard.n))]
        digests = b"".join(hashlib.blake2b(w, digest_size=16, key=_KEY).digest() for w in numbers)
        digest = np.frombuffer(digests, np.uint64).reshape(-1, 2)
        every = np.concatenate([np.zeros(0, np.int64), *found])
        self.hash, self.check = (np.ascontiguousarray(digest[every, i]) for i in (0, 1))
        self.doc = np.repeat(np.arange(shard.n), [f.size for f in found]) if found else np.zeros(0, np.int64)
        self.n = every.size


class Level:
    """The windows of a shard at one level: which are whole, and the key that stands for each."""

    def __init__(self, words: Words, window: int, length: int):
        n = max(0, words.n - window + 1)
        hashes = window_hashes(words.hash, length)
        self.key = mix(sliding_min(hashes, window - length + 1))[:n]
        self.doc = words.doc[:n]
        self.valid = words.doc[window - 1 :][:n] == self.doc

    def left(self, known: np.ndarray) -> np.ndarray:
        """Windows whose key is among the known."""
        first, last = runs(self.key, self.doc, self.valid)
        ok = where_in(self.key[first], known)[1]
        mark = np.zeros(self.key.size + 1, np.int64)
        mark[first[ok]] += 1
        np.subtract.at(mark, last[ok] + 1, 1)
        return np.cumsum(mark[:-1]) > 0


def _ask(window: int, length: int, shorter: int | None, buckets: int):
    """A shard's keys at one level, of the windows that the level below has left."""

    def run(_: tuple, docs: pa.Table, back: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return nothing_sent()
        shard = Shard(docs, back)
        words = Words(shard)
        level = Level(words, window, length)
        if shorter is not None:
            level.valid &= Level(words, window, shorter).left(Known(back).keys)
        first, _ = runs(level.key, level.doc, level.valid)
        whole = length == window
        checks = window_hashes(words.check, window)[first] if whole and first.size else np.zeros(0, np.uint64)
        return send(docs.column("shard")[0].as_py(), level.key[first], shard.ids[level.doc[first]], buckets, whole, checks)

    return run


def _apply(window: int):
    def run(_: tuple, docs: pa.Table, back: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string())})
        shard = Shard(docs, back)
        words = Words(shard)
        level = Level(words, window, window)
        known = Known(back)
        at, there = known.find(level.key, window_hashes(words.check, window)[: level.key.size])
        gone = there & level.valid
        gone[gone] = known.ids[at[gone]] < shard.ids[level.doc[gone]]
        mark = np.zeros(words.n + 1, np.int64)
        first = np.flatnonzero(gone)
        mark[first] += 1
        np.subtract.at(mark, first + window, 1)
        keep = np.cumsum(mark[:-1]) == 0
        cuts = np.searchsorted(words.doc, np.arange(shard.n + 1))

        def result(text: bytes, mine: np.ndarray | None) -> tuple[int, int, str]:
            """mine: the words that stay; None: all."""
            kept = text.split()
            n = len(kept) if mine is None else int(mine.sum())
            return len(kept), len(kept) - n, hashlib.sha256(b" ".join(kept if n == len(kept) else compress(kept, mine))).hexdigest()

        found = {int(u): result(shard.text(i), keep[cuts[i] : cuts[i + 1]]) for i, u in enumerate(shard.number)}
        rows: list[list] = [[], [], []]
        for i, (u, copy) in enumerate(zip(shard.of.tolist(), shard.copy.tolist(), strict=True)):
            if copy:
                text = shard.texts[i].as_py()
                n = len(text.split())
                out = (n, n, _EMPTY) if n >= window else result(text, None)
            else:
                out = found[u]
            for have, x in zip(rows, out, strict=True):
                have.append(x)
        return pa.table({"doc_id": shard.doc_id, "n_words": pa.array(rows[0], pa.int64()), "n_removed": pa.array(rows[1], pa.int64()), "kept_sha256": pa.array(rows[2], pa.string())})

    return run


_EMPTY = hashlib.sha256(b"").hexdigest()


def dedup_words(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row per row of docs."""
    rows, copies, short, n = sharded(docs, id_col, text_col, 2 * window - 1)
    dealt = rows.groupBy("shard")
    back, shorter = copies, None
    for length in levels(window):
        sent = dealt.cogroup(back.groupBy("shard")).applyInArrow(_ask(window, length, shorter, n), SENT)
        back, shorter = answered(sent).unionByName(copies), length
    found = dealt.cogroup(back.groupBy("shard")).applyInArrow(_apply(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    words = F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(f"({WORD})"), 1)
    short = short.select("doc_id", words.alias("words"))
    return found.unionByName(short.select("doc_id", F.size("words").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.sha2(F.array_join("words", " "), 256).alias("kept_sha256")))


def op5_word_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_words(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
word AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
win AS (SELECT r, doc_id, i, array_to_string(w[i : i + 49], ' ') AS k FROM (SELECT *, unnest(generate_series(1, len(w) - 49)) AS i FROM d)),
low AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
hit AS (SELECT r, i FROM win JOIN low USING (k) WHERE m < doc_id),
kept AS (
  SELECT word.r, j, word, coalesce(count(hit.i) OVER (PARTITION BY word.r ORDER BY j ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) = 0 AS keep
  FROM word LEFT JOIN hit ON hit.r = word.r AND hit.i = j
),
told AS (SELECT r, count(*) FILTER (NOT keep) AS n, string_agg(word, ' ' ORDER BY j) FILTER (keep) AS text FROM kept GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN told USING (r)
"""
