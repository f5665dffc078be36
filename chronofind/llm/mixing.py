"""Mixing sources to target weights.

The words of each source form one stream, cut in blocks of `block_words`; documents find their
place in it by prefix sums over buckets, so that a source with most of the rows is spread
over all tasks. The mix is made of output shards of `SHARD_SLOTS` block slots. A shard's slots are dealt to the
sources by a multinomial draw: each source gets the whole part of its expectation and the slots
that remain are drawn by the fractions, so the counts have the right mean and hardly stray. The
slots of a source are numbered through all shards; slot j takes block perm(j mod n), where perm is
a keyed pseudorandom permutation (a Feistel network with cycle walking), another one each time
round. Blocks and slots are joined by index where the document lies: the inverse permutation gives a block's
slot, and the block is taken if there are that many, so neither slots nor blocks are shuffled. A document's share is
the sum over its blocks.

A block is never taken more than three times, as no target is above three times its source.

Defined cases: a null text has no words; a null source is a source of its own and comes last. Rows
without words stay, with nothing taken. Repeated rows each have their own place in the stream; they are one row
until their places are told, so any number of them may stand in the table.
All sources empty: all targets are 0. An empty table gives an empty result. Rerunning gives the
same rows, however they are dealt; further columns are not read. Texts of any length are counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

BLOCK_WORDS = 16
#: Slots to an output shard (some 17 million words).
SHARD_SLOTS = 1 << 20
#: More sources than this are refused, as their sizes and targets are worked out on the driver.
MAX_SOURCES = 1_000_000
#: Sources whose table is broadcast.
BROADCAST_SOURCES = 100_000
CAP = 3
WEIGHTS = (1, 2, 3)
def targets(sizes: list[int], weights: list[float], cap: float = CAP) -> list[float]:
    """Shares of the sum of sizes by weight, none above cap times its size: the excess goes to the others by weight."""
    out, rest, open_ = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while open_:
        whole = sum(weights[i] for i in open_)
        full = {i for i in open_ if rest * weights[i] / whole > cap * sizes[i]}
        if not full:
            for i in open_:
                out[i] = rest * weights[i] / whole
            break
        for i in full:
            out[i] = float(cap * sizes[i])
        rest -= sum(cap * sizes[i] for i in full)
        open_ -= full
    return out


def shard_counts(expected: np.ndarray, most: np.ndarray, seed: int) -> Iterator[np.ndarray]:
    """Slots by source, for one output shard after the other. expected: of each source, over all shards; most: its limit."""
    total = int(round(float(expected.sum())))
    share = expected / expected.sum() if total > 0 else expected
    done = np.zeros(expected.size, np.int64)
    for k, start in enumerate(range(0, total, SHARD_SLOTS)):
        slots = min(SHARD_SLOTS, total - start)
        counts = np.floor(slots * share).astype(np.int64)
        part = slots * share - counts
        rest = slots - int(counts.sum())
        if rest > 0 and part.sum() > 0:
            counts += np.random.default_rng([seed, k]).multinomial(rest, part / part.sum())
        counts = np.minimum(counts, most - done)
        done += counts
        yield counts


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def permuted(i: np.ndarray, n: int, key: int, rounds: int = 4, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of range(n), or its inverse, at the places i."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = [np.uint64((key * 0x9E3779B9 + r * 0x85EBCA6B) & 0xFFFFFFFFFFFF) for r in range(rounds)]
    x = i.astype(np.uint64)
    todo = np.arange(x.size)
    while todo.size:
        left, right = x[todo] >> half, x[todo] & mask
        for k in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (_mix(left + k) & mask), left
            else:
                left, right = right, left ^ (_mix(right + k) & mask)
        x[todo] = (left << half) | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def times(block: np.ndarray, n: int, slots: int, source: int, seed: int) -> np.ndarray:
    """How often blocks of a source of n blocks are taken by its slots."""
    whole, rest = divmod(slots, n)
    out = np.full(block.size, whole, np.int64)
    if rest:
        out += permuted(block, n, slot_key(seed, source, whole), inverse=True) < rest
    return out


def slot_key(seed: int, source: int, epoch: int) -> int:
    return seed * 1_000_003 + source * 101 + epoch


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes = [len(v.split()) if (v := t.as_py()) else 0 for t in b.column(2)]  # bytes.split() cuts at the contract's separators
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(sizes, pa.int64())], names=["doc_id", "source", "hash", "size"])


#: (document, block) pairs that a task works out at once, and copies of a row to one piece of it.
_PAIRS = 1 << 20
_COPIES = 1 << 12


def _taken(block_words: int, seed: int):
    """Words taken of rows (doc_id, source, hash, size, n, s, start, blocks, slots): n rows, one behind the other from start."""

    def of(start: np.ndarray, size: np.ndarray, s: int, blocks: int, slots: int) -> np.ndarray:
        out = np.zeros(start.size, np.int64)
        first = start // block_words
        n = np.where(size > 0, (start + size - 1) // block_words - first + 1, 0)
        cuts = np.searchsorted(np.cumsum(n), np.arange(_PAIRS, int(n.sum()) + 1, _PAIRS))
        for some in np.split(np.arange(start.size), np.unique(cuts)):
            doc = np.repeat(some, n[some])
            block = np.repeat(first[some] - np.cumsum(n[some]) + n[some], n[some]) + np.arange(doc.size)
            words = np.minimum(start[doc] + size[doc], (block + 1) * block_words) - np.maximum(start[doc], block * block_words)
            out += np.bincount(doc, words * times(block, blocks, slots, s, seed), start.size).astype(np.int64)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, n, s, start, blocks, slots = (b.column(c).to_numpy() for c in ("size", "n", "s", "start", "blocks", "slots"))
            for lo in range(0, int(n.max(initial=0)), _COPIES):
                some = np.clip(n - lo, 0, _COPIES)
                row = np.repeat(np.arange(n.size), some)
                copy = np.arange(row.size) - np.repeat(np.cumsum(some) - some, some) + lo
                at, taken = start[row] + copy * size[row], np.zeros(row.size, np.int64)
                for k in np.unique(s[row]):
                    mine = np.flatnonzero(s[row] == k)
                    taken[mine] = of(at[mine], size[row[mine]], int(k), int(blocks[row[mine[0]]]), int(slots[row[mine[0]]]))
                out = pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "source", "hash", "size", "source_size", "target")], names=["doc_id", "source", "hash", "size", "source_size", "target"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(copy), pa.array(taken)], names=[*out.schema.names, "copy", "taken"])

    return run


def text_hash(text: Column) -> Column:
    """What tells rows of one id, source and size apart."""
    return F.coalesce(F.xxhash64(text.cast("binary")), F.lit(0).cast("long"))


def placed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, hash, size, source_size, target, copy, taken), one row per row of docs; copy numbers those that are equal up to `hash`."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).cast("binary").alias("text"), text_hash(F.col(text_col)).alias("hash"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    counted = rows.mapInArrow(_words, f"doc_id {kinds['doc_id']}, source string, hash long, size long")
    sized = stored(counted.groupBy("doc_id", "source", "hash", "size").agg(F.count("*").alias("n")))
    per = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(per) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    per.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r["size"] for r in per]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(per))])
    blocks = np.array([-(-s // block_words) for s in sizes], np.int64)
    expected = np.array([a * b / s if s else 0.0 for a, b, s in zip(aims, blocks, sizes, strict=True)])
    slots = sum(shard_counts(expected, CAP * blocks, seed), np.zeros(len(per), np.int64))
    known = spark.createDataFrame([(r.source, i, sizes[i], aims[i], max(1, int(blocks[i])), int(slots[i])) for i, r in enumerate(per)], "_source string, s int, source_size long, target double, blocks long, slots long")
    known = F.broadcast(known) if len(per) <= BROADCAST_SOURCES else known

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * parts, sum(r.n for r in per) // 20_000 + 1)
    every = sized.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    every = every.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "hash", "size"), F.lit(buckets)).cast("int"))
    words = F.col("size") * F.col("n")
    # rows without words take no place
    some = every.filter("size > 0")
    offsets = some.groupBy("s", "_bucket").agg(F.sum(words).alias("_in"))
    offsets = offsets.select("s", "_bucket", (F.sum("_in").over(Window.partitionBy("s").orderBy("_bucket")) - F.col("_in")).alias("_before"))
    w = Window.partitionBy("s", "_bucket").orderBy("doc_id", "hash", "size")
    some = some.withColumn("start", F.sum(words).over(w.rowsBetween(Window.unboundedPreceding, 0)) - words)
    some = some.join(offsets, ["s", "_bucket"]).withColumn("start", F.col("start") + F.col("_before")).drop("_before")
    every = some.unionByName(every.filter("size = 0").withColumn("start", F.lit(0).cast("long"))).drop("_bucket")
    # many equal rows are cut in pieces that any task can take
    pieces = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(16 * _COPIES).cast("long")), lambda a: F.struct(a.alias("from"), F.least(F.lit(16 * _COPIES), F.col("n") - a).alias("n")))
    every = every.withColumn("_p", F.explode(pieces)).withColumn("n", F.col("_p.n")).withColumn("start", F.col("start") + F.col("_p.from") * F.col("size"))
    every = every.withColumn("hash", F.struct("hash", F.col("_p.from").alias("from"))).drop("_p")
    schema = f"doc_id {kinds['doc_id']}, source string, hash struct<hash:bigint,from:bigint>, size long, source_size long, target double, copy long, taken long"
    out = every.mapInArrow(_taken(block_words, seed), schema)
    return out.select("doc_id", "source", "hash.hash", "size", "source_size", "target", (F.col("copy") + F.col("hash.from")).alias("copy"), "taken")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), one row per row of docs. weights repeat over the sources in code point order."""
    return placed(docs, weights, block_words, seed, id_col, text_col, source_col).drop("hash", "copy")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
