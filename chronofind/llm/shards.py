"""Documents in shards, window hashes, and the exchange of hashes between shards and buckets.

Both substring operators use it. A shard is a group of documents of some megabytes; it is where
texts are read, always whole. What the shards must compare is sent as sorted arrays of hashes, one
array per (bucket, shard), each hash once per shard, so a passage that a third of all documents
hold is one entry per shard. A bucket tells every shard which of its hashes other documents hold too.

There are as many buckets as shards, and a shard's size grows with the root of the corpus (4 MB up to
some 30 GB of text, 240 MB for 100 TB), so the rows that are exchanged, one per shard and bucket, are
at most one for each `ROW_BYTES` bytes of text: in proportion to it, and some 64 hashes each.

Documents are dealt by id and text, so neither null nor repeated ids share a task. Texts too short
to hold a window are not dealt at all. Of equal texts only one is looked at: a text that stands
under a smaller id too is removed as a whole, which `copies` tells the shards.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_BYTES = 4 << 20
#: Bytes of text for each row of an exchange, at least.
ROW_BYTES = 576
#: A hash that more documents hold than this is hot.
HOT = 1 << 14
LAST = np.iinfo(np.int64).max
_COPY = -1


def sharded(docs: DataFrame, id_col: str, text_col: str, least: int, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Rows (shard, doc_id, text as bytes, sha) of texts of `least` bytes or more, their copies, the rows (doc_id, text)
    of shorter texts, and the number of shards."""
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    short, rows = every.filter(size < least), every.filter(size >= least)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(-(-total // max(shard_bytes, math.isqrt(ROW_BYTES * total))), min(parts, (total >> 16) + 1))
    sha = F.unhex(F.sha2("text", 256))
    rows = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("shard"), "doc_id", "text", sha.alias("sha"))
    # one row per text that stands more than once, with its smallest id and the shards that hold it
    many = rows.groupBy("sha").agg(F.min(F.coalesce("doc_id", F.lit(int(LAST)))).alias("first"), F.count("*").alias("n"), F.collect_set("shard").alias("shards"))
    many = many.filter("n > 1").select(F.explode("shards").alias("shard"), "sha", F.encode(F.col("first").cast("string"), "UTF-8").alias("first"))
    none = F.lit(b"")
    copies = many.select("shard", F.lit(_COPY).alias("bucket"), F.col("sha").alias("keys"), none.alias("checks"), none.alias("hot"), F.col("first").alias("ids"))
    return rows, copies, short, n


class Shard:
    """The documents of a shard in order of id and text. Equal texts are one, and those that stand under a smaller id
    elsewhere are left out: `data` has the others' bytes end to end.

    Of each row, `of` is the number of its text and `copy` whether it is a copy of a text with a smaller id; of each text
    in `data`, `ids` is its id and `number` what its rows have in `of`."""

    def __init__(self, group: pa.Table, back: pa.Table):
        order = pc.sort_indices(group, sort_keys=[("doc_id", "ascending"), ("sha", "ascending")])
        group = group.take(order).combine_chunks()
        self.doc_id = group.column("doc_id")
        rows = np.array(pc.fill_null(self.doc_id, LAST).to_numpy(), np.int64)
        self.texts = group.column("text")
        sha = group.column("sha").to_pylist()
        known: dict[bytes, int] = {}
        self.of = np.fromiter((known.setdefault(s, len(known)) for s in sha), np.int64, len(sha))
        first = np.unique(self.of, return_index=True)[1]
        low = rows[first] if first.size else np.zeros(0, np.int64)
        elsewhere = {s: int(i) for b, s, i in zip(*(back.column(c).to_pylist() for c in ("bucket", "keys", "ids")), strict=True) if b == _COPY}
        least = np.array([min(int(x), elsewhere.get(s, LAST)) for s, x in zip(known, low, strict=True)], np.int64)
        self.copy = rows > least[self.of] if rows.size else np.zeros(0, bool)
        self.number = np.flatnonzero(low == least)
        self.ids = low[self.number]
        some = [self.texts[int(i)].as_py() for i in first[self.number]]
        self.offsets = np.cumsum([0, *map(len, some)])
        self.data = np.frombuffer(b"".join(some), np.uint8)
        self.n = len(some)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _pair(a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15 + 2 * step) + b)


def window_hashes(items: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of `length` neighbouring items (64-bit), by doubling."""
    if items.size < length:
        return np.zeros(0, np.uint64)
    out, done, power, size = None, 0, items, 1
    while True:
        if length & size:
            if out is None:
                out, done = power, size
            else:
                m = items.size - done - size + 1
                out, done = _pair(out[:m], power[done : done + m], done), done + size
        if done == length:
            return out
        m = items.size - 2 * size + 1
        power, size = _pair(power[:m], power[size : size + m], 1000 + size), 2 * size


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of `width` neighbouring values."""
    if x.size < width:
        return x[:0]
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: x.size - rest], x[rest:]) if rest else x


def runs(values: np.ndarray, owner: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of equal values among neighbouring valid places of one owner."""
    if not values.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(values.size, bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    ends = np.ones(values.size, bool)
    ends[:-1] = new[1:] | ~valid[1:]
    return first, np.flatnonzero(ends & valid)


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending with the key."""
    return ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def place_in_bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    """Where in its bucket's range a key is, in 16 bits."""
    return (((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(16)) & np.uint64(0xFFFF)


SENT = "bucket int, shard int, keys binary, checks binary, held binary, ids binary"
BACK = "shard int, bucket int, keys binary, checks binary, hot binary, ids binary"
_NONE = np.zeros(0, np.uint64)


def _grouped(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of (key, check), and where in it each different pair begins. No checks: keys alone."""
    order = np.lexsort((checks, keys)) if checks.size else np.argsort(keys)
    new = np.ones(keys.size, bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    if checks.size:
        new[1:] |= checks[order[1:]] != checks[order[:-1]]
    return order, np.flatnonzero(new)


def send(shard: int, keys: np.ndarray, ids: np.ndarray, buckets: int, with_ids: bool, checks: np.ndarray = _NONE) -> pa.Table:
    """One row per bucket: the shard's different keys (with their checks), how many documents hold each (255: or more;
    1: all of one id) and, on demand, their smallest ids."""
    order, at = _grouped(keys, checks)
    keys, ids, checks = keys[order], ids[order], checks[order] if checks.size else checks
    held, low = np.zeros(0, np.uint8), ids
    if at.size:
        low = np.minimum.reduceat(ids, at)
        held = np.where(low != np.maximum.reduceat(ids, at), np.minimum(np.diff(np.append(at, keys.size)), 255), 1).astype(np.uint8)
        keys, checks = keys[at], checks[at] if checks.size else checks
    of = bucket_of(keys, buckets).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if of.size else np.zeros(0, np.int64)
    rows = list(zip(starts.tolist(), np.append(starts[1:], of.size).tolist(), strict=False))
    return pa.table({
        "bucket": pa.array(of[starts].astype(np.int32)),
        "shard": pa.array(np.full(starts.size, shard, np.int32)),
        "keys": pa.array([keys[a:b].tobytes() for a, b in rows], pa.binary()),
        "checks": pa.array([checks[a:b].tobytes() for a, b in rows], pa.binary()),
        "held": pa.array([held[a:b].tobytes() for a, b in rows], pa.binary()),
        "ids": pa.array([low[a:b].tobytes() if with_ids else b"" for a, b in rows], pa.binary()),
    })


def nothing_sent() -> pa.Table:
    return send(0, _NONE, np.zeros(0, np.int64), 1, False)


def _arrays(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), kind) for x in column]


def answer(group: pa.Table, hot: int) -> pa.Table:
    """A bucket's answer to each shard: those of its keys that more than one id holds, which are hot, and their smallest ids."""
    shard = group.column("shard").to_numpy()
    parts, checks, ids = (_arrays(group.column(c), k) for c, k in (("keys", np.uint64), ("checks", np.uint64), ("ids", np.int64)))
    keys, check = np.concatenate(parts), np.concatenate(checks)
    held = np.concatenate(_arrays(group.column("held"), np.uint8)).astype(np.int64)
    order, at = _grouped(keys, check)
    which = np.empty(keys.size, np.int64)
    which[order] = np.repeat(np.arange(at.size), np.diff(np.append(at, keys.size)))
    total = np.bincount(which, held, at.size)
    low = np.minimum.reduceat(np.concatenate(ids)[order], at) if any(x.size for x in ids) else None
    out: list[list] = [[], [], [], [], []]
    end = 0
    for i, (s, p) in enumerate(zip(shard.tolist(), parts, strict=True)):
        w = which[end : end + p.size]
        end += p.size
        keep = total[w] > 1
        if keep.any():
            for have, x in zip(out, (s, p[keep], checks[i][keep] if checks[i].size else checks[i], total[w[keep]] > hot, low[w[keep]] if low is not None else _NONE), strict=True):
                have.append(x if isinstance(x, int) else x.tobytes())
    bucket = group.column("bucket")[0].as_py()
    binary = [pa.array(x, pa.binary()) for x in out[1:]]
    return pa.table([pa.array(out[0], pa.int32()), pa.array([bucket] * len(out[0]), pa.int32()), *binary], names=["shard", "bucket", "keys", "checks", "hot", "ids"])


def answered(sent: DataFrame) -> DataFrame:
    hot = HOT
    return sent.groupBy("bucket").applyInArrow(lambda _, g: answer(g, hot), BACK)


class Known:
    """The keys that a shard's answers name: ascending, with checks, whether they are hot, and ids (empty if none came)."""

    def __init__(self, back: pa.Table):
        back = back.filter(pc.greater_equal(back.column("bucket"), 0))
        self.keys, self.checks, self.hot, self.ids = (np.concatenate([np.zeros(0, k), *_arrays(back.column(c), k)]) for c, k in (("keys", np.uint64), ("checks", np.uint64), ("hot", bool), ("ids", np.int64)))
        order, _ = _grouped(self.keys, self.checks)
        self.keys, self.hot = self.keys[order], self.hot[order]
        self.checks, self.ids = (x[order] if x.size else x for x in (self.checks, self.ids))

    def find(self, keys: np.ndarray, checks: np.ndarray = _NONE) -> tuple[np.ndarray, np.ndarray]:
        """Of each key (and check) its place, and whether it is there."""
        at, there = where_in(keys, self.keys)
        if checks.size and self.keys.size:
            there &= self.checks[at] == checks
            # a key that stands with several checks
            other = np.flatnonzero(~there & (self.keys[at] == keys))
            while other.size:
                at[other] += 1
                other = other[at[other] < self.keys.size]
                other = other[self.keys[at[other]] == keys[other]]
                there[other] = self.checks[at[other]] == checks[other]
                other = other[~there[other]]
            at[at >= self.keys.size] = 0
        return at, there


def where_in(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key its place in the ascending array `known`, and whether it is there."""
    if not known.size:
        return np.zeros(keys.size, np.int64), np.zeros(keys.size, bool)
    at = np.searchsorted(known, keys)
    at[at == known.size] = 0
    return at, known[at] == keys


