"""Exact top-k by inner product over a bit-sliced index.

Rows are packed in blocks. For every block and vector component the index holds one bitmap per
binary digit of the quantised component (offset binary), a bit per row. A query's scores for all
rows of a block are made at once as a bit-sliced integer: the slices of each component are added
in at the weights of the binary digits of the query's component, by carry-save adders on bitmaps.
Where the query's component is negative the complemented slices are added instead, so that no
digit is negative and the sum differs from the score by a constant of the query. The best k rows
are selected from the most significant slice downward; the rows that tie at the boundary are
resolved exactly, by the smaller id. Blocks give their best k each, and a window keeps the best k
of a query.

Queries go in blocks of `QUERY_BLOCK` rows, each broadcast (its size is bounded) to one pass over
the table; results of a pass are written before the next starts, so neither the plan nor the
driver grows with the number of queries.

Defined cases: null vectors and vectors that hold a null or a non-finite component take no part,
as queries or as candidates; nor do rows with a null id. Vectors shorter than the longest of their
block count as if filled up with zeros. Equal ids: all rows of the query's id are "its own" and no
candidates of it; the query's vector is the smallest of its rows in array order; as candidates,
repeated rows stand side by side. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, stored, table

#: Rows to one bit-sliced block, and queries to one broadcast.
ROW_BLOCK = 1 << 16
QUERY_BLOCK = 2048


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v): integer components floor(scale * x), without the rows that take no part."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    sound = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


class BitSlices:
    """The bit-sliced index of one block: slices[d][b] is the bitmap of digit b of component d."""

    def __init__(self, values: np.ndarray):
        self.n, self.dims = values.shape
        self.low = values.min(axis=0)
        spans = values.max(axis=0) - self.low
        self.digits = [int(s).bit_length() for s in spans]
        shifted = (values - self.low).astype(np.uint64)
        pad = -self.n % 64
        self.rows = self.n
        self.words = (self.n + pad) // 64
        self.slices = []
        for d in range(self.dims):
            column = np.concatenate([shifted[:, d], np.zeros(pad, np.uint64)])
            self.slices.append([np.packbits(((column >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64) for b in range(self.digits[d])])
        self.full = np.packbits(np.concatenate([np.ones(self.n, np.uint8), np.zeros(pad, np.uint8)]), bitorder="little").view(np.uint64)
        self.flipped = [[~s for s in some] for some in self.slices]

    def scores(self, q: np.ndarray) -> tuple[list[np.ndarray], int]:
        """The bit-sliced sum over the rows, least digit first, and the constant to add to it."""
        columns: dict[int, list[np.ndarray]] = {}
        constant = 0
        for d in range(self.dims):
            x = int(q[d])
            constant += x * int(self.low[d])
            if x < 0:  # x * s = |x| * (2^digits - 1 - s) + x * (2^digits - 1)
                constant += x * ((1 << self.digits[d]) - 1)
            source, m, a = (self.slices if x > 0 else self.flipped)[d], abs(x), 0
            while m:
                if m & 1:
                    for b, s in enumerate(source):
                        columns.setdefault(a + b, []).append(s)
                m >>= 1
                a += 1
        total, w = [], 0
        while w <= max(columns, default=-1):
            some = columns.get(w, [])
            carry = columns.setdefault(w + 1, []) if len(some) > 1 else columns.get(w + 1, [])
            while len(some) > 2:
                nxt = []
                for i in range(0, len(some) - 2, 3):
                    x, y, z = some[i : i + 3]
                    u = x ^ y
                    nxt.append(u ^ z)
                    carry.append((x & y) | (u & z))
                some = nxt + some[len(some) - len(some) % 3 :]
            if len(some) == 2:
                carry.append(some[0] & some[1])
                some = [some[0] ^ some[1]]
            total.append(some[0] if some else np.zeros(self.words, np.uint64))
            w += 1
        return total, constant

    def best(self, q: np.ndarray, k: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of the best k of the allowed rows, ties to the smaller row number, and their scores."""
        total, constant = self.scores(q)
        sure, open_ = np.zeros(self.words, np.uint64), allowed.copy()
        need = k
        for s in reversed(total):
            top = open_ & s
            n = int(np.bitwise_count(top).sum())
            if n > need:
                open_ = top
            else:
                sure |= top
                need -= n
                open_ &= ~s
                if not need:
                    break
        rows = self.row_numbers(sure)
        if need:
            rows = np.concatenate([rows, self.row_numbers(open_, need)])
        word, bit = rows >> 6, (rows & 63).astype(np.uint64)
        score = np.full(rows.size, constant, np.int64)
        for w, s in enumerate(total):
            score += ((s[word] >> bit) & np.uint64(1)).astype(np.int64) << w
        return rows, score

    @staticmethod
    def row_numbers(bits: np.ndarray, first: int | None = None) -> np.ndarray:
        words = np.flatnonzero(bits)
        if first is not None:  # each word that is not zero holds a row at least
            words = words[:first]
        on = np.unpackbits(bits[words].view(np.uint8), bitorder="little").reshape(-1, 64)
        word, bit = np.nonzero(on)
        return (words[word] * 64 + bit)[:first]


def _matrix(batch: pa.ListArray, dims: int) -> np.ndarray:
    lengths = np.diff(batch.offsets.to_numpy())
    flat = batch.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(batch), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def _search(queries: tuple[np.ndarray, np.ndarray], k: int):
    q_id, q = queries

    def block_best(ids: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], values[order]
        dims = max(values.shape[1], q.shape[1])
        values = np.pad(values, ((0, 0), (0, dims - values.shape[1])))
        asked = np.pad(q, ((0, 0), (0, dims - q.shape[1])))
        index = BitSlices(values)
        lo, hi = np.searchsorted(ids, q_id, "left"), np.searchsorted(ids, q_id, "right")
        out: list[list[np.ndarray]] = [[], [], []]
        for i in range(q_id.size):
            allowed = index.full
            if lo[i] < hi[i]:
                own = np.arange(lo[i], hi[i])
                allowed = allowed.copy()
                np.bitwise_and.at(allowed, own >> 6, ~(np.uint64(1) << (own & 63).astype(np.uint64)))
            rows, score = index.best(asked[i], k, allowed)
            out[0].append(np.full(rows.size, q_id[i]))
            out[1].append(ids[rows])
            out[2].append(score)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        lists: list[pa.ListArray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            dims = max(int(np.diff(x.offsets.to_numpy()).max(initial=0)) for x in lists)
            return block_best(np.concatenate(ids), np.concatenate([_matrix(x, dims) for x in lists]).astype(np.int64))

        for b in batches:
            start = 0
            while start < b.num_rows:
                part = b.slice(start, ROW_BLOCK - held)
                start += part.num_rows
                held += part.num_rows
                ids.append(part.column(0).to_numpy())
                lists.append(pa.concat_arrays([part.column(1)]))
                if held == ROW_BLOCK:
                    yield flush()
                    ids, lists, held = [], [], 0
        if held:
            yield flush()

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of `vectors` for each row of `queries`."""
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vec_col, scale)
    asked = stored(quantised(queries, id_col, vec_col, scale).groupBy("id").agg(F.min("v").alias("v")))
    n = asked.count()
    found = None
    if n <= QUERY_BLOCK:
        blocks = iter([asked.collect()])
    else:
        dealt = asked.repartition(-(-n // (QUERY_BLOCK // 2)), "id")
        blocks = _chunks(dealt.toLocalIterator(), QUERY_BLOCK)
    for block in blocks:
        if not block:
            continue
        dims = max(len(r.v) for r in block)
        q = np.zeros((len(block), dims), np.int64)
        for i, r in enumerate(block):
            q[i, : len(r.v)] = r.v
        passed = rows.mapInArrow(_search((np.array([r.id for r in block], np.int64), q), k), "query_id long, vec_id long, score long")
        passed = stored(_best(passed, k)) if n > QUERY_BLOCK else _best(passed, k)
        found = passed if found is None else found.unionByName(passed)
    if found is None:
        found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    discard(asked)
    return found.select("query_id", "rank", "vec_id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _chunks(rows, size: int):
    some = []
    for r in rows:
        some.append(r)
        if len(some) == size:
            yield some
            some = []
    yield some


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


ORACLE_SQL = """
WITH x AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, CAST(list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * r.v[i])) AS BIGINT) AS score
  FROM x q JOIN x r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0
), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""
