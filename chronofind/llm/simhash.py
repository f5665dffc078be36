"""SimHash near-duplicates: BK-trees over fingerprint shards.

A document's fingerprint sums the XXH64 hashes of its word shingles bit by bit. Fingerprints, not
documents, are compared, so any number of equal texts is one entry. Two fingerprints within
`radius` bits agree in at least one of radius + 1 bit bands; fingerprints are dealt into shards by
(band, value), where every shard has its own BK-tree: a node keeps its children by their integer
Hamming distance to it, and a search for a fingerprint follows only edges whose distance lies
within the radius of its own. A shard of more than `SHARD_LIMIT` fingerprints is cut by their
remaining bits in the same way (bands within bands, exact again), and what is still large is cut
into chunks: each chunk's tree is sent to every chunk that has to ask it, so no task holds more than
two chunks. A shard returns a spanning forest of its links, not all pairs. The forests are joined by
alternating large-star and small-star steps to components, with the work tables written in the
shared folder.

Defined cases: a null text has no words; texts without words have fingerprint zero and are linked
like any other. Rows of a null id are linked as others are, and are passed over when the smallest
id is sought (a component of null ids only has a null component). Repeated rows are each returned.
An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored, table

BITS = 64
SHINGLE_WORDS = 3
RADIUS = 3
#: Fingerprints to one tree; larger shards are cut.
SHARD_LIMIT = 4096
#: Rows of shards to one call, on average, and (query, node) pairs to one piece of a search at most.
GROUP_ROWS = 50_000
_PAIRS = 4_000_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    words = text.translate(_LOWER).split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    digest = xxhash.xxh64_intdigest
    joined = map(b" ".join, zip(*(words[i : i + n] for i in range(shingle_words)), strict=False)) if len(words) > shingle_words else (b" ".join(words),)
    over = np.zeros(BITS, np.int64)
    h = np.fromiter((digest(s, 42) for s in joined), np.uint64, n)
    for i in range(0, n, 1 << 16):
        over += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * over > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([fingerprint(t.as_py(), shingle_words) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made)], names=["doc_id", "fp"])

    return run


class BKTrees:
    """The BK-trees of many shards, in arrays, built and searched together level by level.

    A fingerprint that is put in goes down the edge of its distance to each node it meets; the first
    to come down an edge becomes the node at its end. A search keeps (query, node) pairs and follows
    the edges whose distance differs from the query's by at most the radius."""

    def __init__(self, fps: np.ndarray, shard: np.ndarray):
        """fps: different fingerprints within a shard; shard: their shards' numbers, ascending."""
        self.fps = fps
        n = fps.size
        self.shards, self.roots, self.sizes = np.unique(shard, return_index=True, return_counts=True)
        at = np.repeat(self.roots, self.sizes)
        rest = np.flatnonzero(at != np.arange(n))
        edges, children = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while rest.size:
            edge = at[rest] * (BITS + 1) + np.bitwise_count(fps[rest] ^ fps[at[rest]])
            new, first, which = np.unique(edge, return_index=True, return_inverse=True)
            edges.append(new)
            children.append(rest[first])
            at[rest] = rest[first][which]
            rest = rest[at[rest] != rest]
        edge, self.child = np.concatenate(edges), np.concatenate(children)
        order = np.argsort(edge)
        self.child, self.edge = self.child[order], edge[order] % (BITS + 1)
        self.first = np.searchsorted(edge[order] // (BITS + 1), np.arange(n + 1))

    def search(self, queries: np.ndarray, shard: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query numbers, node numbers) within the radius, in pieces of bounded size."""
        where = np.searchsorted(self.shards, shard)
        cost = np.cumsum(self.sizes[where])
        cuts = np.unique(np.searchsorted(cost, np.arange(_PAIRS, cost[-1] if cost.size else 0, _PAIRS)))
        for q in np.split(np.arange(queries.size), cuts):
            node = self.roots[where[q]]
            while q.size:
                d = np.bitwise_count(queries[q] ^ self.fps[node]).astype(np.int64)
                hit = d <= radius
                if hit.any():
                    yield q[hit], node[hit]
                n = self.first[node + 1] - self.first[node]
                edges = np.repeat(self.first[node] - np.cumsum(n) + n, n) + np.arange(n.sum())
                q, d = np.repeat(q, n), np.repeat(d, n)
                follow = np.abs(self.edge[edges] - d) <= radius
                q, node = q[follow], self.child[edges[follow]]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label (of each number the smallest of its group) after the links a, b."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b = a[open_], b[open_]
        np.minimum.at(label, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while (label != (up := label[label])).any():
            label = up


def forest(shard: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smallest fingerprint of its group in the shard) that join all that are within the radius.

    Rows of side 0 make the shard's tree. Those of side 1 ask it; where there are none, side 0 asks itself."""
    order = np.lexsort((fp, side, shard))
    shard, side, fp = shard[order], side[order], fp[order].view(np.uint64)
    keep = np.ones(fp.size, bool)
    keep[1:] = (shard[1:] != shard[:-1]) | (side[1:] != side[:-1]) | (fp[1:] != fp[:-1])
    shard, side, fp = shard[keep], side[keep], fp[keep]
    tree = np.flatnonzero(side == 0)
    asked = np.isin(shard, shard[side == 1])
    queries = np.flatnonzero((side == 1) & np.isin(shard, shard[tree]) | ~asked)
    trees = BKTrees(fp[tree], shard[tree])
    label = np.arange(fp.size)
    for q, node in trees.search(fp[queries], shard[queries], radius):
        label = _joined(label, queries[q], tree[node])
    low = np.full(fp.size, np.iinfo(np.int64).max)
    signed = fp.view(np.int64)
    np.minimum.at(low, label, signed)
    to = low[label]
    moved = signed != to
    return signed[moved], to[moved]


def _bands(bits: list[int], n: int) -> list[list[int]]:
    return [bits[i * len(bits) // n : (i + 1) * len(bits) // n] for i in range(n)]


def _key(band: int, radius: int):
    """SQL of a band's value of column fp."""
    bits = _bands(list(range(BITS)), radius + 1)[band]
    return F.shiftrightunsigned(F.col("fp"), bits[0]).bitwiseAND(F.lit((1 << len(bits)) - 1))


_LINKS = "a long, b long"


def _shard_links(radius: int):
    def run(group: pa.Table) -> pa.Table:
        a, b = forest(group.column("shard").to_numpy(), group.column("side").to_numpy(), group.column("fp").to_numpy(), radius)
        return pa.table({"a": a, "b": b})

    return run


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) pairs of a column `fp` of different fingerprints whose components are those of "within the radius"."""
    spark = fps.sparkSession
    n = radius + 1
    dealt = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), _key(i, radius).alias("value")) for i in range(n)])).alias("k")).select("fp", "k.band", "k.value")
    large = stored(dealt.groupBy("band", "value").count().filter(F.col("count") > SHARD_LIMIT))
    small, rows = dealt, fps.count() * n
    parts = []
    if large.limit(1).count():
        # large shards are dealt again by the bits that their band leaves
        small = dealt.join(large.select("band", "value"), ["band", "value"], "left_anti")
        again = dealt.join(large.select("band", "value"), ["band", "value"])
        options = None
        for band in range(n):
            rest = [b for j, bits in enumerate(_bands(list(range(BITS)), n)) if j != band for b in bits]
            subs = []
            for i, bits in enumerate(_bands(rest, n)):
                value = sum((F.shiftrightunsigned(F.col("fp"), b).bitwiseAND(F.lit(1)) * F.lit(1 << at) for at, b in enumerate(bits)), F.lit(0).cast("long"))
                subs.append(F.struct(F.lit(i).alias("sub"), value.cast("long").alias("subvalue")))
            options = F.when(F.col("band") == band, F.array(*subs)) if options is None else options.when(F.col("band") == band, F.array(*subs))
        again = again.select("fp", "band", "value", F.explode(options).alias("s")).select("fp", "band", "value", "s.sub", "s.subvalue")
        counts = again.groupBy("band", "value", "sub", "subvalue").count().filter("count > 1").withColumn("chunks", F.ceil(F.col("count") / SHARD_LIMIT).cast("int"))
        again = again.join(counts.drop("count"), ["band", "value", "sub", "subvalue"])
        # chunk c is asked by itself and by all chunks before it: (i, j) with i <= j, tree of i, asked by j
        chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        again = again.withColumn("c", chunk)
        pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least("c", o).alias("i"), F.greatest("c", o).alias("j"), F.when(o < F.col("c"), 1).otherwise(0).alias("side")))
        again = again.select("fp", "band", "value", "sub", "subvalue", F.explode(pairs).alias("p"))
        parts.append(again.select("fp", (F.shiftleft(F.xxhash64("band", "value", "sub", "subvalue", "p.i", "p.j"), 1) + (F.col("p.i") < F.col("p.j")).cast("int")).alias("shard"), F.col("p.side").alias("side")))
    every = small.select("fp", F.shiftleft(F.xxhash64("band", "value"), 1).alias("shard"), F.lit(0).alias("side"))
    for p in parts:
        every = every.unionByName(p)
    # many shards go to one call; the last bit keeps shards that are asked by others apart from those that ask
    # themselves, so should two shards' hashes be equal, their trees become one, which loses no link
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // GROUP_ROWS + 1)
    return every.groupBy(F.pmod("shard", F.lit(groups)).alias("group")).applyInArrow(_shard_links(radius), _LINKS)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) for all vertices a of edges (a, b) but the smallest of each component, which is b.

    Large-star joins every vertex's larger neighbours to its smallest one, small-star its smaller ones; both are
    one aggregation over the edges, and the edges become stars after a few rounds (their number is logarithmic
    in the vertices); the rounds end when nothing changes. A vertex's neighbours are never gathered: they meet their vertex's minimum in a join that
    AQE can split."""
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        before = now
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.filter("a <> b").distinct())
        low2 = stored(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low2, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), F.col("m")))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
        now = stored(small.filter("a <> b").distinct())
        same = before.count() == now.count() and not before.join(now, ["a", "b"], "left_anti").limit(1).count()
        for x in (before, low, large, low2):
            discard(x)
        if same:
            return now


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of docs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    made = stored(rows.mapInArrow(_fingerprints(shingle_words), f"doc_id {kind}, fp long"))
    known = stored(made.groupBy("fp").agg(F.min("doc_id").alias("first")))
    stars = components(links(known.select("fp"), radius))
    # the smallest id of each component; fingerprints without links are their own
    rooted = stored(known.join(stars.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    firsts = stored(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = stored(rooted.join(firsts, "root").select("fp", "component_id"))
    for x in (known, stars, rooted, firsts):
        discard(x)
    return made.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), BITS // 4, "0")).alias("fingerprint"), "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
