"""Substring dedup over bytes by merging Burrows-Wheeler transforms.

Which strings of `length` bytes start in several documents is read off merged Burrows-Wheeler
transforms. Transforms of different shards are merged by iterative interleave refinement: the merged
rows are kept as an interleave of the shards' rows; one step sorts it, stably, by the characters
before the rows and moves each row along its shard's last-to-first mapping, so that after h
characters rows stand in the order of their first h characters. A border between rows that appears
at step h says that their common prefix is shorter than h, so the borders that are there after
`length` characters delimit the repeated intervals; no suffix is sorted again. (Two characters go
in one step, and rows that share their characters with no other are not moved on.) The smallest document of an interval is the one that keeps the string.

To spread this over a cluster, and to keep out the bulk of the text, which is not repeated, strings
meet in buckets. Each string of `length` bytes is named by the smallest hash of the 16-byte windows in
it, so equal strings have equal names; names that a single document holds are out. Neighbouring
strings of one name make a segment, a bucket holds the segments of its names, each different one
once, and the transforms of the segments of several groups of shards are merged there. A segment
goes to a bucket once per shard, whatever the number of documents that hold it. The strings of a hot
name are dealt one by one over all buckets, by their own hashes. Copies of whole texts take no part:
they are removed by their digests.

Defined cases: a null text is empty. Rows of one id never remove each other's bytes; a null id is
larger than all others, and null ids don't remove each other. Texts shorter than `length` keep
everything. Repeated rows are each returned. An empty table gives an empty result; further columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .shards import SENT, Known, Shard, answered, bucket_of, mix, nothing_sent, place_in_bucket, runs, send, sharded, sliding_min

LENGTH = 50
NAME = 16
#: Transforms that one bucket merges.
GROUPS = 4
#: Bytes of strings that are merged at once, about: what a core's cache holds.
STRETCH = 160_000
#: Bytes of text whose names are made at once.
_PIECE = 1 << 16
#: Odd multipliers, one for each eight bytes of a window.
_ODD = [np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) % (1 << 64)) for i in range(NAME // 8)]


def segments(shard: Shard, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, document number, first start, last start) of the runs of neighbouring strings of one name."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    size = shard.data.size
    for at in range(0, max(0, size - length + 1), _PIECE):
        data = shard.data[at : at + _PIECE + length - 1]
        n = data.size - length + 1
        word = np.ndarray((data.size - 7,), "<u8", data.tobytes(), strides=(1,))
        windows = data.size - NAME + 1
        hashes = word[:windows] * _ODD[0]
        for i in range(1, NAME // 8):
            hashes += word[8 * i : 8 * i + windows] * _ODD[i]
        hashes = mix(hashes)
        key = sliding_min(hashes, length - NAME + 1)
        a, b = np.searchsorted(shard.offsets, (at, at + n - 1), "right") - 1
        doc = np.repeat(np.arange(a, b + 1), np.diff(np.clip(shard.offsets[a : b + 2], at, at + n)))
        first, last = runs(key, doc, np.arange(at, at + n) + length <= shard.offsets[doc + 1])
        for o, x in zip(out, (mix(key[first]), doc[first], first + at, last + at), strict=True):
            o.append(x)
    if not out[0]:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    name, doc, first, last = (np.concatenate(x) for x in out)
    # a run that a piece's end has cut goes on in the next piece
    new = np.ones(name.size, bool)
    new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1]) | (first[1:] != last[:-1] + 1)
    ends = np.append(np.flatnonzero(new)[1:], name.size) - 1
    return name[new], doc[new], first[new], last[ends]


def _names(length: int, buckets: int):
    def run(_: tuple, docs: pa.Table, back: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return nothing_sent()
        shard = Shard(docs, back)
        name, doc, _, _ = segments(shard, length)
        return send(docs.column("shard")[0].as_py(), name, shard.ids[doc], buckets, False)

    return run


class Repeated:
    """A shard's segments of shared names, and by bucket its different ones in order of appearance.

    A hot name's strings are dealt one by one, each by its own hash, so that they meet in all buckets."""

    def __init__(self, shard: Shard, known: Known, length: int, buckets: int):
        name, doc, first, last = segments(shard, length)
        at, keep = known.find(name)
        hot = np.zeros(name.size, bool)
        hot[keep] = known.hot[at[keep]]
        keep &= ~hot
        n = (last - first + 1)[hot]
        start = _spread(first[hot], n)
        self.doc = np.concatenate([doc[keep], np.repeat(doc[hot], n)])
        self.first = np.concatenate([first[keep], start])
        self.last = np.concatenate([last[keep], start])
        raw = shard.data.tobytes()
        own, equal = self.hashes(raw, start, length)
        key = np.concatenate([name[keep], own])
        self.bucket = bucket_of(key, buckets).astype(np.int64)
        place = place_in_bucket(key, buckets)
        self.number = np.zeros(self.doc.size, np.int64)
        self.strings: dict[int, list[bytes]] = defaultdict(list)
        self.ids: dict[int, list[int]] = defaultdict(list)
        self.places: dict[int, list[int]] = defaultdict(list)
        # of the hot strings only the first of equal ones is looked at, with the smallest of their ids
        ids = shard.ids[self.doc]
        alone = int(keep.sum())
        if start.size:
            np.minimum.at(ids, alone + equal, ids[alone:])
        same = np.concatenate([np.arange(alone), alone + equal])
        some = np.flatnonzero(same == np.arange(same.size))
        seen: dict[bytes, int] = {}
        for i, b, k, p, x, y in zip(some.tolist(), *(c[some].tolist() for c in (self.bucket, ids, place, self.first, self.last + length)), strict=True):
            s = raw[x:y]
            n = seen.get(s)
            if n is None:
                n = seen[s] = len(self.strings[b])
                self.strings[b].append(s)
                self.ids[b].append(k)
                self.places[b].append(p)
            elif k < self.ids[b][n]:
                self.ids[b][n] = k
            self.number[i] = n
        self.number = self.number[same]

    @staticmethod
    def hashes(raw: bytes, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the strings at some starts, and of each the number of the first that it equals byte by byte (its own
        for those few that share a hash with other strings)."""
        own, equal = np.zeros(start.size, np.uint64), np.arange(start.size)
        if not start.size:
            return own, equal
        word = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        offsets = [*range(0, length - 7, 8), length - 8]
        for i, o in enumerate(offsets):
            own += word[start + o] * np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) % (1 << 64))
        own = mix(own)
        order = np.argsort(own, kind="stable")
        new = np.ones(order.size, bool)
        new[1:] = own[order[1:]] != own[order[:-1]]
        equal[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        for o in offsets:
            other = word[start + o] != word[start[equal] + o]
            equal[other] = np.flatnonzero(other)
        return own, equal


_SEGMENTS = "bucket int, shard int, text binary, lengths binary, ids binary, places binary"


def _cut(length: int, buckets: int):
    def run(_: tuple, docs: pa.Table, back: pa.Table) -> pa.Table:
        rows: list[list] = [[], [], [], [], [], []]
        if docs.num_rows and back.num_rows:
            found = Repeated(Shard(docs, back), Known(back), length, buckets)
            for b, some in found.strings.items():
                rows[0].append(b)
                rows[1].append(docs.column("shard")[0].as_py())
                rows[2].append(b"".join(some))
                rows[3].append(np.array([len(s) for s in some], np.int32).tobytes())
                rows[4].append(np.array(found.ids[b], np.int64).tobytes())
                rows[5].append(np.array(found.places[b], np.uint16).tobytes())
        types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("bucket", "shard", "text", "lengths", "ids", "places"), rows, types, strict=True)})

    return run


class Transform:
    """The Burrows-Wheeler transform of a collection of strings.

    Rows are the suffixes in order of their first `depth` bytes. `place` is where a row's suffix starts in the
    collection's text, `left` its length, `back2` the row of the suffix two characters longer (-1: none), which
    is two last-to-first steps, and `head` the first two characters of the row as one number."""

    def __init__(self, text: np.ndarray, lengths: np.ndarray, depth: int):
        n = text.size
        ends = np.cumsum(lengths)
        left = np.repeat(ends, lengths) - np.arange(n)
        padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
        # order by eight characters, then by twice as many again and again: only what still ties is looked at
        word = np.ndarray((n,), ">u8", padded.tobytes(), strides=(1,)).astype(np.uint64)
        short = np.flatnonzero(left < 8)
        word[short] &= np.uint64(0xFFFFFFFFFFFFFFFF) << ((8 - left[short]) * 8).astype(np.uint64)
        order = np.argsort(word)
        key = word[order]
        rank = np.empty(n, np.int64)  # one more than where the rows that equal it begin
        open_, have = np.arange(n), 8
        while True:
            new = np.ones(key.size, bool)
            new[1:] = key[1:] != key[:-1]
            rank[order[open_]] = open_[np.flatnonzero(new)][np.cumsum(new) - 1] + 1
            if have >= depth:
                break
            open_ = open_[~(new & np.append(new[1:], True))]
            if not open_.size:
                break
            some = order[open_]
            follow = np.where(left[some] > have, rank[np.minimum(some + have, n - 1)], 0)
            key = (rank[some] << 32) | follow
            by = np.argsort(key)
            order[open_], key = some[by], key[by]
            have *= 2
        self.n, self.place, self.left = n, order, left[order]
        row = np.empty(n, np.int64)
        row[order] = np.arange(n)
        start = np.repeat(ends - lengths, lengths)
        self.back2 = np.where(order - start[order] >= 2, row[np.maximum(order - 2, 0)], -1)
        self.head = text[order].astype(np.int32) * 256 + padded[order + 1]


def interleave(parts: list[Transform], length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Merges transforms. Yields (rows, interval numbers) after every two characters: of the concatenated rows that have
    that many, those that share them with another row, in merged order, and the number of the interval of equal ones.

    A row that is alone in its interval is alone with every character more, and so is the row it moves to: it has
    its place in the interleave and is not carried on."""
    shift = np.cumsum([0, *(p.n for p in parts)])
    index = np.int32 if shift[-1] < 1 << 31 else np.int64
    back2 = np.concatenate([np.where(p.back2 >= 0, p.back2 + s, -1) for p, s in zip(parts, shift, strict=False)]).astype(index)
    head = np.concatenate([p.head for p in parts]).astype(np.uint16)
    # every row by its first two characters
    order = np.flatnonzero(np.concatenate([p.left for p in parts]) >= 2).astype(index)
    interval = np.zeros(order.size, index)
    for step in range(length // 2):
        if step:
            order = back2[order]
            has = order >= 0
            order, interval = order[has], interval[has]
        key = head[order]
        by = np.argsort(key, kind="stable")  # a counting sort, as keys have 16 bits
        key, interval, order = key[by], interval[by], order[by]
        new = np.ones(order.size + 1, bool)
        new[1:-1] = (key[1:] != key[:-1]) | (interval[1:] != interval[:-1])
        shared = ~(new[:-1] & new[1:])
        interval = np.cumsum(new[:-1], dtype=index)[shared]
        order = order[shared]
        yield order, interval


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ..., n of them, for each element in turn."""
    before = np.cumsum(n) - n
    return np.repeat(first - before, n) + np.arange(n.sum())


def least_ids(pieces: list[bytes], group: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of strings, the smallest id that holds each of their substrings of `length` bytes, in runs: (runs of each string,
    length of each run, its id). The strings of a group make one transform."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    parts, base = [], 0
    starts = np.zeros(size.size, np.int64)
    order = np.argsort(group, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        parts.append(Transform(np.frombuffer(b"".join([pieces[k] for k in some.tolist()]), np.uint8), size[some], length + 6))
        ends = np.cumsum(size[some])
        starts[some] = base + ends - size[some]
        base += int(ends[-1])
    rows, interval = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for rows, interval in interleave(parts, length):
        pass
    smallest = np.repeat(ids[order], size[order])  # of a string that stands in one piece only, that piece's
    if rows.size:
        place = np.concatenate([p.place + s for p, s in zip(parts, np.cumsum([0, *(p.n for p in parts)]), strict=False)])[rows]
        first = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
        least = np.minimum.reduceat(smallest[place], first)
        smallest[place] = np.repeat(least, np.diff(np.append(first, rows.size)))
    n = size - length + 1
    first = np.cumsum(n) - n
    x = smallest[_spread(starts, n)]
    new = np.ones(x.size, bool)
    new[1:] = x[1:] != x[:-1]
    new[first] = True
    cut = np.flatnonzero(new)
    return np.add.reduceat(new, first, dtype=np.int64), np.diff(np.append(cut, x.size)).astype(np.int32), x[cut]


def _merge(length: int):
    def run(group: pa.Table) -> pa.Table:
        shards = group.column("shard").to_pylist()
        seen: dict[bytes, int] = {}
        low: list[int] = []
        places: list[int] = []
        of: list[int] = []
        numbers: list[list[int]] = []
        for s, text, *more in zip(shards, *(group.column(c) for c in ("text", "lengths", "ids", "places")), strict=True):
            text, at, mine = text.as_py(), 0, []
            for n, i, p in zip(*(np.frombuffer(x.as_py(), k).tolist() for x, k in zip(more, (np.int32, np.int64, np.uint16), strict=True)), strict=True):
                piece = text[at : at + n]
                at += n
                k = seen.get(piece)
                if k is None:
                    k = seen[piece] = len(low)
                    low.append(i)
                    places.append(p)
                    of.append(s % GROUPS)
                elif i < low[k]:
                    low[k] = i
                mine.append(k)
            numbers.append(mine)
        # equal strings have equal names, so stretches of names are merged apart from each other
        pieces, of_, low_ = list(seen), np.array(of), np.array(low, np.int64)
        stretch = np.array(places, np.int64) * (sum(map(len, pieces)) // STRETCH + 1) >> 16
        order = np.argsort(stretch, kind="stable")
        found = [least_ids([pieces[k] for k in some.tolist()], of_[some], low_[some], length) for some in np.split(order, np.flatnonzero(np.diff(stretch[order])) + 1)]
        runs_, run_length, least = (np.concatenate(x) for x in zip(*found, strict=True))
        cuts, at_cut = np.empty(order.size, np.int64), np.empty(order.size, np.int64)
        cuts[order], at_cut[order] = runs_, np.cumsum(runs_) - runs_
        out: list[list] = [[], [], [], []]
        for s, mine in zip(shards, numbers, strict=True):
            of_string = _spread(at_cut[mine], cuts[mine])
            out[0].append(s)
            out[1].append(cuts[mine].astype(np.int32).tobytes())
            out[2].append(run_length[of_string].tobytes())
            out[3].append(least[of_string].tobytes())
        bucket = group.column("bucket")[0].as_py()
        return pa.table({"shard": pa.array(out[0], pa.int32()), "bucket": pa.array([bucket] * len(shards), pa.int32()), "counts": pa.array(out[1], pa.binary()), "runs": pa.array(out[2], pa.binary()), "least": pa.array(out[3], pa.binary())})

    return run


_EMPTY = hashlib.sha256(b"").hexdigest()


def _apply(length: int, buckets: int):
    def run(_: tuple, docs: pa.Table, back: pa.Table) -> pa.Table:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        if not docs.num_rows:
            return pa.table([pa.array([], t) for t in types], names=_OUT)
        shard = Shard(docs, back)
        is_name = np.array([k.as_py() is not None for k in back.column("keys")], bool)
        names, results = back.filter(pa.array(is_name)), back.filter(pa.array(~is_name))
        gone = np.zeros(shard.data.size + 1, np.int64)
        if results.num_rows:
            found = Repeated(shard, Known(names), length, buckets)
            base = np.zeros(buckets, np.int64)
            told: list[list[np.ndarray]] = [[], [], []]
            strings = 0
            for b, *some in zip(*(results.column(n).to_pylist() for n in ("bucket", "counts", "runs", "least")), strict=True):
                base[b] = strings
                for have, x, kind in zip(told, some, (np.int32, np.int32, np.int64), strict=True):
                    have.append(np.frombuffer(x, kind))
                strings += told[0][-1].size
            counts, run_length, least = (np.concatenate(x) for x in told)
            counts = counts.astype(np.int64)
            k = base[found.bucket] + found.number
            n = counts[k]
            of_string = _spread((np.cumsum(counts) - counts)[k], n)
            width = run_length[of_string].astype(np.int64)
            before = np.cumsum(width) - width
            x = np.repeat(found.first - before[np.cumsum(n) - n], n) + before
            hit = least[of_string] < np.repeat(shard.ids[found.doc], n)
            gone += np.bincount(x[hit], minlength=gone.size)
            gone -= np.bincount((x + width - 1 + length)[hit], minlength=gone.size)
        removed = np.cumsum(gone[:-1]) > 0
        texts: dict[int, tuple] = {}
        for i, u in enumerate(shard.number.tolist()):
            a, b = shard.offsets[i], shard.offsets[i + 1]
            mine = removed[a:b]
            n = int(mine.sum())
            spans = int(mine[:1].sum() + (mine[1:] & ~mine[:-1]).sum()) if n else 0
            texts[u] = (int(b - a), n, spans, hashlib.sha256(shard.data[a:b][~mine].tobytes() if n else shard.text(i)).hexdigest())
        rows: list[list] = [[], [], [], []]
        for i, (u, copy) in enumerate(zip(shard.of.tolist(), shard.copy.tolist(), strict=True)):
            size = len(shard.texts[i].as_buffer()) if copy else 0
            for have, x in zip(rows, (size, size, 1, _EMPTY) if copy else texts[u], strict=True):
                have.append(x)
        return pa.table([shard.doc_id, *(pa.array(x, t) for x, t in zip(rows, types[1:], strict=True))], names=_OUT)

    return run


_OUT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def dedup_bytes(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per row of docs. length: even, NAME + 2 at least."""
    if length % 2 or length < NAME + 2:
        raise ValueError(f"length must be even, and {NAME + 2} at least")
    rows, copies, short, n = sharded(docs, id_col, text_col, length)
    dealt = rows.groupBy("shard")
    names = answered(dealt.cogroup(copies.groupBy("shard")).applyInArrow(_names(length, n), SENT)).unionByName(copies)
    cut = dealt.cogroup(names.groupBy("shard")).applyInArrow(_cut(length, n), _SEGMENTS)
    merged = cut.groupBy("bucket").applyInArrow(_merge(length), "shard int, bucket int, counts binary, runs binary, least binary")
    back = names.unionByName(merged, allowMissingColumns=True)
    found = dealt.cogroup(back.groupBy("shard")).applyInArrow(_apply(length, n), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    none = F.lit(0).cast("long")
    text = F.coalesce("text", F.lit(b""))
    return found.unionByName(short.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(text, 256).alias("kept_sha256")))


def op2_byte_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT r, doc_id, list_transform(generate_series(1, len(h) // 2), lambda i: substr(substr(h, 200 * ((i - 1) // 100) + 1, 400), 2 * ((i - 1) % 100) + 1, 100)) AS w FROM d),
win AS (SELECT r, doc_id, unnest(w) AS s, generate_subscripts(w, 1) AS i FROM x),
low AS (SELECT s AS k, min(doc_id) AS m FROM win WHERE len(s) = 100 GROUP BY s),
hit AS (SELECT r, i FROM win JOIN low ON k = s WHERE m < doc_id),
gone AS (
  SELECT win.r, win.i, s[1:2] AS x, count(hit.i) OVER (PARTITION BY win.r ORDER BY win.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM win LEFT JOIN hit ON hit.r = win.r AND hit.i = win.i WHERE win.r IN (SELECT r FROM hit)
),
spans AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS starts FROM gone),
told AS (SELECT r, count(*) FILTER (gone) AS n, count(*) FILTER (starts) AS s, string_agg(x, '' ORDER BY i) FILTER (NOT gone) AS kept FROM spans GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(s, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE coalesce(kept, '') END)) AS kept_sha256
FROM d LEFT JOIN told USING (r)
"""
