"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased letter and digit runs. The corpus is scanned once to count, for every n-gram
of the test items, the documents that hold it; an item's seeds are its rarer n-grams (all that at
most a `rare_share` of the documents hold, and in any case, so that an item that leaked into many
documents keeps seeds in all its parts, the rarer half of them and the rarer one of any two that
follow each other; equal ones are spread over the item). So a passage with n + 1 words in a row of
the item always holds a seed; one with fewer may hold none and is then not found. A second scan
joins passages to items by the seeds they hold, inside the task that reads the text, and aligns each
passage around its seeds, be it one, with the item by the Smith-Waterman recurrence over words; only
passages whose words cannot reach the score in any order are left out before. A passage is reported
if the best local alignment scores at least `min_score` of what the whole item would score against
itself.

The alignment keeps one row of the recurrence, so its memory grows with the passage alone.

Test items are sent to the tasks in blocks of at most `ITEM_BLOCK` items and `BLOCK_WORDS` words, one
pair of scans per block (an item with more words than that has a block of its own), so what is broadcast is
bounded; documents are never shuffled.

Defined cases: null or empty texts, and items of fewer than `n` words, match by what they have: an
item shorter than `n` words is seeded by its whole word sequence, one without words matches
nothing. Repeated documents and repeated items are each reported; items with a null id too. Of
equally good alignments the first is given. Empty tables give an empty result; further columns are
not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

SEED_WORDS = 3
RARE_SHARE = 0.0005
MIN_SCORE = 0.5
ITEM_BLOCK = 20_000
BLOCK_WORDS = 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def align(passage: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """(score, first, end) of the best local alignment of two word number sequences, in passage words.

    One row of the recurrence is kept. A cell holds its score above the 32 bits that say where its alignment begins,
    earlier places being larger, so the maximum of two cells is the better one, or the earlier of two that are equal."""
    m = passage.size
    one = 1 << 32
    places = np.arange(m + 1, dtype=np.int64)
    fresh_start = (one - 1) - places  # score 0, beginning here
    gaps = -GAP * one * places
    above = fresh_start.copy()
    score, first, end = 0, 0, 0
    for w in item:
        row = fresh_start.copy()
        row[1:] = np.maximum(above[:-1] + np.where(passage == w, MATCH * one, MISMATCH * one), above[1:] + GAP * one)
        np.copyto(row, fresh_start, where=row < one)
        row = np.maximum.accumulate(row + gaps) - gaps  # gaps in the item
        np.copyto(row, fresh_start, where=row < one)
        j = int(np.argmax(row >> 32))
        if (best := int(row[j] >> 32)) > score:
            score, first, end = best, one - 1 - int(row[j] & (one - 1)), j
        above = row
    return score, first, end


def most(passage: np.ndarray, item: np.ndarray) -> int:
    """A bound on the score of `align`: of a stretch, words that the other side holds match, all others cost a step."""
    best = []
    for a, b in ((passage, item), (item, passage)):
        sums = np.cumsum(np.append(0, np.where(np.isin(a, b), MATCH, max(MISMATCH, GAP))))
        best.append(int((sums - np.minimum.accumulate(sums)).max()))
    return min(best)


class Items:
    """A block of test items: words as numbers and n-grams by their numbers."""

    def __init__(self, rows: list[tuple[object, str]], n: int):
        self.n = n
        self.vocabulary: dict[str, int] = {}
        self.ids = [i for i, _ in rows]
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(t)], np.int64) for _, t in rows]
        self.base = len(self.vocabulary) + 1
        # codes that would not fit in 62 bits are numbered on the way: of each length below n the items' own n-grams
        self.shorter: list[np.ndarray] | None = [] if self.base**n >= 1 << 62 else None
        if self.shorter is not None:
            for k in range(2, n + 1):
                self.shorter.append(np.unique(np.concatenate([self.pack(w, k, False) for w in self.words if w.size >= k] or [np.zeros(0, np.int64)])))
        found: dict[int, set[int]] = defaultdict(set)
        for k, w in enumerate(self.words):
            for g in self.pack(w, min(n, w.size)).tolist() if w.size else ():
                found[g].add(k)
        self.codes = np.array(sorted(found), np.int64)
        self.of = [sorted(found[g]) for g in self.codes.tolist()]
        self.lengths = sorted({min(n, w.size) for w in self.words if w.size})

    def pack(self, w: np.ndarray, n: int, numbered: bool = True) -> np.ndarray:
        """Codes of the n-grams; 0 where one holds an unknown word. Codes of different n differ."""
        if w.size < n:
            return np.zeros(0, np.int64)
        code, known = np.zeros(w.size - n + 1, np.int64), np.ones(w.size - n + 1, bool)
        for i in range(n):
            part = w[i : w.size - n + 1 + i]
            code = code * self.base + part
            known &= part > 0
            if self.shorter is not None and i and (numbered or i < n - 1):
                table = self.shorter[i - 1]
                at = np.minimum(np.searchsorted(table, code), max(table.size - 1, 0))
                known &= table[at] == code if table.size else False
                code = at
        if self.shorter is not None and numbered:
            code = code * (self.n + 1) + n
        return np.where(known, code, 0)

    def numbers(self, text: str) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words_of(text)], np.int64)

    def hits(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, n-gram numbers) of the items' n-grams in a text."""
        places, grams = [], []
        for n in self.lengths:
            code = self.pack(w, n)
            at = np.flatnonzero(code)
            if at.size:
                where = np.searchsorted(self.codes, code[at])
                where[where == self.codes.size] = 0
                ok = self.codes[where] == code[at]
                places.append(at[ok])
                grams.append(where[ok])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(places), np.concatenate(grams)


def _count(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(items.codes.size, np.int64)
        docs = 0
        for b in batches:
            docs += b.num_rows
            for t in b.column(1):
                if text := t.as_py():
                    held[np.unique(items.hits(items.numbers(text))[1])] += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(held[at], docs))], names=["gram", "n"])

    return run


def seeds(items: Items, held: dict[int, int], docs: int, rare_share: float) -> np.ndarray:
    """Of each n-gram, whether it is a seed."""
    chosen = np.zeros(items.codes.size, bool)
    limit = rare_share * docs
    for w in items.words:
        if not w.size:
            continue
        mine = np.searchsorted(items.codes, items.pack(w, min(items.n, w.size))).tolist()
        # multiples of the golden section keep equal n-grams apart at any distance
        rank = [(held.get(g, 0), i * 0.6180339887498949 % 1) for i, g in enumerate(mine)]
        order = list(dict.fromkeys(mine[i] for i in sorted(range(len(mine)), key=rank.__getitem__)))
        some = {g for i, g in enumerate(order) if held.get(g, 0) <= limit or 2 * i < len(order)}
        some |= {mine[min(i, i + 1, key=rank.__getitem__)] for i in range(len(mine) - 1)}
        chosen[list(some)] = True
    return chosen


def passages(items: Items, chosen: np.ndarray, w: np.ndarray, min_score: float) -> list[tuple[int, float, int, int]]:
    """(item, score, first, end) of a text's passages that align with an item well enough."""
    places, grams = items.hits(w)
    keep = chosen[grams]
    by_item: dict[int, list[int]] = defaultdict(list)
    for p, g in zip(places[keep].tolist(), grams[keep].tolist(), strict=True):
        for k in items.of[g]:
            by_item[k].append(p)
    out = []
    for k, at in by_item.items():
        item = items.words[k]
        at = sorted(at)
        reach = 2 * item.size
        groups = [[at[0]]]
        for p in at[1:]:
            if p - groups[-1][-1] <= item.size:
                groups[-1].append(p)
            else:
                groups.append([p])
        best = None
        floor = min_score * MATCH * item.size
        for g in groups:
            first, end = max(0, g[0] - reach), min(w.size, g[-1] + items.n + reach)
            limit = most(w[first:end], item)
            if limit < floor or best is not None and limit <= best[0]:
                continue
            score, a, b = align(w[first:end], item)
            if best is None or score > best[0]:
                best = (score, first + a, first + b)
        if best and best[0] >= floor:
            out.append((k, best[0] / (MATCH * item.size), best[1], best[2]))
    return out


def _match(items: Items, chosen: np.ndarray, min_score: float, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0), b.column(1), strict=True):
                if text := t.as_py():
                    rows += [(i.as_py(), items.ids[k], s, first, end) for k, s, first, end in passages(items, chosen, items.numbers(text), min_score)]
            if rows:
                cols = list(zip(*rows, strict=True))
                types = [b.schema.field(0).type, id_type, pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "item_id", "score", "first_word", "end_word"])

    return run


def _blocks(rows) -> Iterator[list[tuple[object, str]]]:
    some, words = [], 0
    for r in rows:
        n = len(words_of(r[1]))
        if some and (len(some) >= ITEM_BLOCK or words + n > BLOCK_WORDS):
            yield some
            some, words = [], 0
        some.append((r[0], r[1]))
        words += n
    if some:
        yield some


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = SEED_WORDS, rare_share: float = RARE_SHARE, min_score: float = MIN_SCORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): the best passage of each document for each item it leaks."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    tests = benchmark.select("item_id", "text").filter("text is not null")
    kinds = [rows.schema["doc_id"].dataType.simpleString(), tests.schema["item_id"].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, first_word long, end_word long"
    id_type = pa.int64() if kinds[1] == "bigint" else pa.int32() if kinds[1] == "int" else pa.string()
    found = None
    blocks = _blocks(tests.toLocalIterator())
    block = next(blocks, None)
    while block is not None:
        following = next(blocks, None)
        items = Items(block, n)
        if items.codes.size:
            counts = rows.mapInArrow(_count(items), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
            held = {r.gram: r.n for r in counts}
            chosen = seeds(items, held, held.pop(-1, 0), rare_share)
            some = rows.mapInArrow(_match(items, chosen, min_score, id_type), schema)
            # with several blocks each one's result is written, so that the plan doesn't grow with the blocks
            some = stored(some) if found is not None or following is not None else some
            found = some if found is None else found.unionByName(some)
        block = following
    return found if found is not None else spark.createDataFrame([], schema)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
