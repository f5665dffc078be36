"""Terms of token arrays, grouped in Arrow batches: tokens become numbers, which are sorted in place of strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tokens that are grouped together in an inverted index, and rows or ids of one batch that is given back.
BLOCK = 2_000_000
GIVEN = 100_000


def numbered(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The different terms in order, and of every token: the number of its term, its row, its place in the row."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten().dictionary_encode()
    order = pc.array_sort_indices(words.dictionary).to_numpy()
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    rows = np.repeat(np.arange(len(lists)), sizes)
    return words.dictionary.take(pa.array(order)), number[words.indices.to_numpy()], rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _first(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    return np.concatenate([np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])), [len(keys)]]) if len(keys) else np.zeros(1, np.int64)


def _different(keys: np.ndarray) -> np.ndarray:
    """The different keys in order; numpy's unique hashes them first, which takes ten times as long."""
    keys = np.sort(keys)
    return keys[_first(keys)[:-1]]


def _plain(column: pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def with_positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tokens) to (term, id, positions), by item."""
    for batch in batches:
        terms, numbers, rows, places = numbered(batch.column(1))
        keys = rows * max(1, len(terms)) + numbers
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = _first(keys)
        places = places[order].astype(np.int32)
        for a in range(0, len(first) - 1, GIVEN):
            cut = first[a : a + GIVEN + 1]
            key = keys[cut[:-1]]
            positions = pa.ListArray.from_arrays(pa.array((cut - cut[0]).astype(np.int32)), pa.array(places[cut[0] : cut[-1]]))
            yield pa.RecordBatch.from_arrays([terms.take(pa.array(key % len(terms))), batch.column(0).take(pa.array(key // len(terms))), positions], ["term", "id", "positions"])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tokens) to (term, df, tf), each term once a batch."""
    for batch in batches:
        terms, numbers, rows, _ = numbered(batch.column(0))
        n = max(1, len(terms))
        held = _different(rows * n + numbers) % n
        df, tf = (np.bincount(x, minlength=len(terms)).astype(np.int64) for x in (held, numbers))
        for a in range(0, len(terms), GIVEN):
            yield pa.RecordBatch.from_arrays([terms.slice(a, GIVEN), pa.array(df[a : a + GIVEN]), pa.array(tf[a : a + GIVEN])], ["term", "df", "tf"])


def _inverted(place: str, block: list[pa.RecordBatch], fields: list[str]) -> Iterator[pa.RecordBatch]:
    block = pa.Table.from_batches(block)
    ids = _plain(block.column("id"))
    for field in fields:
        terms, numbers, rows, _ = numbered(_plain(block.column(field)))
        n = max(1, len(ids))
        pairs = _different(numbers * n + rows)
        first = _first(pairs // n)
        a = 0
        while a < len(first) - 1:  # as many terms as hold GIVEN ids, one at least
            b = max(a + 1, int(np.searchsorted(first, first[a] + GIVEN, "right")) - 1)
            cut = first[a : b + 1]
            held = pa.ListArray.from_arrays(pa.array((cut - cut[0]).astype(np.int32)), ids.take(pa.array(pairs[cut[0] : cut[-1]] % n)))
            yield pa.RecordBatch.from_arrays([pa.array([field] * (b - a)), terms.slice(a, b - a), pa.array([place] * (b - a)), held], ["field", "term", "place", "ids"])
            a = b


def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, id, tokens of a field each) to (field, term, place, ids): blocks of items of one place, each in the order of field
    and term."""
    place, block, held = None, [], 0
    for batch in batches:
        fields = sorted(batch.schema.names[2:])
        cuts = _first(batch.column(0).dictionary_encode().indices.to_numpy())
        for a, b in zip(cuts, cuts[1:]):
            here = batch.column(0)[int(a)].as_py()
            if block and (here != place or held >= BLOCK):
                yield from _inverted(place, block, fields)
                block, held = [], 0
            place = here
            block.append(batch.slice(int(a), int(b - a)))
            held += sum(len(block[-1].column(f).flatten()) for f in fields)
    if block:
        yield from _inverted(place, block, fields)
