"""Positional spans of one token list: terms, ordered nearness, exclusion of overlaps.

Ordered nearness is greedy: clauses are advanced until they stand in order, then each earlier clause
is moved to its latest place that is still in order, and the gaps are summed up. A place once passed
is not looked at again, which is why this is a loop and no set expression.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

Span = tuple[int, int]
Spans = Callable[[Sequence[str]], list[Span]]


def term(words: Sequence[str], patterns: Sequence[str] = ()) -> Spans:
    exact, wild = frozenset(words), [re.compile(p, re.DOTALL) for p in patterns]

    def find(tokens: Sequence[str]) -> list[Span]:
        return [(i, i + 1) for i, t in enumerate(tokens) if t in exact or any(w.match(t) for w in wild)]

    return find


def without(include: Spans, exclude: Spans) -> Spans:
    def find(tokens: Sequence[str]) -> list[Span]:
        some = include(tokens)
        others = exclude(tokens) if some else []
        return [a for a in some if not any(a[0] < b[1] and b[0] < a[1] for b in others)]

    return find


def near(clauses: Sequence[Spans], slop: int) -> Spans:
    def find(tokens: Sequence[str]) -> list[Span]:
        lists = [sorted(c(tokens)) for c in clauses]
        if not all(lists):
            return []
        at, out, last = [0] * len(lists), [], len(lists) - 1
        while True:
            for i in range(1, len(lists)):
                while not lists[i - 1][at[i - 1]] < lists[i][at[i]]:
                    at[i] += 1
                    if at[i] == len(lists[i]):
                        return out
            after = start, end = lists[last][at[last]]
            gaps, over = 0, False
            for i in range(last - 1, -1, -1):
                here = lists[i][at[i]]
                at[i] += 1
                while at[i] < len(lists[i]) and lists[i][at[i]] < after:
                    here = lists[i][at[i]]
                    at[i] += 1
                over |= at[i] == len(lists[i])
                start = here[0]
                gaps += max(0, after[0] - here[1])
                after = here
            if gaps <= slop:
                out.append((start, end))
            if over:
                return out

    return find
