"""Clause trees to Column predicates over items.

Cheap tests come first: exact words of a phrase are looked up in the token array before places
are compared. Plain phrases, and two plain phrases with a gap between them, are one regular expression over the
tokens joined by blanks (no token holds one). Other phrases with gaps run the span kernel in an Arrow-batched
function, which sees only the token lists that passed the lookups.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronofind.operators import spans

from .parser import Group, Leaf
from .phrase import Near, Term, fixed_length, variants, wildcard_body, wildcard_regex

MAX_WILDCARD_TERMS = 1000
#: (field, regular expressions) -> number of different terms of the index that match
Dictionary = Callable[[str, list[str]], int]


#: Fields whose terms are kept in an inverted index.
POSTED = ("content", "path", "message", "externals")


@dataclass(frozen=True)
class Has:
    """One of the words, or a term that one of them stands for, in a field."""

    field: str
    words: tuple[str, ...]
    wild: bool


@dataclass(frozen=True)
class All:
    parts: tuple[Has | All | Any, ...]


@dataclass(frozen=True)
class Any:
    parts: tuple[Has | All | Any, ...]


class TooManyTerms(ValueError):
    pass


def tokens_of(field: str) -> Column:
    if field.startswith("prop:"):
        return F.coalesce(F.try_element_at(F.col("prop_tokens"), F.lit(field[5:])), F.array().cast("array<string>"))
    return F.col(f"{field}_tokens")


class Compiler:
    def __init__(self, dictionary: Dictionary | None = None, strict: bool = False):
        """dictionary: needed for phrases that mix gaps and wildcards; strict: it also bounds wildcards."""
        self.dictionary, self.strict = dictionary, strict
        self._counts: dict[tuple[str, ...], int] = {}

    def predicate(self, node: Group | Leaf) -> Column:
        if isinstance(node, Leaf):
            return self.leaf(node)
        must, should, must_not = ([self.predicate(n) for o, n in node.clauses if o == x] for x in ("must", "should", "must_not"))
        if not must and not should:
            return F.lit(False)
        wanted = reduce(and_, must) if must else reduce(or_, should)
        return reduce(and_, [~p for p in must_not], wanted)

    def needs(self, node: Group | Leaf) -> Has | All | Any | None:
        """What terms an item must hold to be found; None: nothing is known of that."""
        if isinstance(node, Leaf):
            if node.field not in POSTED:
                return None
            return All(tuple(Has(node.field, tuple(self.words(node.field, t, a, b)), t.wild) for t, a, b in terms_of(node.value)))
        must, should = ([self.needs(n) for o, n in node.clauses if o == x] for x in ("must", "should"))
        if must:
            known = tuple(p for p in must if p is not None)
            return All(known) if known else None
        return None if None in should else Any(tuple(should))

    def leaf(self, leaf: Leaf) -> Column:
        if leaf.field == "author":
            return F.coalesce(F.col("author") == leaf.value, F.lit(False))
        if leaf.field == "mime":
            return F.coalesce(F.col("mime").rlike("(?s)" + wildcard_regex(leaf.value)), F.lit(False))
        return self.phrase(leaf.field, leaf.value)

    def words(self, field: str, term: Term, is_first: bool, is_last: bool) -> list[str]:
        out = variants(term.text, is_first, is_last) if field in ("path", "externals") else [term.text]
        if term.wild and self.strict and self.count(field, term, is_first, is_last) > MAX_WILDCARD_TERMS:
            raise TooManyTerms("Too many matches for wildcard query, please be more specific.")
        return out

    def holds(self, field: str, term: Term, is_first: bool, is_last: bool) -> Column:
        tokens = tokens_of(field)
        words = self.words(field, term, is_first, is_last)
        if term.wild:
            return F.array_join(tokens, " ").rlike(_whole(_either(words)))
        return reduce(or_, [F.array_contains(tokens, w) for w in words])

    def phrase(self, field: str, phrase: Term | Near) -> Column:
        if isinstance(phrase, Term):
            return self.holds(field, phrase, True, True)
        tokens = tokens_of(field)
        lookups = reduce(and_, [self.holds(field, t, a, b) for t, a, b in terms_of(phrase) if not t.wild], F.lit(True))
        plain = self.plain(field, phrase)
        if plain is not None:
            return lookups & F.coalesce(F.when(lookups, F.array_join(tokens, " ")).rlike(_whole(plain)), F.lit(False))
        find = self.spans(field, phrase, True, True)

        @F.pandas_udf("boolean")
        def matches(lists):
            return lists.map(lambda x: x is not None and bool(find(x)))

        return lookups & matches(F.when(lookups, tokens))

    def plain(self, field: str, phrase: Near) -> str | None:
        """The phrase as a regular expression, if it is that: words in a row, or two such parts with a gap between
        them that can't overlap. The nearest pairs of two parts of fixed length are what the span kernel goes
        through, so that there is a match if any pair is near enough; with three parts it passes some over."""
        parts = [fixed_length(phrase)] if fixed_length(phrase) else [fixed_length(c) for c in phrase.children]
        if None in parts or len(parts) > 2:
            return None
        at, n, found = 0, sum(map(len, parts)), []
        for p in parts:
            found.append([(self.words(field, t, at + i == 0, at + i == n - 1), t.wild) for i, t in enumerate(p)])
            at += len(p)
        if len(found) == 2 and not _apart(*found):
            return None
        return f"(?: [^ ]++){{0,{phrase.gap}}}? ".join(" ".join(_either(w) for w, _ in p) for p in found)

    def count(self, field: str, node: Term | Near, is_first: bool, is_last: bool) -> int:
        """Terms of a part, repeated ones counted again."""
        if isinstance(node, Near):
            last = len(node.children) - 1
            return sum(self.count(field, c, i == 0, i == last) for i, c in enumerate(node.children))
        words = variants(node.text, is_first, is_last) if field in ("path", "externals") else [node.text]
        if not node.wild:
            return len(words)
        if self.dictionary is None:
            raise ValueError("a phrase with gaps and wildcards needs the index's terms")
        if (field, *words) not in self._counts:  # asked for by the bound, the terms needed and the test
            self._counts[field, *words] = max(1, self.dictionary(field, [wildcard_regex(w) for w in words]))
        return self._counts[field, *words]

    def spans(self, field: str, node: Term | Near, is_first: bool, is_last: bool) -> spans.Spans:
        if isinstance(node, Term):
            words = self.words(field, node, is_first, is_last)
            return spans.term((), [wildcard_regex(w) for w in words]) if node.wild else spans.term(words)
        last = len(node.children) - 1
        parts = [self.spans(field, c, i == 0, i == last) for i, c in enumerate(node.children)]
        if node.gap:
            # neighbours must not overlap: the side with fewer terms gives way, the left one if they are equal;
            # from left to right, on the parts as they are by then
            sizes = [self.count(field, c, i == 0, i == last) for i, c in enumerate(node.children)]
            for i in range(len(parts)):
                if i < last and sizes[i] <= sizes[i + 1]:
                    parts[i] = spans.without(parts[i], parts[i + 1])
                if i > 0 and sizes[i - 1] > sizes[i]:
                    parts[i] = spans.without(parts[i], parts[i - 1])
        return spans.near(parts, node.gap)


def _either(words: list[str]) -> str:
    return "(?:" + "|".join(wildcard_body(w, "[^ ]") for w in words) + ")"


def _whole(pattern: str) -> str:
    """The pattern between ends of tokens."""
    return f"(?<![^ ]){pattern}(?![^ ])"


def _apart(left: list[tuple[list[str], bool]], right: list[tuple[list[str], bool]]) -> bool:
    """Whether no token can belong to both parts."""
    for some, wild in left:
        for others, wild_too in right:
            if wild and wild_too:
                return False
            patterns, exact = (some, others) if wild else (others, some)
            if any(re.fullmatch(wildcard_body(p), w, re.DOTALL) for p in patterns for w in exact):
                return False
    return True


def terms_of(node: Term | Near, is_first: bool = True, is_last: bool = True):
    if isinstance(node, Term):
        yield node, is_first, is_last
    else:
        last = len(node.children) - 1
        for i, c in enumerate(node.children):
            yield from terms_of(c, i == 0, i == last)


def content_words(node: Group | Leaf) -> tuple[set[str], set[str]]:
    """Words and wildcard expressions of the content terms that a hit may show."""
    words: set[str] = set()
    wild: set[str] = set()
    if isinstance(node, Leaf):
        if node.field == "content":
            for t, _, _ in terms_of(node.value):
                (wild if t.wild else words).add(wildcard_regex(t.text) if t.wild else t.text)
    else:
        for occur, n in node.clauses:
            if occur != "must_not":
                a, b = content_words(n)
                words |= a
                wild |= b
    return words, wild
