"""Tokens of the search language: operators, parentheses, field names and terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

#: Operator characters and what they ask of a clause.
OCCUR = {"+": "must", "#": "should", "-": "must_not"}
_END = "()" + "".join(OCCUR)


@dataclass(frozen=True)
class Lexeme:
    kind: str  # operator, left, right, field or term
    text: str


def lex(query: str) -> Iterator[Lexeme]:
    """A quote switches escaping on and off anywhere in a term; an unclosed one ends with the query."""
    at, end = 0, len(query)
    while at < end:
        c = query[at]
        if c.isspace():
            at += 1
            continue
        if c in _END:
            yield Lexeme("operator", OCCUR[c]) if c in OCCUR else Lexeme("left" if c == "(" else "right", c)
            at += 1
            continue
        text, quoted, kind = [], False, "term"
        while at < end:
            c = query[at]
            if c == '"':
                quoted = not quoted
            elif not quoted and c == ":" and text:
                kind = "field"
                at += 1
                break
            elif not quoted and (c.isspace() or c in _END):
                break
            else:
                text.append(c)
            at += 1
        yield Lexeme(kind, "".join(text))
