"""Highlighting of content terms, as Column expressions over the stored text."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronofind.functions.analyzer import upper
from chronofind.functions.scalars import html_encode, let
from chronofind.plans.compiler import content_words
from chronofind.plans.parser import Group

_WORD = r"([\p{L}\p{Nd}_]+)"


class Highlighter(ABC):
    def __init__(self, tree: Group):
        self.words, self.wild = content_words(tree)

    def is_term(self, token: Column) -> Column:
        up = upper(token)
        out = up.isin(sorted(self.words)) if self.words else F.lit(False)
        return out | up.rlike("(?s)" + "|".join(sorted(self.wild))) if self.wild else out

    def marked(self, text: Column) -> Column:
        """HTML with <B> around the terms. The text is cut at its words, which alternate with what is between."""
        words = F.regexp_extract_all(text, F.lit(_WORD), 0)
        gaps = F.split(text, r"[\p{L}\p{Nd}_]+", -1)
        shown = F.transform(words, lambda w: F.when(self.is_term(w), F.concat(F.lit("<B>"), w, F.lit("</B>"))).otherwise(w))
        return F.array_join(F.flatten(F.zip_with(gaps, shown, lambda g, w: F.array(html_encode(g), F.coalesce(w, F.lit(""))))), "")

    def score(self, text: Column) -> Column:
        """Different terms in a piece of text."""
        found = F.filter(F.regexp_extract_all(text, F.lit(_WORD), 0), self.is_term)
        return F.size(F.array_distinct(F.transform(found, upper)))

    @abstractmethod
    def fragments(self, content: Column) -> Column: ...


class LineHighlight(Highlighter):
    """The best lines with their neighbours and numbers; lines keep their ends."""

    def __init__(self, tree: Group, best: int = 3, around: int = 2):
        super().__init__(tree)
        self.best, self.around = best, around

    def fragments(self, content: Column) -> Column:
        text = F.coalesce(content, F.lit(""))
        ends = F.regexp_extract_all(text, F.lit(r"\r\n|\r|\n"), 0)
        return let(F.split(text, r"\r\n|\r|\n", -1), lambda lines: let(ends, lambda e: self._of_lines(lines, e)))

    def _of_lines(self, lines: Column, ends: Column) -> Column:
        scored = F.filter(F.transform(lines, lambda x, i: F.struct((-self.score(x)).alias("s"), i.alias("i"))), lambda x: x.s < 0)
        top = F.slice(F.array_sort(scored), 1, self.best)
        n = F.size(lines)
        near = F.flatten(F.transform(top, lambda x: F.sequence(F.greatest(F.lit(0), x.i - self.around), F.least(n - 1, x.i + self.around))))

        def shown(numbers: Column) -> Column:
            # as wide as the largest number counted from 0
            digits = F.length(F.array_max(numbers).cast("string"))

            def line(i: Column, k: Column) -> Column:
                gap = F.when((k > 0) & (F.get(numbers, k - 1) != i - 1), F.lit(" .. \n")).otherwise(F.lit(""))
                number = (i + 1).cast("string")
                label = F.concat(F.lit("<span class='line'>L"), F.lpad(number, F.greatest(digits, F.length(number)), F.lit("0")), F.lit(": </span>"))
                return F.concat(gap, label, self.marked(F.get(lines, i)), F.coalesce(F.get(ends, i), F.lit("")))

            return F.array_join(F.transform(numbers, line), "")

        return let(F.array_sort(F.array_distinct(near)), shown)


class SimpleHighlight(Highlighter):
    """The best pieces of a fixed length, in text order."""

    def __init__(self, tree: Group, best: int = 3, length: int = 100, separator: str = " ... "):
        super().__init__(tree)
        self.best, self.length, self.separator = best, length, separator

    def fragments(self, content: Column) -> Column:
        text = F.coalesce(content, F.lit(""))
        pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{self.length}}}(?![\p{{L}}\p{{Nd}}_])|(?s).{{1,{self.length}}}"), 0)
        return let(pieces, self._of_pieces)

    def _of_pieces(self, pieces: Column) -> Column:
        scored = F.filter(F.transform(pieces, lambda x, i: F.struct((-self.score(x)).alias("s"), i.alias("i"))), lambda x: x.s < 0)
        top = F.array_sort(F.transform(F.slice(F.array_sort(scored), 1, self.best), lambda x: x.i))
        return F.array_join(F.transform(top, lambda i: self.marked(F.get(pieces, i))), self.separator)
