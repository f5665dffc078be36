"""Tokenizers as Column functions, and their Python twins for query text.

Simple tokens are upper-cased runs of letters, digits and underscores, cut at 127 characters. Path
tokens keep `/` at a token's end and `.` at its start, so that folders and extensions are terms.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TOKEN = 127
MAX_TERMS = 500_000
#: Stands in for the sharp s while upper-casing, which would make two letters of it.
_HOLD = "\ue000"
_SPACE = r"\s\p{Z}\x85"
_SIMPLE = r"[\p{L}\p{Nd}_]+"
_PATH = rf"[:^]|\.[^{_SPACE}/.:^]*/?|[^{_SPACE}/.:^]+/?|/"


def upper(text: Column) -> Column:
    return F.replace(F.upper(F.replace(text, F.lit("ß"), F.lit(_HOLD))), F.lit(_HOLD), F.lit("ß"))


def simple_tokens(text: Column, cap: int = MAX_TERMS) -> Column:
    found = F.regexp_extract_all(upper(F.coalesce(text, F.lit(""))), F.lit(_SIMPLE), 0)
    return F.transform(F.slice(found, 1, cap), lambda t: F.substring(t, 1, MAX_TOKEN))


def path_tokens(text: Column, cap: int = MAX_TERMS) -> Column:
    found = F.regexp_extract_all(upper(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("/"))), F.lit(_PATH), 0)
    return F.transform(F.slice(found, 1, cap), lambda t: F.substring(t, 1, MAX_TOKEN))


def upper_py(text: str) -> str:
    return "".join(u if len(u := c.upper()) == 1 else c for c in text)


def simple_tokens_py(text: str | None, wildcards: bool = False) -> list[str]:
    pattern = r"[\w*?]+" if wildcards else r"\w+"
    return [t[:MAX_TOKEN] for t in re.findall(pattern, upper_py(text or ""))]


def path_tokens_py(text: str | None) -> list[str]:
    return [t[:MAX_TOKEN] for t in re.findall(r"[:^]|\.[^\s/.:^]*/?|[^\s/.:^]+/?|/", upper_py((text or "").replace("\\", "/")))]


#: Tokenizers by name, for fields of one's own.
TOKENIZERS = {"simple": simple_tokens, "path": path_tokens}
