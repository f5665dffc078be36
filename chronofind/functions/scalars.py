"""Scalar functions on hits: packed sizes, revisions, paths, links, syntax brushes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once per row: inside a lambda a column expression would be worked out anew
    for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


HEAD = 99_999_999
ALL = 0
_UNITS = (("b", " bytes", 0), ("k", " kb", 10), ("m", " mb", 20), ("z", " gb", 30))


def packed_size(size: Column) -> Column:
    """A size as a tag and three hexadecimal digits, which sort like the sizes."""
    out = F.lit("z001")
    for tag, _, shift in reversed(_UNITS[:3]):
        out = F.when(size < 1 << (shift + 10), F.concat(F.lit(tag), F.lpad(F.hex(F.shiftright(size, shift)), 3, "0"))).otherwise(out)
    return F.when(size.isNotNull(), out)


def size_display(size: Column) -> Column:
    out = F.concat(F.shiftright(size, 30).cast("string"), F.lit(_UNITS[3][1]))
    for _, name, shift in reversed(_UNITS[:3]):
        out = F.when(size < 1 << (shift + 10), F.concat(F.shiftright(size, shift).cast("string"), F.lit(name))).otherwise(out)
    return out


def unpacked_size(packed: Column) -> Column:
    """The largest size of a packed class; 0 for null or empty; an unknown tag is an error."""
    value = F.conv(F.substring(packed, 2, 8), 16, 10).cast("long")
    out = F.raise_error(F.concat(F.lit("bad packed size "), packed)).cast("long")
    for tag, _, shift in _UNITS:
        out = F.when(F.substring(packed, 1, 1) == tag, (value + 1) * (1 << shift) - 1).otherwise(out)
    return F.when(F.coalesce(packed, F.lit("")) == "", F.lit(0).cast("long")).otherwise(out)


def revision_text(revision: Column) -> Column:
    return F.lpad(revision.cast("string"), 8, "0")


def pretty_revision(revision: Column) -> Column:
    return F.when(revision == HEAD, F.lit("head")).when(revision == 0, F.lit("")).otherwise(revision.cast("string"))


def folder(path: Column) -> Column:
    """Null for a path without a slash."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", ""))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def timestamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def escaped(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def uri(base: Column, path: Column, revision: Column | None = None) -> Column:
    out = F.concat(base, F.array_join(F.transform(F.split(path, "/"), escaped), "/"))
    return out if revision is None else F.concat(out, F.lit("?r="), revision.cast("string"))


def html_encode(text: Column) -> Column:
    for raw, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def change_text(change: Column, path: Column, revision: Column) -> Column:
    return F.concat(F.rpad(change, 7, " "), path, F.lit("@"), revision.cast("string"))


# Syntax brushes and the file extensions they are for, tried in this order.
BRUSHES = (
    ("AS3", "as3"),
    ("ColdFusion", "cfm|cfml"),
    ("Cpp", "c|h|hpp|cpp|inl"),
    ("CSharp", "cs"),
    ("Css", "css"),
    ("Delphi", "pas"),
    ("Diff", "diff|patch"),
    ("Erlang", "rl"),
    ("Groovy", "groovy"),
    ("Java", "java"),
    ("JavaFX", "jvx"),
    ("JScript", "js"),
    ("Perl", "perl|pl"),
    ("Php", "php"),
    ("PowerShell", "ps1"),
    ("Python", "py"),
    ("Ruby", "rb|ruby"),
    ("Sass", "sass|scss"),
    ("Scala", "scl|scala"),
    ("Sql", "sql"),
    ("Vb", "vb"),
    ("Xml", "(.*ml)|(.*proj)|(targets)"),
    ("Plain", ".*"),
)


def brush(path: Column) -> Column:
    extension = F.substring_index(path, ".", -1)
    out = F.lit(None).cast("string")
    for name, pattern in reversed(BRUSHES):
        out = F.when(extension.rlike(f"(?is)^({pattern})$"), F.lit(name)).otherwise(out)
    return out


def link(item_id: Column) -> Column:
    return F.concat(F.lit("View.aspx?id="), escaped(item_id))
