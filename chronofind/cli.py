"""Command line of the indexer: create|update INDEX REPOSITORY and options.

A value stands behind its option or is glued to it (-r10)."""

from __future__ import annotations

import sys
from dataclasses import dataclass

from chronofind.functions.scalars import HEAD

USAGE = "create|update INDEX REPOSITORY [-r REVISION] [-f REGEX] [-b REGEX] [-n NAME] [-x URI] [-c COMMIT] [-o OPTIMIZE] [-v LEVEL] [-s]"


@dataclass
class Options:
    command: str = ""
    index: str = ""
    repository: str = ""
    max_revision: int = HEAD
    path_filter: str = "/tags/"
    binary_override: str = r".(c|cpp|h|cs|js|vb|txt|html|aspx|ascx|htm|css)$"
    name: str | None = None
    external_uri: str | None = None
    user: str | None = None
    password: str | None = None
    threads: int | None = None
    commit_interval: int = 1000
    optimize: int = 25
    verbosity: int = 0
    single_revision: bool = False


#: Option letters, their fields and kinds.
LETTERS = {
    "r": ("max_revision", int), "f": ("path_filter", str), "b": ("binary_override", str), "u": ("user", str), "p": ("password", str), "t": ("threads", int),
    "o": ("optimize", int), "c": ("commit_interval", int), "n": ("name", str), "x": ("external_uri", str), "v": ("verbosity", int), "s": ("single_revision", None),
}


def parse(args: list[str]) -> Options:
    out, plain, rest = Options(), [], list(args)
    while rest:
        x = rest.pop(0)
        if not x.startswith("-") or len(x) < 2:
            plain.append(x)
            continue
        if x[1] not in LETTERS:
            raise ValueError(f"invalid argument {x}")
        name, kind = LETTERS[x[1]]
        if kind is None:
            setattr(out, name, True)
            continue
        value = x[2:] or (rest.pop(0) if rest else None)
        if value is None:
            raise ValueError(f"option -{x[1]} needs a value")
        setattr(out, name, kind(value))
    if len(plain) != 3 or plain[0].lower() not in ("create", "update"):
        raise ValueError(USAGE)
    out.command, out.index, out.repository = plain[0].lower(), plain[1], plain[2].replace("\\", "/").rstrip("/")
    return out


def main(args: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from chronofind.operators.items import from_properties, indexable
    from chronofind.sources.revision_log import ParquetRepository, enriched
    from chronofind.sources.store import Store
    from chronofind.streaming.updates import apply_batch

    from pyspark.sql import functions as F

    try:
        o = parse(sys.argv[1:] if args is None else args)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    spark = SparkSession.builder.getOrCreate()
    repo, store = ParquetRepository(spark, o.repository), Store(spark, o.index)
    if o.command == "create" and store.exists():
        print("the index exists", file=sys.stderr)
        return 1
    properties = {"repository_id": repo.repository_id(), "repository_local_uri": o.repository, "repository_name": o.name or o.repository.rpartition("/")[2], "repository_external_uri": o.external_uri or o.repository}
    if o.command == "create":
        properties["single_revision"] = o.single_revision

    def enrich(rows):
        rows = from_properties(enriched(rows, repo.nodes(), repo.revisions(0, HEAD)))
        text = indexable(F.col("path"), F.col("size_bytes"), F.col("is_dir"), F.col("mime"), o.binary_override)
        return rows.withColumn("content", F.when(text, F.col("content")))

    with store.writing():
        start, stop = store.properties()["revision"] + 1, min(o.max_revision, repo.youngest())
        for first in range(start, stop + 1, o.commit_interval):
            apply_batch(store, repo.revisions(first, min(first + o.commit_interval - 1, stop)), enrich, o.path_filter, properties)
        # a new index is always compacted, an old one every so many revisions
        if o.command == "create" or o.optimize and (stop % o.optimize == 0 or stop - start >= o.optimize):
            store.compact()
        if start > stop and store.exists():
            store.set_properties(**properties)
    return 0


if __name__ == "__main__":
    sys.exit(main())
