"""The stored index: versioned Parquet with a manifest.

Items live in buckets of their path. A commit writes the live items of the buckets it touches anew
and appends versions that were closed, which never change again; then a manifest that lists the
folders of every bucket is put in place by one rename. Readers take the newest manifest, so they see a
commit whole or not at all, and a commit costs what it touches, not what the index holds. One writer
at a time holds the lock file.
"""

from __future__ import annotations

import json
import os
import socket
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofind.functions.scalars import HEAD
from chronofind.operators.items import tokenised

BUCKETS = 64
PROPERTIES = {"revision": 0, "repository_id": "", "repository_name": "", "repository_local_uri": "", "repository_external_uri": "", "single_revision": False}


#: Seconds after which a lock is taken to be left over.
STALE = 6 * 3600.0


class Locked(RuntimeError):
    pass


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._work: list[str] = []
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # the manifest

    def _read(self, name: str) -> str:
        return "\n".join(r[0] for r in self.spark.read.text(f"{self.root}/{name}").collect())

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return []
        return sorted(int(n[:-5]) for f in self._fs.listStatus(folder) if (n := f.getPath().getName()).endswith(".json") and n[:-5].isdigit())

    def manifest(self) -> dict:
        numbers = self._numbers()
        if not numbers:
            return {"version": 0, "live": {}, "closed": [], "properties": dict(PROPERTIES)}
        return json.loads(self._read(f"manifest/{numbers[-1]}.json"))

    def put(self, manifest: dict) -> None:
        """Commits a manifest with the next version."""
        hidden = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(hidden)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._fs.rename(hidden, self._path(f"{self.root}/manifest/{manifest['version']}.json")):
            raise RuntimeError("another writer has committed")

    def _owner(self, lock) -> str:
        stream = self._fs.open(lock)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    @contextmanager
    def writing(self, stale: float = STALE):
        """One writer at a time. A lock that is older than `stale` seconds was left by a writer that is gone, and is taken over."""
        lock = self._path(f"{self.root}/_lock")
        mine = f"{socket.gethostname()} {os.getpid()} {uuid.uuid4().hex}"
        if self._fs.exists(lock):
            owner, _, since = self._owner(lock).rpartition(" ")
            if not since or time.time() - float(since) <= stale:
                raise Locked(f"{owner or 'another writer'} has held the lock since {time.ctime(float(since or 0))}")
            self._fs.delete(lock, False)
        try:
            out = self._fs.create(lock, False)
        except Exception as e:
            raise Locked("another writer has just taken the lock") from e
        out.write(bytearray(f"{mine} {time.time()}".encode()))
        out.close()
        try:
            yield self
        finally:
            if self._fs.exists(lock) and self._owner(lock).startswith(mine):
                self._fs.delete(lock, False)

    # work tables of a commit

    @contextmanager
    def scratch(self):
        """Gives a function that writes a table beside the index and reads it again; all are deleted at the end."""
        made: list[str] = []

        def written(df: DataFrame) -> DataFrame:
            made.append(f"{self.root}/work/{uuid.uuid4().hex}")
            df.write.parquet(made[-1])
            return self.spark.read.schema(df.schema).parquet(made[-1])

        try:
            yield written
        finally:
            for place in made:
                self._fs.delete(self._path(place), True)

    def kept(self, df: DataFrame) -> DataFrame:
        """A work table that stays until the next commit is done."""
        place = f"{self.root}/work/{uuid.uuid4().hex}"
        df.write.parquet(place)
        self._work.append(place)
        return self.spark.read.schema(df.schema).parquet(place)

    # reading

    def exists(self) -> bool:
        return bool(self._numbers())

    def properties(self) -> dict:
        return PROPERTIES | self.manifest()["properties"]

    def set_properties(self, **values) -> None:
        m = self.manifest()
        m["properties"] |= values
        m["version"] += 1
        self.put(m)

    def parquet(self, folders: list[str]) -> DataFrame | None:
        folders = sorted(set(folders))
        if not folders:
            return None
        # the folders are listed one by one; their names are no partitions
        return self.spark.read.option("recursiveFileLookup", True).parquet(*[f"{self.root}/{f}" for f in folders])

    def size(self, folder: str) -> int:
        """Bytes of a folder."""
        return self._fs.getContentSummary(self._path(f"{self.root}/{folder}")).getLength()

    def live(self, buckets: list[int] | None = None) -> DataFrame | None:
        m = self.manifest()["live"]
        found = self.parquet([f for b, f in m.items() if buckets is None or int(b) in buckets])
        return None if found is None else found.drop("bucket")

    def items(self) -> DataFrame | None:
        m = self.manifest()
        parts = [p.drop("bucket") for p in (self.parquet(list(m["live"].values())), self.parquet(m["closed"])) if p is not None]
        return None if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    # writing

    def bucket(self):
        return F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect()]

    def upsert(self, items: DataFrame, properties: dict | None = None, persist: bool = True) -> None:
        """Puts items in, each taking the place of the live one of its id; the ids of closed ones are gone from the live part.
        With single_revision set, closed versions are dropped instead of kept. Items without tokens are tokenised by the tasks that
        write them, so that no token is shuffled. persist: they are read for the buckets, for their live items and
        for the closed ones; a plain scan is better read again."""
        if persist:
            items = items.persist()
        try:
            self._upsert(items, properties)
        finally:
            if persist:
                items.unpersist()
            while self._work:
                self._fs.delete(self._path(self._work.pop()), True)

    def _upsert(self, items: DataFrame, properties: dict | None) -> None:
        m = self.manifest()
        single = (m["properties"] | (properties or {})).get("single_revision", False)
        touched = self.touched(items)
        old = self.live(touched)
        new = items.withColumn("bucket", self.bucket())
        finish = (lambda rows: rows) if "content_tokens" in items.columns else tokenised
        live = finish(_dealt(new.filter(F.col("rev_last") == HEAD)))
        if old is not None:
            live = live.unionByName(_dealt(old.join(items.select("id").distinct(), "id", "left_anti").withColumn("bucket", self.bucket()))).sortWithinPartitions("bucket", "path")
        m["version"] += 1
        folder = f"live/v{m['version']}-{uuid.uuid4().hex[:8]}"
        live.write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        for b in touched:
            place = f"{folder}/bucket={b}"
            if self._fs.exists(self._path(f"{self.root}/{place}")):
                m["live"][str(b)] = place
            else:
                m["live"].pop(str(b), None)
        if not single:
            folder = f"closed/v{m['version']}-{uuid.uuid4().hex[:8]}"
            finish(new.filter(F.col("rev_last") != HEAD)).drop("bucket").write.parquet(f"{self.root}/{folder}")
            m["closed"].append(folder)
        m["properties"] |= properties or {}
        self.put(m)

    def compact(self, file_rows: int = 1_000_000) -> None:
        """Rewrites closed versions as one folder in path order."""
        m = self.manifest()
        closed = self.parquet(m["closed"])
        if closed is None or len(m["closed"]) < 2:
            return
        m["version"] += 1
        folder = f"closed/v{m['version']}-{uuid.uuid4().hex[:8]}"
        closed.repartitionByRange("path").sortWithinPartitions("path", "rev_first").write.option("maxRecordsPerFile", file_rows).parquet(f"{self.root}/{folder}")
        m["closed"] = [folder]
        self.put(m)


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows by their buckets, in the order of their paths; a large bucket is dealt to several tasks, a file each."""
    return rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "path")


def open_stores(spark: SparkSession, paths: list[str]) -> list[Store]:
    """The stores among the paths, each tried as it is and with `/index`; what can't be opened is passed over."""
    out = []
    for path in paths:
        for place in (path, f"{path.rstrip('/')}/index"):
            try:
                store = Store(spark, place)
                if store.exists():
                    out.append(store)
                    break
            except Exception:  # an index list may name places that are gone
                continue
    return out
