"""Small files and bucketed tables on any file system that Spark can write to."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds after which a lock that its writer never gave back is broken.
LEASE = 24 * 3600


class Folder:
    """Text files below one address: read whole, written and replaced at once."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        self._fs.mkdirs(self._path(""))

    def address(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.address(name))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def age(self, name: str) -> float:
        return time.time() - self._fs.getFileStatus(self._path(name)).getModificationTime() / 1000

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str, replace: bool = False) -> bool:
        """Writes a new file; false if there is one already and it is not to be replaced."""
        try:
            out = self._fs.create(self._path(name), replace)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception).lower():
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def replace(self, name: str, text: str) -> None:
        """Readers see the old text or the new one."""
        fresh = f"{name}.{uuid.uuid4().hex}"
        self.create(fresh, text)
        overwrite = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = overwrite
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._path(fresh), self._path(name), options)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    @contextmanager
    def lock(self, name: str = "LOCK", lease: float = LEASE) -> Iterator[None]:
        """One holder at a time; another is refused until the lock is given back or its lease is over."""
        if self.exists(name) and self.age(name) > lease:
            self.delete(name)
        if not self.create(name, uuid.uuid4().hex):
            raise RuntimeError(f"{self.root} is being written by another process")
        try:
            yield
        finally:
            self.delete(name)


class BucketTable:
    """A table in buckets, each a folder of parquet files, and one small file that says which folders count.

    A change rewrites the buckets it touches and no others; readers see the state before or after it. Folders that no
    state names any more stay until `clean`.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, pointer: str = "CURRENT"):
        self.spark, self.folder, self.buckets, self.pointer = spark, Folder(spark, root), buckets, pointer

    def bucket(self, *keys: str):
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def state(self) -> dict | None:
        """The committed state: generation, parts (bucket to folder) and what else was kept with it; null before the first."""
        text = self.folder.read(self.pointer)
        return None if text is None else json.loads(text)

    def read(self, state: dict | None = None, only: Iterable[int] | None = None) -> DataFrame | None:
        """The rows of a state, or of some of its buckets; null where there are none."""
        state = state or self.state()
        wanted = None if only is None else {str(b) for b in only}
        paths = [self.folder.address(p) for b, p in sorted((state or {}).get("parts", {}).items()) if wanted is None or b in wanted]
        return self.spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None

    def replace(self, rows: DataFrame, touched: Iterable[int], order: list[str], generation: str | None = None, **kept) -> dict:
        """Makes `rows` (with a column `bucket`) what the touched buckets hold, and commits. The same generation may be
        written again."""
        generation, before = generation or uuid.uuid4().hex, self.state() or {"parts": {}}
        home = f"snapshots/{generation}"
        rows.repartition("bucket").sortWithinPartitions("bucket", *order).write.partitionBy("bucket").mode("overwrite").parquet(self.folder.address(home))
        fresh = {n.removeprefix("bucket="): f"{home}/{n}" for n in self.folder.names(home) if n.startswith("bucket=")}
        gone = {str(b) for b in touched}
        parts = {b: p for b, p in before["parts"].items() if b not in gone} | fresh
        state = {"generation": generation, "parts": parts} | kept
        self.folder.replace(self.pointer, json.dumps(state))
        return state

    def clean(self, least_age: float = LEASE) -> list[str]:
        """Deletes folders of snapshots that no committed part lies in, unless they are younger than `least_age` seconds
        and may be read or under way. Returns their names."""
        used = {p.split("/")[1] for p in (self.state() or {"parts": {}})["parts"].values()}
        orphans = [n for n in self.folder.names("snapshots") if n not in used and self.folder.age(f"snapshots/{n}") >= least_age]
        for n in orphans:
            self.folder.delete(f"snapshots/{n}")
        return orphans
