"""Incremental maintenance of a chunk index by content key, with committed snapshots.

Chunk versions are only ever appended, in buckets of documents; the newest version of a document counts, a tombstone
removes it. A commit rewrites the buckets that have new versions as folders of a new snapshot and then moves one pointer
file, so readers see the old or the new state and a small change costs a small commit.
"""

from __future__ import annotations

import json
import uuid
from contextlib import AbstractContextManager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources.shared import BucketTable
from foliant.tables import materialize


def diff(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """(doc_id, state, key): new, changed, unchanged or stale documents from two tables (doc_id, key)."""
    a, b = current.select("doc_id", F.col("key").alias("a")), indexed.select("doc_id", F.col("key").alias("b"))
    both = a.withColumn("__here", F.lit(True)).join(b.withColumn("__there", F.lit(True)), "doc_id", "full_outer")
    state = F.when(F.col("__there").isNull(), "new").when(F.col("__here").isNull(), "stale").when(F.col("a").eqNullSafe(F.col("b")), "unchanged").otherwise("changed")
    return both.select("doc_id", state.alias("state"), F.col("a").alias("key"))


def build_report(changes: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """One row: documents added, updated, unchanged and pruned, and chunks to embed."""
    count = lambda s: F.sum(F.when(F.col("state") == s, 1).otherwise(0)).cast("bigint")
    report = changes.agg(*(F.coalesce(count(s), F.lit(0)).alias(n) for s, n in (("new", "added"), ("changed", "updated"), ("unchanged", "unchanged"), ("stale", "pruned"))))
    if chunks is None:
        return report
    todo = chunks.join(changes.filter("state in ('new', 'changed')"), "doc_id", "left_semi").agg(F.count("*").alias("chunks_to_embed"))
    return report.crossJoin(F.broadcast(todo))  # one row each


def newest_versions(versions: DataFrame) -> DataFrame:
    """Of version rows (doc_id, seq, stem, deleted, …) those of each document's largest (seq, stem), tombstones dropped."""
    best = versions.groupBy("doc_id").agg(F.max(F.struct("seq", "stem")).alias("__best"))
    return versions.join(best, "doc_id").filter((F.col("seq") == F.col("__best.seq")) & (F.col("stem") == F.col("__best.stem")) & ~F.coalesce("deleted", F.lit(False))).drop("__best")


class ChunkIndex:
    """A folder with `versions/` (appended parquet by bucket), `snapshots/<generation>/bucket=…` and the file `CURRENT`."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.table = spark, BucketTable(spark, root, buckets)

    def writer(self) -> AbstractContextManager[None]:
        """One writer at a time; a second one is refused."""
        return self.table.folder.lock()

    def versions(self) -> DataFrame | None:
        if not self.table.folder.exists("versions"):
            return None
        return self.spark.read.option("mergeSchema", "true").parquet(self.table.folder.address("versions"))

    def live(self) -> DataFrame | None:
        v = self.versions()
        return None if v is None else newest_versions(v).drop("bucket")

    def keys(self) -> DataFrame:
        live = self.live()
        if live is None:
            return self.spark.createDataFrame([], "doc_id string, key string")
        return live.select("doc_id", "key").distinct()

    def _append(self, rows: DataFrame) -> None:
        v = self.versions()
        last = (v.agg(F.max("seq")).first()[0] or 0) if v is not None else 0
        new = rows.withColumns({"seq": F.lit(last + 1).cast("bigint"), "stem": F.lit(uuid.uuid4().hex), "bucket": self.table.bucket("doc_id")})
        new.repartition("bucket").write.partitionBy("bucket").mode("append").parquet(self.table.folder.address("versions"))

    def upsert(self, chunks: DataFrame) -> None:
        """Replaces the documents in `chunks` (doc_id, key, start, text, …)."""
        with self.writer():
            self._append(chunks.withColumn("deleted", F.lit(False)))

    def remove(self, documents: DataFrame) -> None:
        with self.writer():
            self._append(documents.select("doc_id").distinct().withColumn("deleted", F.lit(True)))

    def commit(self) -> str:
        """Rewrites the buckets with versions since the last commit, ordered by document and place, and makes them
        current."""
        with self.writer():
            state, versions = self.table.state() or {"seq": 0}, self.versions()
            if versions is None:
                state = {"generation": uuid.uuid4().hex, "parts": {}, "seq": 0}
                self.table.folder.replace(self.table.pointer, json.dumps(state))
                return state["generation"]
            touched = [r.bucket for r in versions.filter(F.col("seq") > state["seq"]).select("bucket").distinct().collect()]  # at most as many as buckets
            last = versions.agg(F.max("seq")).first()[0] or 0
            own = newest_versions(versions.filter(F.col("bucket").isin(touched))).drop("deleted")
            return self.table.replace(own, touched, ["doc_id", *(["start"] if "start" in own.columns else [])], seq=last)["generation"]

    def search_state(self) -> DataFrame | None:
        """The committed snapshot, resolved once; null before the first commit and where it is empty."""
        return self.table.read()

    def clean(self, least_age: float = 24 * 3600) -> list[str]:
        """Deletes snapshot folders that are not current; see `BucketTable.clean`."""
        with self.writer():
            return self.table.clean(least_age)

    def pending(self) -> bool:
        """Whether stored versions differ from the committed snapshot."""
        live, seen = self.live(), self.search_state()
        if live is None or seen is None:
            return live is not None and seen is None
        a, b = live.select("doc_id", "seq", "stem").distinct(), seen.select("doc_id", "seq", "stem").distinct()
        return not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty())

    def stats(self) -> DataFrame:
        """One row: documents and chunks stored and searchable, and whether a commit is pending."""
        count = lambda d: (0, 0) if d is None else tuple(d.agg(F.countDistinct("doc_id"), F.count("*")).first())
        a, b = count(self.live()), count(self.search_state())
        return self.spark.createDataFrame([(*a, *b, self.pending())], "documents long, chunks long, searchable_documents long, searchable_chunks long, pending boolean")


def update_index(index: ChunkIndex, chunks: DataFrame, keys: DataFrame) -> DataFrame:
    """Brings the index to `chunks` of the documents in `keys` (doc_id, key): only new and changed documents are
    written, stale ones removed, and a snapshot is committed if anything changed. Returns the build report."""
    changes = materialize(diff(keys, index.keys()))
    report = build_report(changes).collect()
    todo = changes.filter("state in ('new', 'changed')").select("doc_id", "key")
    stale = changes.filter("state = 'stale'").select("doc_id")
    if not todo.isEmpty():
        index.upsert(chunks.join(todo, "doc_id"))
    if not stale.isEmpty():
        index.remove(stale)
    if index.pending() or index.search_state() is None:
        index.commit()
    return index.spark.createDataFrame(report)
