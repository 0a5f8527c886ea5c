"""The document store: manifests in tiers, read permissively, written by tier; sidecars; telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant import schemas
from foliant.operators.corpus import best_variant


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests of all tiers; a file that is no manifest is a miss, not an error."""
    rows = spark.read.schema(schemas.MANIFEST + ", _corrupt_record string").option("mode", "PERMISSIVE").option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
    return rows.filter("_corrupt_record is null and doc_id is not null").drop("_corrupt_record")


def tier(manifests: DataFrame) -> DataFrame:
    """Adds `tier`: canonical if complete, not forced and not degraded; else degraded or variant."""
    complete = F.coalesce(F.col("n_pages") == F.col("source_pages"), F.lit(False))
    degraded = F.coalesce("degraded", F.lit(False))
    return manifests.withColumn("tier", F.when(degraded, "degraded").when(complete & ~F.coalesce("ocr_all", F.lit(False)), "canonical").otherwise("variant"))


def save(manifests: DataFrame, path: str) -> None:
    """Writes manifests as parquet by tier; a tier that is written again is replaced, others stay."""
    spark = manifests.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        tier(manifests).write.partitionBy("tier").mode("overwrite").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def corpus(stored: DataFrame) -> DataFrame:
    """The best stored variant of every document."""
    ranked = stored.withColumn("__tier", F.when(F.col("tier") == "canonical", 0).otherwise(1))
    return best_variant(ranked, [F.asc("__tier"), F.asc("created_at"), F.asc("source_path")]).drop("__tier")


def cache_hits(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """(doc_id, config_hash, ocr_all) that need no work: stored complete under the same settings."""
    complete = stored.filter("n_pages = source_pages").select("doc_id", "config_hash", F.coalesce("ocr_all", F.lit(False)).alias("ocr_all")).distinct()
    return wanted.join(complete, ["doc_id", "config_hash", "ocr_all"], "left_semi")


def refreshed(stored: DataFrame, metadata: DataFrame) -> DataFrame:
    """Stored rows with newer titles where `metadata` (doc_id, title) has one; pages are not touched."""
    fresh = metadata.filter("title is not null").select("doc_id", F.col("title").alias("__title"))
    return stored.join(fresh, "doc_id", "left").withColumn("title", F.coalesce("__title", "title")).drop("__title")


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(path, metadata fields) of `<file>.meta.json`, keyed by the path of the file they describe."""
    rows = spark.read.schema(schemas.METADATA).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.meta.json").json(path)
    return rows.select(F.regexp_replace(F.input_file_name(), r"\.meta\.json$", "").alias("path"), "*")


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TELEMETRY).json(path)


def append_telemetry(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def find_document(stored: DataFrame, prefix: str) -> str:
    """The one document whose id is, or starts with, `prefix` (8 characters or more)."""
    rows = stored.filter((F.col("doc_id") == prefix) | (F.col("doc_id").startswith(prefix) & F.lit(len(prefix) >= 8))).select("doc_id").distinct().limit(2).collect()
    if len(rows) != 1:
        raise LookupError("ambiguous" if rows else "not found")
    return rows[0].doc_id
