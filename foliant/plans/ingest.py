"""Files to documents: identity, kind, conversion to titled segments, and the manifest of each document."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import config_hash
from foliant.sources import files, headings, html, latex
from foliant.sources.store import tier
from foliant.tables import materialize

VERSION = "1"
#: (doc_id, ord, title, text) of the files (path, doc_id, content) of one kind.
Converter = Callable[[DataFrame], DataFrame]


def of_text(rows: DataFrame) -> DataFrame:
    """Markdown is cut at its headings, other text is one segment."""
    texts = rows.select("doc_id", files.suffix(F.col("path")).isin(".md", ".markdown").alias("marked"), files.decode_text("content").alias("text"))
    cut = headings.split_markdown(texts.filter("marked"), "doc_id", "text")
    return cut.unionByName(texts.filter("not marked").select("doc_id", F.lit(0).alias("ord"), F.lit(None).cast("string").alias("title"), "text"))


def of_pages(rows: DataFrame) -> DataFrame:
    """HTML pages; other office formats need a reader of their own."""
    pages = rows.filter(F.col("mime") == "text/html").select("doc_id", files.decode_text("content").alias("text"))
    return html.converted(pages, "doc_id", "text").select("doc_id", F.lit(0).alias("ord"), "title", "text")


def of_latex(rows: DataFrame) -> DataFrame:
    """LaTeX sources, flattened and cut at sections."""
    members = materialize(latex.unpack(rows.select(F.col("doc_id").alias("path"), "content")))
    mains = latex.main_files(latex.decoded(members))
    return latex.flat_sources(members, mains).filter("text is not null and text != ''").select(F.col("path").alias("doc_id"), "ord", "title", "text")


CONVERTERS: dict[str, Converter] = {"text": of_text, "office": of_pages, "latex": of_latex}


def ingest(spark: SparkSession, paths: Sequence[str], converters: dict[str, Converter] | None = None, first: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(manifests, segments, failures) of all files below `paths`.

    A file is a document by its bytes; equal files are one. Kinds without a converter, and files that gave no segment,
    are failures (path, problem). `first` keeps the first segments only, and makes the manifest a partial one.
    """
    known = converters or CONVERTERS
    found = files.with_identity(files.detected(files.list_inputs(spark, paths))).select("path", "length", "content", "doc_id", "kind", "mime", "problem")
    once = materialize(found.groupBy("doc_id").agg(F.min(F.struct("path", "length", "kind", "mime", "problem", "content")).alias("f")).select("doc_id", "f.*"))
    parts = [convert(once.filter(F.col("kind") == kind)).select("doc_id", F.col("ord").cast("int").alias("seg_index"), "title", "text").withColumn("method", F.lit(kind)) for kind, convert in known.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    whole = materialize(whole)
    segments = whole if first is None else whole.filter(F.col("seg_index") < first)
    sizes = whole.groupBy("doc_id").agg(F.count("*").cast("int").alias("source_pages"), F.min_by("title", "seg_index").alias("title")).join(segments.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_pages")), "doc_id")
    rows = once.drop("content").join(sizes, "doc_id", "left")
    done = rows.filter("n_pages is not null").select(
        "doc_id", F.col("path").alias("source_path"), F.substring_index("path", "/", -1).alias("source_name"), F.col("kind").alias("source_kind"), "mime", F.col("length").alias("size_bytes"), "n_pages", "source_pages", "title",
        F.lit(VERSION).alias("pipeline_version"), config_hash(F.lit(VERSION), F.col("kind")).alias("config_hash"), F.lit(False).alias("degraded"), F.lit(False).alias("ocr_all"), F.current_timestamp().alias("created_at"),
    )
    failures = rows.filter("n_pages is null").select("path", F.coalesce("problem", F.concat(F.lit("no converter gave text for kind "), "kind")).alias("problem"))
    return tier(done), segments, failures
