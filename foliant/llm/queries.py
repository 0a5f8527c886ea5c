"""The training-data operators applied to whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import capping, leakage, leximin, markup, packing, reading, repetition, scans, splitting, truncation
from foliant.operators.joins import salted_left_join
from foliant.tables import load, load_even

Query = Callable[[SparkSession, str], DataFrame]


# 1 ------------------------------------------------------------------------------------------------- markup residue


def _marked_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of segments and chunks: table_name, row_id, doc_id, text."""
    segments = load(spark, d, "segments").select(F.lit("segments").alias("table_name"), F.col("segment_id").alias("row_id"), "doc_id", "text")
    chunks = load(spark, d, "chunks").select(F.lit("chunks").alias("table_name"), F.col("chunk_id").alias("row_id"), "doc_id", "text")
    return segments.unionByName(chunks)


def p1_method(spark: SparkSession, d: str) -> DataFrame:
    """Consensus host paths over both tables; the host is where a document came from: the folder and the ending of its
    source path."""
    path = F.min("source_path")
    kinds = load(spark, d, "manifests").groupBy("doc_id").agg(F.concat(F.regexp_extract(path, "^(.*/)?", 0), F.lit("*"), F.regexp_extract(path, r"\.[^./]*$", 0)).alias("host"))
    rows = salted_left_join(_marked_rows(spark, d).withColumn("key", F.concat_ws(":", "table_name", "row_id")), kinds, ["doc_id"], F.col("key"))
    found = markup.host_paths(rows, "key", "text", "host")
    return found.select(F.split("key", ":")[0].alias("table_name"), F.split("key", ":")[1].cast("bigint").alias("row_id"), "host", "paths", "text")


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    """Clean text of every row of both tables."""
    rows = _marked_rows(spark, d).withColumn("key", F.concat_ws(":", "table_name", "row_id"))
    done = markup.clean_texts(rows, "key", "text")
    return done.select(F.split("key", ":")[0].alias("table_name"), F.split("key", ":")[1].cast("bigint").alias("row_id"), "had_markup", "text")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _marked_rows(spark, d).filter(markup.has_markup(F.col("text"))).select("table_name", "row_id")


# 2 ------------------------------------------------------------------------------------------------- repetition


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    """The repeated share of every text."""
    return repetition.measured(load_even(spark, d, "ocr_results"), "result_id").select("result_id", F.round("share", 6).alias("share"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive(load_even(spark, d, "ocr_results"), "result_id", "text").select("result_id")


# 3 ------------------------------------------------------------------------------------------------- truncation


def _cut(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation(
        load_even(spark, d, "ocr_results"), "result_id", "text", "candidate", {"chars": F.length("text"), "bytes": F.octet_length("text"), "tokens": F.col("gen_tokens")}, "page_no"
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d).filter("truncated").select("result_id")


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(_cut(spark, d)).withColumnRenamed("source", "candidate").withColumn("rate", F.round("rate", 6))


# 4 ------------------------------------------------------------------------------------------------- splitting


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_chunks(load(spark, d, "chunks"), load(spark, d, "segments"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of which the operator made more than one piece."""
    return splitting.piece_bounds(load(spark, d, "chunks"), "chunk_id", "text").filter("piece = 1").select("chunk_id")


def p4_valid(spark: SparkSession, d: str) -> DataFrame:
    """Of every chunk that was cut: its characters as far as pieces cover them without a gap, whether all pieces keep
    the limit and the overlap, and whether each holds the text that its place says."""
    chunks = load(spark, d, "chunks").select("chunk_id", "text")
    lists = splitting.split_texts(chunks, "chunk_id", "text").groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("piece", "start", "end", "text"))).alias("p"))
    overlap = F.transform(F.slice("p", 2, F.size("p") - 1), lambda x, i: F.element_at("p", i + 1)["end"] - x["start"])
    whole = chunks.withColumnRenamed("text", "whole").join(lists, "chunk_id")
    return whole.select(
        "chunk_id",
        F.when((F.col("p")[0]["start"] == 0) & F.forall(overlap, lambda o: o >= 0), F.element_at("p", -1)["end"]).alias("covered"),
        F.forall("p", lambda x: F.length(x["text"]).between(1, splitting.LIMIT)).alias("within_limit"),
        F.forall(overlap, lambda o: o <= splitting.OVERLAP).alias("within_overlap"),
        F.forall("p", lambda x: x["text"] == F.substring(F.col("whole"), (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))).alias("same_text"),
    )


# 5 ------------------------------------------------------------------------------------------------- capping


def p5_method(spark: SparkSession, d: str) -> DataFrame:
    """Water-filling over the whole table: lists in which no document keeps more than a fifth of the hits."""
    return capping.capped_hits(load(spark, d, "hits"), max_count=None, max_share=0.2).filter("kept").select("hit_id", "question_id", "retriever", "doc_id", "level", "quality_rank")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """A limit on counts: the level is given, there is no share to solve."""
    return capping.dropped_hits(load(spark, d, "hits"), 4).select("hit_id")


def p5_lists(spark: SparkSession, d: str) -> DataFrame:
    """The result lists with at most four hits a document; `quality_rank` is the place among those of the document."""
    return capping.kept_hits(load(spark, d, "hits"), 4).select("question_id", "retriever", "hit_id", "chunk_id", "doc_id", "score", "quality_rank")


# 6 ------------------------------------------------------------------------------------------------- scans


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.defects(load_even(spark, d, "ocr_results"))


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(load_even(spark, d, "ocr_results"))


# 7 ------------------------------------------------------------------------------------------------- one ranking


def p7_ranking(spark: SparkSession, d: str) -> DataFrame:
    r = leximin.leximin_ranking(load(spark, d, "hits"), load(spark, d, "questions"))
    return r.select("question_id", "chunk_id", "rank", *(F.round(F.col("percentiles")[i], 6).alias(f"p{i + 1}") for i in range(3)))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leximin.leximin_ranking(load(spark, d, "hits"), load(spark, d, "questions")).select("question_id", "chunk_id")


# 8 ------------------------------------------------------------------------------------------------- packing


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(load_even(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.container_report(packing.pack_texts(load_even(spark, d, "documents")))


def _by_bytes(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(load_even(spark, d, "documents"), tokenizer=None)


def p8_valid(spark: SparkSession, d: str) -> DataFrame:
    """Of every document, sized in bytes: its size as packed, its pieces, and whether it lies whole where it can."""
    packed = _by_bytes(spark, d).groupBy("doc_id").agg(F.sum("tokens").alias("bytes"), F.count("*").alias("pieces"), F.countDistinct("piece").alias("different"), F.max("n_pieces").alias("n"))
    return packed.select("doc_id", "bytes", "pieces", ((F.col("pieces") == F.col("n")) & (F.col("different") == F.col("n"))).alias("complete"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """One row: all bytes packed, whether no container holds more than it can, and whether 98 of 100 bytes of room are used."""
    report = packing.container_report(_by_bytes(spark, d))
    return report.agg(F.sum("tokens").alias("bytes"), (F.max("tokens") <= packing.CAPACITY).alias("within_capacity"), (F.sum("tokens") >= 0.98 * packing.CAPACITY * F.count("*")).alias("full"))


# 9 ------------------------------------------------------------------------------------------------- leakage


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(load_even(spark, d, "documents"), load(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(_leaks(spark, d), load(spark, d, "eval_items"))


# 10 ------------------------------------------------------------------------------------------------ reading level


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(load_even(spark, d, "documents"), load(spark, d, "reading_labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).select("doc_id", "level")


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).groupBy("lang", "level").agg(F.count("*").alias("documents"), F.sum("n_words").alias("words"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        p1_method, p1_clean, p1_found,
        p2_shares, p2_found,
        p3_rates, p3_found,
        p4_pieces, p4_found, p4_valid,
        p5_method, p5_found, p5_lists,
        p6_repaired, p6_found,
        p7_ranking, p7_found,
        p8_pack, p8_containers, p8_valid, p8_fill,
        p9_found, p9_items,
        p10_found, p10_profile,
    )}
