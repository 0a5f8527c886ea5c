"""Queries made of several operators: retrieval from fused lists to contexts, and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import looks_english
from foliant.operators.corpus import latest
from foliant.operators.joins import semi_join
from foliant.operators.ranking import top_per_group
from foliant.operators.retrieval import CANDIDATES, bm25_top, cap_per_document, dense_top, rerank, rrf, word_share, words
from foliant.tables import materialize


def pages_of(segments: DataFrame) -> DataFrame:
    """(doc_id, page, text, title) from segments; of repeated places the smallest segment_id counts."""
    first = segments.filter("doc_id is not null and seg_index is not null").groupBy("doc_id", "seg_index").agg(F.min(F.struct("segment_id", "text", "title")).alias("s"))
    return first.select("doc_id", (F.col("seg_index") + 1).alias("page"), "s.text", "s.title")


def result_list(hits: DataFrame, retriever: str, depth: int = CANDIDATES) -> DataFrame:
    """(question_id, chunk_id, doc_id, rank): one retriever's list, a chunk listed twice by its larger score."""
    once = hits.filter(F.col("retriever") == retriever).groupBy("question_id", "chunk_id").agg(F.max("score").alias("score"), F.min("doc_id").alias("doc_id"))
    return top_per_group(once, ["question_id"], [F.desc_nulls_last("score"), F.asc("chunk_id")], depth, F.col("chunk_id"))


def fused(hits: DataFrame, depth: int = CANDIDATES) -> DataFrame:
    """(question_id, chunk_id, score, rank) of the dense and the keyword list."""
    return rrf(result_list(hits, "dense", depth), result_list(hits, "keyword", depth), "question_id", "chunk_id", n=depth)


def retrieve(hits: DataFrame, chunks: DataFrame, questions: DataFrame, corpus: DataFrame, cap: int = 3, candidates: int = 20, contexts: int = 5, scorer=word_share) -> DataFrame:
    """(question_id, context, chunk_id, doc_id, rank, rerank_score): the flagship.

    Lists are fused, at most `cap` hits of a document kept among `candidates`, hits of documents that left the corpus
    dropped, the rest scored against the question and cut to `contexts`. The candidates are written, and the chunks that
    are none are left out where they are read, so that only texts of candidates are moved.
    """
    docs = hits.groupBy("chunk_id").agg(F.min("doc_id").alias("doc_id"))
    first = cap_per_document(fused(hits).join(docs, "chunk_id"), "question_id", "doc_id", cap, candidates)
    live = materialize(first.join(corpus.select("doc_id").distinct(), "doc_id", "left_semi"))
    texts = semi_join(chunks.select("chunk_id", "text"), live.select("chunk_id").distinct(), "chunk_id")
    asked = questions.groupBy("question_id").agg(F.min("question").alias("question"))
    scored = live.join(texts, "chunk_id", "left").join(asked, "question_id", "left")
    best = rerank(scored, "question_id", scorer(F.col("question"), F.col("text")), contexts)
    return best.select("question_id", "context", "chunk_id", "doc_id", "rank", F.round("rerank_score", 6).alias("rerank_score"))


TELEMETRY = (
    "category", "seconds", "gen_tokens", "finish_reason", "attempts", "first_finish_reason", "total_gen_tokens", "gen_seconds", "peak_memory_gb", "error",
    "ts", "ingested_at", "result_id",
)


def latest_attempts(results: DataFrame) -> DataFrame:
    """The last record per candidate and sample, without its text: `empty` says whether that is missing or empty."""
    narrow = results.select("candidate", "sample_id", *TELEMETRY, (F.coalesce("text", F.lit("")) == "").alias("empty"))
    return latest(narrow, ["candidate", "sample_id"], ["ts", "ingested_at"], "result_id")


def page_unit() -> Column:
    return F.concat_ws("#", "doc_id", F.col("page_no").cast("string"))


def page_scores(results: DataFrame, value: Column) -> DataFrame:
    """(candidate, unit, category, value): one score per candidate and page, of its newest attempt."""
    known = results.filter("candidate is not null and doc_id is not null and page_no is not null")
    narrow = known.select("candidate", page_unit().alias("unit"), "category", value.alias("value"), "ts", "ingested_at", "result_id")
    return latest(narrow, ["candidate", "unit"], ["ts", "ingested_at"], "result_id").select("candidate", "unit", "category", "value")


def search(chunks: DataFrame, questions: DataFrame, corpus: DataFrame, embed: Callable[[Column], Column], cap: int = 3, candidates: int = 20, contexts: int = 5, depth: int = CANDIDATES, analyzer: Callable[[Column], Column] = words, scorer=word_share) -> DataFrame:
    """(question_id, context, chunk_id, doc_id, rank, score_kind, rerank_score): a search from texts to contexts.

    All chunks are ranked by the cosine of their vectors, and for questions that look English by BM25 as well; both
    rankings are then fused by reciprocal ranks. At most `cap` chunks of a document stay among `candidates`, chunks of
    documents that left the corpus are dropped, the rest is scored against the question and cut to `contexts`. Null
    questions and texts take no part. Texts are moved for candidates only.
    """
    asked = materialize(questions.filter("question is not null").groupBy("question_id").agg(F.min("question").alias("question")).withColumn("english", looks_english(F.col("question"))))
    vectors = chunks.filter("text is not null").select("chunk_id", embed(F.col("text")).alias("embedding"))
    dense = materialize(dense_top(vectors, asked.select("question_id", embed(F.col("question")).alias("embedding")), depth, "chunk_id", "embedding", "question_id", 9))
    keyword = bm25_top(chunks, asked.filter("english"), depth, analyzer=analyzer)
    english = asked.filter("english").select("question_id")
    both = rrf(dense.join(english, "question_id", "left_semi"), keyword, "question_id", "chunk_id", n=depth).withColumn("score_kind", F.lit("rrf"))
    alone = dense.join(english, "question_id", "left_anti").select("question_id", "chunk_id", "score", "rank").withColumn("score_kind", F.lit("cosine"))
    first = materialize(both.unionByName(alone))  # `depth` rows a question
    docs = semi_join(chunks.select("chunk_id", "doc_id"), materialize(first.select("chunk_id").distinct()), "chunk_id")
    kept = cap_per_document(first.join(docs, "chunk_id"), "question_id", "doc_id", cap, candidates)
    live = materialize(kept.join(corpus.select("doc_id").distinct(), "doc_id", "left_semi"))
    texts = semi_join(chunks.select("chunk_id", "text"), live.select("chunk_id").distinct(), "chunk_id")
    scored = live.join(texts, "chunk_id").join(asked.select("question_id", "question"), "question_id")
    best = rerank(scored, "question_id", scorer(F.col("question"), F.col("text")), contexts)
    return best.select("question_id", "context", "chunk_id", "doc_id", "rank", "score_kind", F.round("rerank_score", 6).alias("rerank_score"))
