"""Questions answered from the committed index: readiness, both rankings, fusion, cap, second stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.errors import IndexNotReady
from foliant.functions.text import looks_english
from foliant.operators.index import ChunkIndex
from foliant.operators.retrieval import bm25_top, cap_per_document, dense_top, rerank, rrf
from foliant.plans import registry
from foliant.plans.config import Settings


def check_ready(index: ChunkIndex, corpus: DataFrame, embedder: str) -> list[str]:
    """Warnings; raises if nothing is committed or another embedder made the vectors."""
    state = index.search_state()
    if state is None or state.isEmpty():
        raise IndexNotReady("the index is empty or was never committed")
    others = [r.embedder for r in state.select("embedder").distinct().limit(2).collect() if r.embedder != embedder]
    if others:
        raise IndexNotReady(f"the index was built with {others[0]}, not {embedder}")
    missing = corpus.select("doc_id").distinct().join(state.select("doc_id").distinct(), "doc_id", "left_anti").count()
    return [w for w in (f"{missing} documents are not indexed" if missing else "", "uncommitted changes" if index.pending() else "") if w]


def embedded(chunks: DataFrame, name: str = "hashed", **settings) -> DataFrame:
    """Chunks with `embedding` and the name of the embedder."""
    return chunks.withColumn("embedding", registry.create("embedder", name, **settings)(F.col("text"))).withColumn("embedder", F.lit(name))


def ask(index: ChunkIndex, corpus: DataFrame, questions: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(question_id, context, doc_id, chunk_id, name, text, score_kind, rerank_score): the contexts of each question.

    Keywords are used for questions that look English (`keywords = "english"`), for all ("always") or for none; without
    them a question keeps its dense ranking and its scores are cosines, with them reciprocal ranks.
    """
    s = (settings or Settings()).retrieval
    check_ready(index, corpus, s.embedder)
    state = index.search_state().withColumn("chunk_id", F.concat_ws("#", "doc_id", F.col("start").cast("string")))
    asked = questions.filter("question is not null").withColumn("keywords", {"english": looks_english(F.col("question")), "always": F.lit(True)}.get(s.keywords, F.lit(False)))
    vectors = asked.withColumn("embedding", registry.create("embedder", s.embedder)(F.col("question")))
    dense = dense_top(state, vectors, s.candidates, "chunk_id", "embedding", "question_id")
    keyword = bm25_top(state.select("chunk_id", "text"), asked.filter("keywords"), s.candidates)
    fused = rrf(dense.join(asked.filter("keywords").select("question_id"), "question_id", "left_semi"), keyword, "question_id", "chunk_id", n=s.candidates).withColumn("score_kind", F.lit("rrf"))
    plain = dense.join(asked.filter("not keywords").select("question_id"), "question_id", "left_semi").select("question_id", "chunk_id", "score", "rank").withColumn("score_kind", F.lit("cosine"))
    first = fused.unionByName(plain).withColumn("doc_id", F.substring_index("chunk_id", "#", 1))
    kept = cap_per_document(first, "question_id", "doc_id", s.cap, s.candidates).join(corpus.select("doc_id").distinct(), "doc_id", "left_semi")
    texts = state.select("chunk_id", "name", "text")
    scored = kept.join(texts, "chunk_id").join(asked.select("question_id", "question"), "question_id")
    best = rerank(scored, "question_id", registry.create("reranker", s.reranker)(F.col("question"), F.col("text")), s.contexts)
    return best.select("question_id", "context", "doc_id", "chunk_id", "name", "text", "score_kind", "rerank_score")
