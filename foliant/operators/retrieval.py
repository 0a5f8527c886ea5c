"""Dense and keyword ranking, rank fusion, the cap per document and the second stage."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.joins import small_join
from foliant.operators.ranking import top_per_group
from foliant.tables import materialize

RRF_K, CANDIDATES = 60, 100
#: Query vectors that are broadcast at a time.
QUERY_BLOCK = 1024
#: BM25 constants.
K1, B = 1.2, 0.75


def dense_top(vectors: DataFrame, queries: DataFrame, depth: int, key: str = "vec_id", vector: str = "embedding", query: str = "query_id", digits: int | None = None) -> DataFrame:
    """(query, key, score, rank): for each query vector the `depth` rows with the largest cosine, ties by smaller key.

    Exact: all queries meet all rows, in blocks of QUERY_BLOCK queries whose matrix is broadcast. Every Arrow batch is
    one matrix product and hands on only its own best `depth` rows per query. With `digits`, scores are rounded before they are ranked, so that equal vectors tie. Rows and queries without vector, or with
    one of another length, are left out; a zero vector has score 0 with everything.
    """
    asked = queries.filter(F.col(vector).isNotNull() & F.col(query).isNotNull()).select(F.col(query).alias("q"), F.col(vector).alias("v"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    qt, kt = queries.schema[query].dataType.simpleString(), vectors.schema[key].dataType.simpleString()
    schema = f"{query} {qt}, {key} {kt}, score double"
    rows = vectors.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v"))
    out = None
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).orderBy("q").collect()
        dims = Counter(len(r.v) for r in block).most_common(1)
        block = [r for r in block if len(r.v) == dims[0][0]]
        matrix = np.array([r.v for r in block], dtype="float64").reshape(len(block), dims[0][0] if dims else 1)
        matrix = matrix / (np.linalg.norm(matrix, axis=1, keepdims=True) + 1e-12)
        shared = vectors.sparkSession.sparkContext.broadcast(([r.q for r in block], matrix))

        def score(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, m = shared.value
            for f in frames:
                f = f[f["v"].map(len) == m.shape[1]]
                if not len(f) or not len(ids):
                    continue
                x = np.stack(f["v"].to_numpy()).astype("float64")
                x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-12
                s = m @ x.T if digits is None else np.round(m @ x.T, digits) + 0.0
                keys = f["k"].to_numpy()
                order = np.argsort(keys, kind="stable")
                s, keys = s[:, order], keys[order]
                best = np.argsort(-s, axis=1, kind="stable")[:, :depth]
                yield pd.DataFrame({query: np.repeat(np.array(ids, dtype=object), best.shape[1]), key: keys[best].ravel(), "score": np.take_along_axis(s, best, 1).ravel()})

        part = rows.mapInPandas(score, schema)
        out = part if out is None else out.unionByName(part)
    return top_per_group(out, [query], [F.desc("score"), F.asc(key)], depth, F.col(key))


def words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def bm25_top(rows: DataFrame, queries: DataFrame, depth: int, key: str = "chunk_id", text: str = "text", query: str = "question_id", question: str = "question", analyzer: Callable[[Column], Column] = words) -> DataFrame:
    """(query, key, score, rank): the `depth` best rows of each query by BM25 over any of its words, ties by smaller key.

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)), k1 = 1.2, b = 0.75. Each row is analysed once into (term, tf) of the
    queries' terms only; statistics of all rows are counts. Queries without words and rows that share none are left out.
    """
    terms = queries.select(query, F.explode(F.array_distinct(analyzer(F.col(question)))).alias("term"))
    # every row is analysed once: the terms of queries and, as the empty term, the row itself, which counts for the statistics
    wanted = terms.select("term").distinct().unionByName(terms.sparkSession.createDataFrame([("",)], "term string"))
    analysed = rows.filter(F.col(text).isNotNull()).select(key, analyzer(F.col(text)).alias("ws")).select(key, F.size("ws").alias("len"), F.explode(F.concat(F.array(F.lit("")), "ws")).alias("term"))
    postings = materialize(analysed.join(wanted, "term", "left_semi").groupBy(key, "len", "term").agg(F.count("*").alias("tf")))
    stats = postings.filter("term = ''").agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    postings = postings.filter("term != ''")
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = df.crossJoin(F.broadcast(stats)).select("term", idf.alias("idf"), "avg_len")  # stats is one row
    per_term = materialize(terms.join(weights, "term"))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len"))
    # a common term may be in a third of all rows: their postings stay spread
    scored = small_join(postings, per_term, ["term"], F.col(key)).select(query, key, (F.col("idf") * F.col("tf") * (K1 + 1) / norm).alias("s"))
    totals = scored.groupBy(query, key).agg(F.sum("s").alias("score"))
    return top_per_group(totals, [query], [F.desc("score"), F.asc(key)], depth, F.col(key))


def rrf(first: DataFrame, second: DataFrame, query: str, key: str, k: int = RRF_K, n: int = CANDIDATES) -> DataFrame:
    """(query, key, score, rank) of two rankings (query, key, rank) fused by the sum of 1 / (k + rank).

    Ties keep the order of first appearance: the first ranking before the second.
    """
    a = first.select(query, key, F.col("rank").alias("__a"))
    b = second.select(query, key, F.col("rank").alias("__b"))
    score = F.coalesce(1.0 / (k + F.col("__a")), F.lit(0.0)) + F.coalesce(1.0 / (k + F.col("__b")), F.lit(0.0))
    both = a.join(b, [query, key], "full_outer").withColumn("score", score)
    order = [F.desc("score"), F.asc_nulls_last("__a"), F.asc_nulls_last("__b"), F.asc(key)]
    return top_per_group(both, [query], order, n, F.col(key)).select(query, key, "score", "rank")


def cap_per_document(ranking: DataFrame, query: str, doc: str, cap: int, k: int) -> DataFrame:
    """The first `k` rows of each ranking that keep at most `cap` rows per document (0: no cap), ranked anew."""
    if cap:
        inside = Window.partitionBy(query, doc).orderBy("rank")
        ranking = ranking.withColumn("__n", F.row_number().over(inside)).filter(F.col("__n") <= cap).drop("__n")
    whole = Window.partitionBy(query).orderBy("rank")
    return ranking.withColumn("__r", F.row_number().over(whole).cast("bigint")).filter(F.col("__r") <= k).drop("rank").withColumnRenamed("__r", "rank")


def word_share(question: Column, text: Column) -> Column:
    """The reranker for tests: share of the question's distinct words that are in the text."""
    asked = F.array_distinct(words(question))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, words(text))) / F.size(asked)).otherwise(F.lit(0.0))


def rerank(candidates: DataFrame, query: str, score: Column, contexts: int) -> DataFrame:
    """The best `contexts` candidates of each query by `score`, null as 0, ties in the order of the first stage."""
    scored = candidates.withColumn("rerank_score", F.coalesce(score, F.lit(0.0)))
    whole = Window.partitionBy(query).orderBy(F.desc("rerank_score"), F.asc("rank"))
    return scored.withColumn("context", F.row_number().over(whole).cast("bigint")).filter(F.col("context") <= contexts)
