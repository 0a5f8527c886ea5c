"""The engine's own operators applied to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions.normal import clean_transcription, markdown_plain, normalized, tex_plain
from foliant.functions.vectors import letter_counts
from foliant.operators import chunking, corpus, evaluation, index, retrieval, scoring, statistics, telemetry
from foliant.operators.ranking import prefix_sums
from foliant.plans import pipeline as P
from foliant.sources.markup import links_outside_code
from foliant.tables import load, load_even, materialize

Query = Callable[[SparkSession, str], DataFrame]
ASKED = 50  # searches take every row whose id is divisible by this as a query, against all rows


# ------------------------------------------------------------------------------------------------- retrieval


def q_dense_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "embeddings")
    asked = rows.filter(F.col("vec_id") % ASKED == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.dense_top(rows, asked, 10).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def q_bm25(spark: SparkSession, d: str) -> DataFrame:
    asked = load(spark, d, "questions").filter(F.col("question").isNotNull() & (F.col("question_id") % ASKED == 0))
    return retrieval.bm25_top(load_even(spark, d, "chunks"), asked, 10).select("question_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def q_rrf(spark: SparkSession, d: str) -> DataFrame:
    return P.fused(load(spark, d, "hits")).select("question_id", "chunk_id", "rank", F.round("score", 9).alias("score"))


def q_cap(spark: SparkSession, d: str) -> DataFrame:
    hits = load(spark, d, "hits")
    docs = hits.groupBy("chunk_id").agg(F.min("doc_id").alias("doc_id"))
    return retrieval.cap_per_document(P.fused(hits).join(docs, "chunk_id"), "question_id", "doc_id", 3, 20).select("question_id", "chunk_id", "doc_id", "rank")


def q_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return P.retrieve(load(spark, d, "hits"), load(spark, d, "chunks"), load(spark, d, "questions"), load(spark, d, "manifests"))


def q_search(spark: SparkSession, d: str) -> DataFrame:
    """A search over all chunks, by vectors and keywords, for every question whose id is divisible by ASKED."""
    asked = load(spark, d, "questions").filter(F.col("question_id") % ASKED == 0)
    chunks = load_even(spark, d, "chunks").filter("chunk_id is not null and doc_id is not null").select("chunk_id", "doc_id", "text")
    return P.search(chunks, asked, load(spark, d, "manifests"), letter_counts)


def q_english(spark: SparkSession, d: str) -> DataFrame:
    asked = load(spark, d, "questions").withColumn("detected", T.looks_english(F.col("question")))
    said = F.coalesce(F.when(F.col("english"), "yes").when(~F.col("english"), "no"), F.lit("unknown"))
    return asked.withColumn("english", said).groupBy("english", "detected").agg(F.count("*").alias("questions"))


def q_stale_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits whose chunk is no longer stored, per retriever."""
    hits, chunks = load(spark, d, "hits"), load(spark, d, "chunks")
    return hits.join(chunks.select("chunk_id"), "chunk_id", "left_anti").groupBy("retriever").agg(F.count("*").alias("hits"))


def q_readiness(spark: SparkSession, d: str) -> DataFrame:
    """One row: documents of the corpus that the chunk index lacks, and indexed ones that the corpus lacks."""
    sets = corpus.compare_sets(corpus=load(spark, d, "manifests").select("doc_id"), indexed=load(spark, d, "chunks").select("doc_id"))
    return sets.select("both", F.col("only_a").alias("missing"), F.col("only_b").alias("stale"))


def q_format_query(spark: SparkSession, d: str) -> DataFrame:
    task = F.when(F.col("english"), F.lit("Given a question, retrieve passages that answer it"))
    return load(spark, d, "questions").select("question_id", T.format_query(task, F.col("question")).alias("query"))


# ------------------------------------------------------------------------------------------------- pages and chunks


def q_chunks(spark: SparkSession, d: str) -> DataFrame:
    made = chunking.chunk_pages(P.pages_of(load(spark, d, "segments")))
    return made.select("doc_id", "chunk", "name", "first_page", "last_page", "is_reference", "start", F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("n_chars"))


def q_content_key(spark: SparkSession, d: str) -> DataFrame:
    return chunking.content_keys(P.pages_of(load(spark, d, "segments")))


def q_split_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages rendered to page-marked Markdown in runs of 16 and read back."""
    pages = P.pages_of(load(spark, d, "segments")).withColumn("run", F.floor((F.col("page") - 1) / 16))
    page = F.struct(F.col("page").alias("number"), F.lit("passthrough").alias("method"), F.coalesce("text", F.lit("")).alias("text"))
    runs = pages.groupBy("doc_id", "run").agg(F.sort_array(F.collect_list(page)).alias("pages"))
    back = runs.select("doc_id", F.explode(T.split_pages(T.render_pages(F.lit("A title"), F.col("pages")))).alias("p"))
    return back.select("doc_id", F.col("p.number").cast("bigint").alias("page"), F.md5("p.text").alias("digest"))


def q_signals(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return load_even(spark, d, "ocr_results").select("result_id", T.solid_length(t).alias("n_solid"), F.round(T.garbage_ratio(t), 6).alias("garbage_ratio"), F.round(T.alpha_ratio(t), 6).alias("alpha_ratio"))


def q_routing(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    n = F.length(F.coalesce(t, F.lit(""))).cast("bigint")
    scanned = F.when(F.col("category") == "archive_scans", 0.9).otherwise(0.0)
    reasons = T.ocr_reasons(n, scanned, F.coalesce(T.garbage_ratio(t), F.lit(0.0)), F.coalesce(T.alpha_ratio(t), F.lit(0.0)), F.col("attempts") > 2)
    rows = load_even(spark, d, "ocr_results").select("result_id", reasons.alias("reasons"))
    return rows.select("result_id", (F.size("reasons") > 0).alias("needs_ocr"), F.array_join("reasons", "; ").alias("reasons"))


def q_clean_text(spark: SparkSession, d: str) -> DataFrame:
    clean = T.clean_text_layer(F.col("text"))
    return load_even(spark, d, "ocr_results").filter("text is not null").select("result_id", F.md5(clean).alias("digest"), F.length(clean).cast("bigint").alias("n_chars"))


def q_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    words = load_even(spark, d, "documents").filter("text is not null").select("lang", F.explode(T.vocabulary(F.col("text"))).alias("word"))
    return words.groupBy("lang").agg(F.countDistinct("word").alias("words"))


def q_html(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "segments").select("segment_id", F.coalesce(T.is_html(F.col("text")), F.lit(False)).alias("is_html"))


def q_links(spark: SparkSession, d: str) -> DataFrame:
    return links_outside_code(load_even(spark, d, "segments"), "segment_id", "text")


def q_plain_text(spark: SparkSession, d: str) -> DataFrame:
    return load_even(spark, d, "segments").select("segment_id", tex_plain(markdown_plain("text")).alias("text"))


def q_transcription(spark: SparkSession, d: str) -> DataFrame:
    """Outputs freed from their wrapping; changed rows only."""
    done = load_even(spark, d, "ocr_results").filter("raw_text is not null").select("result_id", "raw_text", clean_transcription(F.col("raw_text")).alias("text"))
    return done.filter("text != raw_text").select("result_id", "text")


# ------------------------------------------------------------------------------------------------- corpus and index


def q_best_variant(spark: SparkSession, d: str) -> DataFrame:
    best = corpus.best_variant(load(spark, d, "manifests"), [F.asc("created_at"), F.asc("source_path")])
    return best.select("doc_id", "canonical", "n_pages", "source_path", "created_at")


def q_catalog(spark: SparkSession, d: str) -> DataFrame:
    best = corpus.best_variant(load(spark, d, "manifests"), [F.asc("created_at"), F.asc("source_path")])
    cited = T.citation(F.col("title"), F.col("authors"), F.col("pub_year"), F.lit(None).cast("string"), F.col("source_name"))
    return best.select("doc_id", cited.alias("citation"), T.safe_part(F.col("doc_id")).alias("part"), T.slug(F.col("source_name")).alias("slug"), T.config_hash(F.col("pipeline_version"), F.col("source_kind")).alias("config_hash"))


def q_complete(spark: SparkSession, d: str) -> DataFrame:
    """Runs per kind of source: complete and partial ones, pages and seconds."""
    whole = F.coalesce(F.col("n_pages") == F.col("source_pages"), F.lit(False))
    return load(spark, d, "manifests").groupBy("source_kind").agg(F.count("*").alias("runs"), F.sum(whole.cast("bigint")).alias("complete"), F.sum("n_pages").alias("pages"), F.round(F.sum("total_seconds"), 3).alias("seconds"))


def q_index_diff(spark: SparkSession, d: str) -> DataFrame:
    """The corpus against the index as it was at a date: what was converted later is new or changed, documents that only
    chunks are left of are stale."""
    now, then = _two_states(spark, d)
    return index.diff(now, then).select("doc_id", "state")


def _two_states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    segments = load(spark, d, "segments")
    now = chunking.content_keys(P.pages_of(segments))
    then = chunking.content_keys(P.pages_of(segments.filter("converted_at < timestamp_ntz'2024-09-01'")))
    left = load(spark, d, "chunks").select("doc_id").distinct().join(now.select("doc_id"), "doc_id", "left_anti").withColumn("key", F.lit(None).cast("string"))
    then = then.unionByName(left)
    return now, then


def q_build_report(spark: SparkSession, d: str) -> DataFrame:
    now, then = _two_states(spark, d)
    return index.build_report(index.diff(now, then), load(spark, d, "chunks"))


def q_sample(spark: SparkSession, d: str) -> DataFrame:
    return corpus.nested_sample(load(spark, d, "ocr_results").filter("sample_id is not null"), "category", "sample_id", 25)


def q_set_ops(spark: SparkSession, d: str) -> DataFrame:
    names = ("manifests", "segments", "chunks", "hits", "ocr_results")
    return corpus.compare_sets(**{n: load(spark, d, n).select("doc_id") for n in names})


def q_owner(spark: SparkSession, d: str) -> DataFrame:
    """Hits numbered by id; the block of rows in which each lies, blocks being the chunk counts of documents in order."""
    counts = load(spark, d, "chunks").groupBy("doc_id").agg(F.count("*").alias("n"))
    numbered = counts.select("doc_id", "n", F.conv(F.substring("doc_id", 1, 12), 16, 10).cast("bigint").alias("place"))
    blocks = prefix_sums(numbered.withColumn("all", F.lit(1)), ["all"], "place", "n", "start", width=1 << 34).select("doc_id", "start", "n")
    rows = load(spark, d, "hits").select("hit_id", F.col("hit_id").alias("row"))
    return corpus.owner_as_of(rows, blocks, size="n").select("hit_id", "doc_id", (F.col("row") - F.col("start")).alias("place"))


# ------------------------------------------------------------------------------------------------- telemetry


def q_latest(spark: SparkSession, d: str) -> DataFrame:
    return P.latest_attempts(load(spark, d, "ocr_results")).select("candidate", "sample_id", "result_id", "finish_reason")


def q_throughput(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.throughput(P.latest_attempts(load(spark, d, "ocr_results")), "candidate", "category", 6, 6)


def q_streaks(spark: SparkSession, d: str) -> DataFrame:
    runs = telemetry.failure_streaks(load(spark, d, "ocr_results"), ["candidate"], ["ts", "result_id"], F.col("error").isNotNull(), F.date_trunc("hour", "ts"))
    return runs.select("candidate", "streak", "length", "first", "last")


def q_budget(spark: SparkSession, d: str) -> DataFrame:
    inside = telemetry.within_budget(load(spark, d, "ocr_results"), ["candidate"], ["ts", "result_id"], "seconds", 600.0, F.date_trunc("hour", "ts"))
    return inside.groupBy("candidate").agg(F.count("*").alias("pages"), F.round(F.max("elapsed"), 3).alias("elapsed"))


def q_rank(spark: SparkSession, d: str) -> DataFrame:
    newest = P.latest_attempts(load(spark, d, "ocr_results"))
    scores = newest.groupBy("candidate").agg(F.avg("seconds").alias("mean"), F.max((F.col("error").isNotNull()).cast("int")).alias("e")).select("candidate", F.round("mean", 6).alias("mean"), (F.col("e") > 1).alias("has_errors"), F.lit(False).alias("higher"))
    return telemetry.rank_candidates(scores, "candidate", "mean", "has_errors", "higher").select("candidate", "mean", "place")


def q_stale_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "ocr_results")
    current = rows.groupBy("candidate").agg(F.count("*").alias("records"))
    early = rows.filter("ingested_at < timestamp_ntz'2025-06-01'").groupBy("candidate").agg(
        F.count("error").alias("errors"), F.count("text").alias("n_outputs"), F.count("*").alias("n_samples"), F.avg("seconds").alias("mean"), F.lit(3).alias("scoring_version"), F.count("*").alias("records")
    )
    return telemetry.stale_scores(early, current, "candidate", 3)


def q_todo(spark: SparkSession, d: str) -> DataFrame:
    """Pages with an output of no candidate yet, or whose newest output failed."""
    rows = load(spark, d, "ocr_results")
    newest = P.latest_attempts(rows)
    samples = rows.select("sample_id").filter("sample_id is not null").distinct()
    return telemetry.todo(samples, newest.filter("error is null and not empty"), newest.filter("error is not null"), "sample_id")


def q_events(spark: SparkSession, d: str) -> DataFrame:
    """Event records: newest per user and type with its JSON properties."""
    newest = corpus.latest(load(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "props"), ["user_id", "event_type"], ["ts"], "event_id")
    return newest.select("user_id", "event_type", "event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.device").alias("device"))


# ------------------------------------------------------------------------------------------------- scores


def _candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(unit, ref, hyp): pages read by two candidates, the first by name as reference."""
    rows = P.page_scores(load(spark, d, "ocr_results"), F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "?"))).groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("candidate", "value"))).alias("c"))
    return rows.filter(F.size("c") > 1).select("unit", F.col("c")[0]["value"].alias("ref"), F.col("c")[1]["value"].alias("hyp"))


def q_word_f1(spark: SparkSession, d: str) -> DataFrame:
    return scoring.word_f1(_candidate_pairs(spark, d), ["unit"], "ref", "hyp", 6)


def q_char3_f1(spark: SparkSession, d: str) -> DataFrame:
    return scoring.char3_f1(_candidate_pairs(spark, d), ["unit"], "ref", "hyp", 6)


def q_cer(spark: SparkSession, d: str) -> DataFrame:
    return _candidate_pairs(spark, d).select("unit", scoring.cer(F.col("ref"), F.col("hyp"), 6).alias("cer"))


def q_score(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score(_candidate_pairs(spark, d), ["unit"], "ref", "hyp")


def q_normalized(spark: SparkSession, d: str) -> DataFrame:
    return load_even(spark, d, "ocr_results").select("result_id", normalized("text").alias("text"))


def q_running_lines(spark: SparkSession, d: str) -> DataFrame:
    return scoring.running_lines(load(spark, d, "ocr_results").filter("doc_id is not null"), "doc_id", "page_no", "text")


def q_furniture(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "ocr_results").filter("doc_id is not null")
    running = scoring.running_lines(rows, "doc_id", "page_no", "text")
    pairs = rows.filter("raw_text is not null").select("result_id", "doc_id", "raw_text", "text")
    return scoring.without_furniture(pairs, running, "doc_id", "raw_text", "text").select("result_id", "raw_text", "text")


def q_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = P.latest_attempts(load(spark, d, "ocr_results")).select("candidate", F.col("seconds").cast("double"), F.col("gen_tokens").cast("double"), F.col("peak_memory_gb").cast("double"))
    return scoring.metric_estimates(rows, ["candidate"], ["seconds", "gen_tokens", "peak_memory_gb"]).withColumn("mean", F.round("mean", 6))


def q_category_matrix(spark: SparkSession, d: str) -> DataFrame:
    names = ["archive_scans", "running_heads", "scanned_math", "table_pages", "tiny_print", "two_column"]
    known = F.when(F.col("category").isin(*names), F.col("category")).otherwise("other")  # a new category is not lost
    m = scoring.category_matrix(load(spark, d, "ocr_results").filter("candidate is not null").withColumn("category", known), "candidate", "category", "seconds", [*names, "other"])
    return m.select("candidate", *(F.round(n, 6).alias(n) for n in [*names, "other"]))


def q_category_spread(spark: SparkSession, d: str) -> DataFrame:
    s = scoring.category_spread(load(spark, d, "ocr_results").filter("category is not null"), "candidate", "category", "seconds")
    return s.withColumns({c: F.round(c, 6) for c in ("worst_mean", "best_mean")})


# ------------------------------------------------------------------------------------------------- statistics


def q_macro_mean(spark: SparkSession, d: str) -> DataFrame:
    return statistics.macro_mean(load(spark, d, "ocr_results"), ["candidate"], "category", "seconds").withColumn("mean", F.round("mean", 6))


def _weights(spark: SparkSession, d: str) -> DataFrame:
    scores = P.page_scores(load(spark, d, "ocr_results"), F.col("seconds")).filter("category is not null").withColumn("half", F.substring("unit", 1, 1).isin(*"01234567"))
    pairs = statistics.paired_units(scores, "candidate", "unit", "value", ["category", "half"])
    return statistics.cluster_sums(pairs, ["a", "b"], "category", "half")


def q_sign_flip(spark: SparkSession, d: str) -> DataFrame:
    t = statistics.sign_flip(_weights(spark, d), ["a", "b"], "category")
    return t.select("a", "b", F.round("diff", 6).alias("diff"), F.round("p_value", 6).alias("p_value"), "n", "n_clusters", "exact")


def q_holm(spark: SparkSession, d: str) -> DataFrame:
    t = statistics.sign_flip(_weights(spark, d), ["a", "b"], "category").withColumn("p_value", F.round("p_value", 6))
    return statistics.holm(t, "p_value", ["a", "b"], alpha=0.5).select("a", "b", "p_value", "rejected")


def q_separation(spark: SparkSession, d: str) -> DataFrame:
    t = statistics.sign_flip(_weights(spark, d), ["a", "b"], "category").withColumn("p_value", F.round("p_value", 6))
    return statistics.separation(q_rank(spark, d), statistics.holm(t, "p_value", ["a", "b"], alpha=0.5))


def q_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Mean of category means of seconds with its interval; documents are the clusters, kinds of them the strata."""
    rows = load(spark, d, "ocr_results").filter("seconds is not null and doc_id is not null and category is not null")
    cells = materialize(rows.withColumn("candidate", F.coalesce("candidate", F.lit("\u0000"))).groupBy("candidate", "doc_id", "category").agg(F.sum("seconds").alias("s"), F.count("*").alias("n")))
    kinds = cells.groupBy("candidate", "doc_id").agg(F.min("category").alias("kind"))  # a document is of one kind
    pools = statistics.collapsed_strata(kinds, ["candidate"], "kind").select("candidate", "doc_id", "pool")
    out = statistics.bootstrap(cells.join(pools, ["candidate", "doc_id"]), ["candidate"], "doc_id", "category", "pool")
    return out.withColumn("candidate", F.nullif("candidate", F.lit("\u0000")))


def q_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Candidate pairs a < b with the mean difference over their common pages and over those with the sign reversed."""
    scores = P.page_scores(load(spark, d, "ocr_results"), F.col("seconds"))
    pairs = statistics.paired_units(scores, "candidate", "unit", "value")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.avg("diff"), 6).alias("mean"), F.sum((F.col("diff") < 0).cast("bigint")).alias("reversed"))


def q_subset_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean of category means of seconds over documents that were read completely."""
    whole = load(spark, d, "manifests").filter("n_pages = source_pages").select(F.col("doc_id").alias("cluster"))
    units = load(spark, d, "ocr_results").select("candidate", "category", F.col("doc_id").alias("cluster"), "seconds")
    return evaluation.subset_mean(units, whole, ["candidate"], "category", "seconds").withColumn("mean", F.round("mean", 6))


def q_extremes(spark: SparkSession, d: str) -> DataFrame:
    means = load(spark, d, "ocr_results").filter("candidate is not null").groupBy("candidate").agg(F.round(F.avg("seconds"), 6).alias("seconds"))
    return evaluation.extremes(means, "candidate", "seconds").withColumn("ratio", F.round("ratio", 6))


def q_blank(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "ocr_results").select("candidate", evaluation.blank_output(F.col("text")).alias("blank"))
    return rows.groupBy("candidate", "blank").agg(F.count("*").alias("pages"))


def q_first_appearance(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each question's contexts in the order in which they first appear."""
    return evaluation.by_first_appearance(q_hybrid(spark, d), "question_id", "doc_id", "context")


def q_token_windows(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")
    rows = load_even(spark, d, "documents").filter("text is not null").select("doc_id", words.alias("words"))
    made = chunking.token_windows(rows, "doc_id", "words", 256)
    return made.select("doc_id", "window", "start", F.size("words").alias("n"), F.md5(F.array_join("words", " ")).alias("digest"))


def queries() -> dict[str, Query]:
    from foliant.plans import source_queries

    return {n: f for n, f in globals().items() if n.startswith("q_")} | source_queries.queries()
