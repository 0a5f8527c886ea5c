"""Commands: ingest files, build, show or ask an index, score and report runs, run a registered query, list plug-ins."""

from __future__ import annotations

import argparse
import tomllib
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from foliant.operators.chunking import chunk_pages, content_keys
from foliant.operators.index import ChunkIndex, update_index
from foliant.operators.evaluation import truth_pages
from foliant.operators.scoring import score
from foliant.plans import config, queries, registry
from foliant.plans.ask import ask, embedded
from foliant.plans.ingest import ingest
from foliant.plans.pipeline import pages_of
from foliant.plans.report import report, table
from foliant.tables import load


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="foliant")
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query", help="run a registered query over a folder of tables")
    q.add_argument("name")
    q.add_argument("tables")
    q.add_argument("--rows", type=int, default=20)
    b = sub.add_parser("index", help="build or show the chunk index")
    b.add_argument("action", choices=("build", "status", "remove"))
    b.add_argument("root")
    b.add_argument("tables_or_document", nargs="?")
    sub.add_parser("adapters", help="list plug-ins by port")
    i = sub.add_parser("ingest", help="files to manifests and segments, and into an index if one is named")
    i.add_argument("corpus", help="folder that the tables are written to")
    i.add_argument("paths", nargs="+")
    i.add_argument("--first", type=int, help="keep the first segments of each document only")
    i.add_argument("--index", help="folder of a chunk index that is brought up to date")
    k = sub.add_parser("ask", help="contexts for a question from a committed index")
    k.add_argument("root")
    k.add_argument("tables")
    k.add_argument("question")
    k.add_argument("--keywords", choices=("english", "always", "never"), default="english")
    e = sub.add_parser("eval-ocr", help="pages of scans against the true pages beside them, as JSON tables")
    e.add_argument("records")
    e.add_argument("truth")
    m = sub.add_parser("bench", help="prepare a subset, score or report the runs of candidates, or list candidates of a settings file")
    m.add_argument("action", choices=("prepare", "run", "score", "report", "candidates"))
    m.add_argument("tables")
    m.add_argument("--size", type=int, default=25)
    a = p.parse_args(argv)
    if a.command == "adapters":
        for port in registry.PORTS:
            print(port, ", ".join(registry.available(port)))
        return 0
    if a.command == "bench" and a.action == "candidates":
        for c in config.candidates(tomllib.loads(Path(a.tables).read_text()).get("candidates", [])):
            print(c["name"], c.get("model", ""), c.get("revision", ""))
        return 0
    spark = SparkSession.builder.getOrCreate()
    if a.command == "query":
        print(table(queries.queries()[a.name](spark, a.tables), a.rows))
        return 0
    if a.command == "ingest":
        manifests, segments, failures = ingest(spark, a.paths, first=a.first)
        manifests.write.mode("append").parquet(f"{a.corpus}/manifests.parquet")
        segments.withColumns({"segment_id": F.xxhash64("doc_id", "seg_index"), "converted_at": F.current_timestamp()}).write.mode("append").parquet(f"{a.corpus}/segments.parquet")
        print(table(failures))
        if a.index:
            pages = pages_of(load(spark, a.corpus, "segments"))
            print(table(update_index(ChunkIndex(spark, a.index), embedded(chunk_pages(pages)), content_keys(pages))))
        return 0
    if a.command == "ask":
        asked = spark.createDataFrame([(1, a.question)], "question_id long, question string")
        settings = config.Settings(retrieval=config.Retrieval(keywords=a.keywords))
        print(table(ask(ChunkIndex(spark, a.root), load(spark, a.tables, "manifests"), asked, settings).select("context", "doc_id", "name", "score_kind", "rerank_score", "text").orderBy("context")))
        return 0
    if a.command == "eval-ocr":
        records, truth = spark.read.json(a.records), spark.read.json(a.truth)
        pairs = truth_pages(records, truth)
        print(table(score(pairs, ["doc_id", "page"], "truth", "text").join(pairs.select("doc_id", "page", "complete"), ["doc_id", "page"]).orderBy("doc_id", "page")))
        return 0
    if a.command == "bench":
        if a.action == "run":
            registry.create("recogniser", "none")()
        names = {"prepare": ["q_sample"], "score": ["q_metrics", "q_macro_mean", "q_holm"], "report": ["q_rank", "q_throughput", "q_category_matrix", "q_compare", "q_separation"]}[a.action]
        known = queries.queries()
        print(report("Subset" if a.action == "prepare" else "Benchmark", **{n.removeprefix("q_"): known[n](spark, a.tables) for n in names}))
        return 0
    index = ChunkIndex(spark, a.root)
    if a.action == "build":
        pages = pages_of(load(spark, a.tables_or_document, "segments"))
        print(table(update_index(index, embedded(chunk_pages(pages)), content_keys(pages))))
    elif a.action == "remove":
        index.remove(spark.createDataFrame([(a.tables_or_document,)], "doc_id string"))
        index.commit()
    print(table(index.stats()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
