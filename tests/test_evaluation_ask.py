import json

import pytest
from pyspark.sql import functions as F

from foliant import __main__ as commands
from foliant.errors import IndexNotReady, SourceUnavailable
from foliant.operators import evaluation as ev
from foliant.operators.chunking import chunk_pages, content_keys
from foliant.operators.index import ChunkIndex, update_index
from foliant.plans.ask import ask, check_ready, embedded
from foliant.sources import crawl, latex


def test_suite_listing_and_units(spark, tmp_path):
    for c, rows in {"math": [("a.pdf", "m1"), ("a.pdf", "m2"), ("b.pdf", "m3")], "tables": [("a.pdf", "t1"), ("c.pdf", "t2")]}.items():
        (tmp_path / f"{c}.jsonl").write_text("\n".join(json.dumps({"pdf": p, "page": 1, "id": i, "type": "present"}) for p, i in rows))
    tests = ev.read_tests(spark, str(tmp_path))
    assert {(r.pdf, r.category, r.tests) for r in ev.samples(tests, ["tables", "math"]).collect()} == {("a.pdf", "tables", 1), ("b.pdf", "math", 1), ("c.pdf", "tables", 1)}
    full = ev.with_baseline(tests)
    assert full.filter("type = 'baseline'").count() == 3 and ev.with_baseline(full).count() == full.count()
    failed = spark.createDataFrame([("x", "m1"), ("x", "m1"), ("y", None)], "candidate string, test string")
    units = ev.unit_scores(tests, failed)
    assert {r.candidate: r.s for r in units.groupBy("candidate").agg(F.sum("value").alias("s")).collect()} == {"x": 4.0, "y": 5.0}
    assert ev.without_clusters(units, spark.createDataFrame([("a.pdf",)], "cluster string")).count() == 4
    mean = {r.candidate: r.mean for r in ev.subset_mean(units, spark.createDataFrame([("a.pdf",)], "cluster string"), ["candidate"], "group", "value").collect()}
    assert mean == {"x": 0.75, "y": 1.0}
    assert spark.range(1).select(ev.cluster_key(F.lit("f.pdf"), F.lit(4)).alias("k")).first().k == "f.pdf#p005"


def test_score_tables(spark):
    t = lambda rows, s: spark.createDataFrame(rows, s)
    old, new = t([("a", 1.0), ("b", 2.0)], "candidate string, m double"), t([("b", 3.0), ("c", 4.0)], "candidate string, m double")
    assert {(r.candidate, r.m) for r in ev.merged_scores(old, new).collect()} == {("a", 1.0), ("b", 3.0), ("c", 4.0)}
    maps = t([("a", {"f1": (0.5, 0.4, 0.6, 9)})], "candidate string, metrics map<string, struct<mean:double, low:double, high:double, n:long>>")
    assert tuple(ev.exploded_scores(maps).first()) == ("a", "f1", 0.5, 0.4, 0.6, 9)
    assert tuple(ev.extremes(t([("a", 2.0), ("b", 8.0), ("c", None)], "n string, v double"), "n", "v").first()) == ("a", 2.0, "b", 8.0, 4.0)
    pages = t([("ab c",), (None,), ("   ",), ("abcdef",)], "t string")
    assert ev.long_enough(pages, "t", 4).count() == 1
    outs = t([("",), ('{"is_table": true}',), ('{"x": 1}',), ("text",), (None,)], "t string").select(ev.blank_output(F.col("t")).alias("b"))
    assert [r.b for r in outs.collect()] == [True, True, False, False, True]
    c = t([(1, "b", 2), (1, "a", 1), (1, "b", 0)], "q int, d string, p int")
    assert [(r.d, r.number) for r in ev.by_first_appearance(c, "q", "d", "p").orderBy("number").collect()] == [("b", 1), ("a", 2)]
    a = t([("r", 0, 2), ("r", 1, 2), ("s", 0, 2), ("s", 0, 2)], "req string, i int, n int")
    assert [r.req for r in ev.covers_all(a, "req", "i", "n").collect()] == ["s"]
    b = ev.simple_bootstrap(t([("k", float(i)) for i in range(50)] + [("e", None)], "k string, v double"), ["k"], "v").collect()
    assert {r.k: (r.mean is None or r.low < 24.5 < r.high) for r in b} == {"k": True, "e": True}
    assert {(r.cluster, r.state) for r in ev.shared_and_added(t([("a",)], "cluster string"), t([("a",), ("b",)], "cluster string")).collect()} == {("a", "shared"), ("b", "added")}


def test_questions_are_answered_from_the_index(spark, tmp_path):
    rows = [(f"d{i}", 1, f"document {i} speaks about {w} and about {w} again", None) for i, w in enumerate(["heat", "light", "sound", "magnets", "water"])]
    pages = spark.createDataFrame(rows, "doc_id string, page long, text string, title string")
    ix = ChunkIndex(spark, str(tmp_path / "ix"))
    with pytest.raises(IndexNotReady):
        check_ready(ix, pages, "hashed")
    update_index(ix, embedded(chunk_pages(pages)), content_keys(pages))
    asked = spark.createDataFrame([(1, "What is magnets about?"), (2, "¿Qué es light para el agua?"), (3, None)], "question_id long, question string")
    out = ask(ix, pages.select("doc_id"), asked).collect()
    first = {r.question_id: (r.doc_id, r.score_kind) for r in out if r.context == 1}
    assert first == {1: ("d3", "rrf"), 2: ("d1", "cosine")}
    gone = ask(ix, pages.filter("doc_id != 'd3'").select("doc_id"), asked).collect()
    assert "d3" not in {r.doc_id for r in gone}
    with pytest.raises(IndexNotReady):
        check_ready(ix, pages, "other")
    more = spark.createDataFrame([("d9",)], "doc_id string").unionByName(pages.select("doc_id"))
    assert check_ready(ix, more, "hashed") == ["1 documents are not indexed"]


def test_crawl(spark, tmp_path):
    bodies = {"a": b"\\documentclass{x}", "b": b"<html>no", "c": b"%PDF-1.5", "e/1": b"%PDF"}

    def get(key, kind):
        if key == "d":
            raise crawl.RateLimited("slow down")
        if key == "b" or (key == "c" and kind == "source"):
            raise SourceUnavailable("gone")
        return bodies[key]

    done, failed = crawl.crawl(spark, [(k, {"license": None if k == "a" else "l"}) for k in ("a", "b", "c", "d", "e/1")], str(tmp_path), get, 10)
    assert {(r.key, r.format) for r in done.collect()} == {("a", "tex"), ("c", "pdf")}
    assert {(r.key, r.problem) for r in failed.collect()} == {("b", "b: gone"), ("d", "slow down"), ("e/1", "not attempted")}
    crawl.write_sidecar(str(tmp_path / "c.pdf"), {"license": None})
    assert json.loads((tmp_path / "c.pdf.meta.json").read_text())["license"] == "l"
    assert crawl.fetch("c", str(tmp_path), get).reused and crawl.classify(b"\x1f\x8bx") is None


def test_plain_latex():
    src = "\\documentclass{a}\\title{A \\emph{big} title\\thanks{x}}\\author{Ann B \\and C}\\begin{document}\\maketitle\\begin{abstract}Short.\\end{abstract}\\section{One}Text \\textbf{bold} 5\\%.\n\n\\begin{itemize}\\item a\\item b\\end{itemize}\n\\begin{verbatim}\nx % y\n\\end{verbatim}\\end{document}"
    out = latex.plain_markdown(src)
    assert out[0] == ("A big title", "# A big title\n\nAnn B , C") and out[1] == ("Abstract", "# Abstract\n\nShort.")
    assert out[2][0] == "One" and "Text bold 5%." in out[2][1] and "- a\n- b" in out[2][1] and "```\nx % y\n```" in out[2][1]
    assert latex.chosen_conversion("x" * 50, "y", 100) == ("x" * 50, None) and latex.chosen_conversion("x", "yyy", 100)[0] == "yyy" and latex.chosen_conversion("xxx", "y", 100)[1]
    with pytest.raises(ValueError):
        latex.chosen_conversion(None, " ", 10)


def test_commands(spark, sf, tmp_path, capsys):
    commands.main(["adapters"])
    commands.main(["query", "q_readiness", sf])
    commands.main(["index", "build", str(tmp_path / "ix"), sf])
    out = capsys.readouterr().out
    assert "embedder hashed, none" in out and "| both | missing | stale |" in out and "| added | updated |" in out
