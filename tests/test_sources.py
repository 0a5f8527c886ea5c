import gzip
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from foliant.errors import InvalidQuery, SourceUnavailable
from foliant.sources import files, headings, http, latex, logs, markup, papers, store


def tar_bytes(members, mode="w"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


MAIN = rb"""\documentclass{article}
\usepackage{amsmath,local}
\begin{document}
% a comment line
\section{Intro} Text with 5\% and \verb|%x| kept. % trailing
\input{part}
\input{absent}
\begin{verbatim}
% kept \input{part}
\end{verbatim}
\bibliography{refs}
\end{document}
"""
PAPER = {
    "main.tex": MAIN,
    "part.tex": b"\\subsection{Part} included\n\\input{main}\n\\endinput\nnever read",
    "local.sty": b"\\newcommand{\\good}{fine}\n\\renewcommand{\\section}{bad}\n\\newcommand{\\loop}{\\loop}\n",
    "main.bbl": b"\\begin{thebibliography}{9}\n\\bibitem{k1} A. One. \\newblock Title.\n\\end{thebibliography}",
    "fig.png": b"\x89PNG", "../evil.tex": b"x",
}


def test_detection(spark, tmp_path):
    put = {
        "a.pdf": b"%PDF-1.7\n\xff\xfe", "b.tex": b"%PDF-A compliant\n\\documentclass{article}", "c.png": b"\x89PNG\r\n\x1a\n", "d.tar": tar_bytes({"x.tex": b"y"}),
        "e.gz": gzip.compress(tar_bytes({"x.tex": b"y"})), "f.gz": gzip.compress(b"\\input harvmac"), "g.gz": gzip.compress(b"%PDF-1.4"), "h.gz": b"\x1f\x8bbroken",
        "i.md": b"# text", "j.docx": b"PK", "k.xyz": b"junk", "l": b"junk %PDF-1.5", "m.webp": b"RIFF0000WEBP", "n.html": b"<html>", "o.gz": gzip.compress(b" <!DOCTYPE html>"),
        ".hidden.md": b"x", "i.md.meta.json": b"{}", "s.truth.json": b"{}",
    }
    for n, data in put.items():
        (tmp_path / n).write_bytes(data)
    rows = files.with_identity(files.detected(files.list_inputs(spark, [str(tmp_path)]))).collect()
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.mime or r.problem) for r in rows}
    assert got == {
        "a.pdf": ("pdf", "application/pdf"), "b.tex": ("latex", "application/x-tex"), "c.png": ("image", "image/png"), "d.tar": ("latex", "application/x-tar"),
        "e.gz": ("latex", "application/gzip"), "f.gz": ("latex", "application/gzip"), "g.gz": (None, "gzipped PDF"), "h.gz": (None, "corrupt gzip file"),
        "i.md": ("text", "text/markdown"), "j.docx": ("office", files.SUFFIXES["office"][".docx"]), "k.xyz": (None, "unsupported input type"),
        "l": ("pdf", "application/pdf"), "m.webp": ("image", "image/webp"), "n.html": ("office", "text/html"), "o.gz": (None, "gzip file without TeX"),
    }
    assert len({r.doc_id for r in rows}) == len(rows)
    texts = {r.path.rsplit("/", 1)[1]: r.text for r in files.plain_texts(files.list_inputs(spark, [str(tmp_path)])).collect()}
    assert texts["i.md"] == "# text" and "�" in texts["a.pdf"]


def test_latex_source_end_to_end(spark):
    packed = [("p1", gzip.compress(tar_bytes(PAPER))), ("p2", gzip.compress(b"\\section{A} only body")), ("p3", b"\x1f\x8bbroken"), ("p4", b"plain \\section{B} tex")]
    rows = latex.unpack(spark.createDataFrame(packed, "path string, content binary")).cache()
    names = {(r.path, r.member) for r in rows.collect() if r.data is not None}
    assert names == {("p1", "main.tex"), ("p1", "part.tex"), ("p1", "local.sty"), ("p1", "main.bbl"), ("p2", "main.tex"), ("p4", "main.tex")}
    assert {r.path for r in rows.filter("warning is not null").collect()} == {"p1", "p3"}
    mains = latex.main_files(latex.decoded(rows))
    assert {(r.path, r.member) for r in mains.collect()} == {(p, "main.tex") for p in ("p1", "p2", "p4")}
    out = latex.flat_sources(rows, mains).orderBy("path", "ord").collect()
    p1 = [r for r in out if r.path == "p1"]
    assert [r.title for r in p1] == ["Intro", "Part", "References"]
    whole = "\n".join(r.text for r in p1)
    assert "5\\%" in whole and "\\verb|%x|" in whole and "a comment" not in whole and "never read" not in whole and "% kept \\input{part}" in whole
    assert "\\item \\cite{k1} A. One." in whole and any("recursive" in w for w in p1[0].warnings) and any("missing" in w for w in p1[0].warnings)


def test_latex_parts():
    assert latex.decode("caf\xe9 \x81".encode("latin-1")) == "café \x81" and latex.decode("é".encode()) == "é"
    assert latex.without_comments("a % b\n% gone\nc \\% d\n\\url{x%y}\n") == "a %\nc \\% d\n\\url{x%y}\n"
    assert latex.upto_endinput("a {\\endinput} b\n\\endinput rest\nno") == "a {\\endinput} b\n rest\n"
    assert latex.definitions(PAPER["local.sty"].decode()) == "\\newcommand{\\good}{fine}"
    assert latex.sections("x\\chapter{A}y\\section{B {c}}z", 2) == [(0, None, "x"), (1, "A", "y"), (2, "B {c}", "z")]
    assert latex.readable_length("\\begin{document}Hello \\emph{you}\\end{document}") == 9
    assert latex.brace_end("{a{b}", 0) is None
    guarded = "\\ifx\\a\\b\\endinput\\fi kept\n\\endinput\nno"
    assert latex.upto_endinput(guarded) == "\\ifx\\a\\b\\endinput\\fi kept\n\n"
    book = {"b/main.tex": b"A \\expandableinput{one} \\subimport{ch/}{two} \\include{one}\\usepackage{x,loc}\\usepackage{loc}", "b/one.tex": b"1\n", "b/ch/two.tex": b"2 \\input{three}", "b/ch/three.tex": b"3", "b/loc.sty": b"\\newcommand{\\g}{h}"}
    assert latex.flatten(book, "b/main.tex") == ("A 1\n 2 3\n \n1\n\n\\usepackage{x}\n\\newcommand{\\g}{h}\n\n", [])
    deep = {f"f{i}.tex": f"\\input{{f{i + 1}}}".encode() for i in range(30)}
    assert any("deeper" in w for w in latex.flatten(deep, "f0.tex")[1])
    with pytest.raises(ValueError):
        latex.flatten({"m.tex": b"x" * 100}, "m.tex", max_chars=10)


def test_gzip_answers_are_decoded():
    from foliant.sources.http import RETRYABLE, decoded

    body, headers = decoded(gzip.compress(b"text"), {"content-encoding": "gzip", "content-length": "9", "etag": "x"})
    assert body == b"text" and headers == {"etag": "x"} and decoded(b"plain", {"a": "b"}) == (b"plain", {"a": "b"}) and 406 in RETRYABLE
    with pytest.raises(OSError):
        decoded(b"no gzip", {"content-encoding": "gzip"})


def test_main_file_rules(spark):
    full = "\\documentclass{article}\\begin{document}x\\end{document}"
    cases = {
        "hint": {"00README.json": '{"sources": [{"filename": "b.tex", "usage": "toplevel"}]}', "main.tex": full, "b.tex": full},
        "legacy": {"00README.XXX": "z.tex toplevelfile", "main.tex": full, "z.tex": full},
        "class": {"a.tex": "text", "b.tex": full}, "real": {"a.tex": full.replace("article", "standalone") + "y" * 99, "b.tex": full},
        "name": {"sub/main.tex": full + "y" * 50, "paper.tex": full, "zz.tex": full + "z" * 100}, "included": {"a.tex": full + "\\input{b}", "b.tex": full + "y" * 99}, "large": {"a.tex": full, "b.tex": full + "y"},
    }
    rows = [(p, m, t) for p, ms in cases.items() for m, t in ms.items()]
    got = {r.path: r.member for r in latex.main_files(spark.createDataFrame(rows, "path string, member string, text string")).collect()}
    assert got == {"hint": "b.tex", "legacy": "z.tex", "class": "b.tex", "real": "b.tex", "name": "paper.tex", "included": "a.tex", "large": "b.tex"}


ENTRY = '<entry><id>http://arxiv.org/abs/{k}</id><title>A  long\n title</title><published>2017-06-12T00:00:00Z</published><author><name>Ann B</name></author><author><name>C D</name></author><category term="cs.LG"/><a:primary_category xmlns:a="http://arxiv.org/schemas/atom" term="cs.CL"/><link rel="alternate" href="http://x/{k}"/></entry>'


def feed(keys, total):
    return ('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:o="http://a9.com/-/spec/opensearch/1.1/">' + f"<o:totalResults>{total}</o:totalResults>" + "".join(ENTRY.format(k=k) for k in keys) + "<entry><title>no id</title></entry></feed>").encode()


def test_feeds(spark, tmp_path):
    records, total, entries = papers.parse_feed(feed(["1706.03762v7", "math/0211159v1"], 9))
    assert total == 9 and entries == 3 and records[0][:6] == ("1706.03762v7", "1706.03762", "v7", "A long title", ["Ann B", "C D"], 2017) and records[0][9] == ["cs.CL", "cs.LG"]
    with pytest.raises(SourceUnavailable):
        papers.parse_feed(b"<broken")
    with pytest.raises(InvalidQuery):
        papers.query_params("ids: ,")
    answers = [feed(["a1v1", "a2v1"], 7), b'<feed xmlns="http://www.w3.org/2005/Atom" xmlns:o="http://a9.com/-/spec/opensearch/1.1/"><o:totalResults>7</o:totalResults></feed>', feed(["a2v1", "a3v1"], 7), feed(["a4v1"], 7)]
    starts = []
    got = list(papers.search(lambda p: (starts.append(p["start"]), answers.pop(0))[1], "all:x", 3, sleep=lambda s: None))
    assert [r[0] for r in got] == ["a1v1", "a2v1", "a3v1"] and starts == ["0", "3", "3"]
    df = spark.createDataFrame([(feed(["a", "b"], 2).decode(),), (feed(["b"], 1).decode(),), ("<bad",), (None,)], "xml string")
    assert {r.key for r in papers.records_of(df).collect()} == {"a", "b"}
    (tmp_path / "f.xml").write_bytes(feed(["z"], 1))
    spark.dataSource.register(papers.RecordedFeed)
    assert spark.read.format("recorded_feed").option("path", str(tmp_path)).load().first().key == "z"
    xml = spark.createDataFrame([("<r xmlns='u'><m><license> http://l </license></m></r>",), ("<r><error code='x'/></r>",)], "x string")
    assert [r.l for r in xml.select(papers.license_of(F.col("x")).alias("l")).collect()] == ["http://l", None]
    fresh, old = spark.createDataFrame([("k", None), ("m", "new")], "key string, license string"), spark.createDataFrame([("k", "old"), ("m", "x")], "key string, license string")
    assert {r.key: r.license for r in papers.carried_license(fresh, old).collect()} == {"k": "old", "m": "new"}


def test_polite_client():
    now, log = [0.0], []
    answers = [(503, {"Retry-After": "7"}, []), (200, {"Content-Length": "5"}, [b"abc"]), (200, {"Content-Length": "3"}, [b"a", b"bc"]), (404, {}, [])]
    client = http.PoliteClient(lambda u: (log.append(now[0]), answers.pop(0))[1], delay=3.0, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    assert client.get("u") == b"abc" and log == [0.0, 7.0, 10.0]
    with pytest.raises(SourceUnavailable):
        client.get("v")
    big = http.PoliteClient(lambda u: (200, {}, [b"x" * 10] * 5), max_bytes=20, clock=lambda: 0.0, sleep=lambda s: None)
    with pytest.raises(SourceUnavailable):
        big.get("w")


LOG = """Candidate: m1
  [FAIL] Test t 1 on page on f.pdf page 1 failed
  [FAIL] Test known on it on g.pdf page 2
  [ERROR] no output
  Average Score: 77.0% (95% CI: [70.5%, 80.5%]) over 120 tests.
Candidate: m2
  Average Score: 50.0% (95% CI: [40.0%, 60.0%]) over 10 tests.
Final Summary with 95% confidence
m1 : Average Score: 77.0% ± 5.0%
    math : 60.5% average pass rate over 40 tests
        tables.jsonl : 70.0% (7/10 tests)
m2 : Average Score: FAILED (errors)
"""


def test_scorer_log(spark, tmp_path):
    (tmp_path / "log.txt").write_text(LOG)
    lines = logs.log_lines(spark, str(tmp_path))
    s = {r.candidate: r for r in logs.scores(lines).collect()}
    assert (s["m1"].overall, s["m1"].half_width, s["m1"].ci_low, s["m1"].n_tests) == (0.77, 0.05, 0.705, 120) and s["m2"].overall is None and s["m2"].n_tests == 10
    b = {(r.kind, r.name): (r.rate, r.passed, r.total) for r in logs.breakdown(lines).collect()}
    assert b == {("type", "math"): (0.605, None, 40), ("file", "tables"): (None, 7, 10)}
    known = spark.createDataFrame([("known on it",), ("other",)], "id string")
    assert {(r.candidate, r.test) for r in logs.failed_tests(lines, known).collect()} == {("m1", "t 1"), ("m1", "known on it")}
    assert [r.message for r in logs.errors(lines).collect()] == ["no output"]


def test_headings_and_links(spark):
    md = "pre\n\n# A\n\ntext\n\n## B [x](y)\n\n### deep\n\n```\n\n# no\n```\n\n# C\n\n# D\n\nend"
    assert [(lv, t) for lv, t, _, _ in headings.cut(md, 2)] == [(0, None), (1, "A"), (2, "B x"), (1, "C"), (1, "D")]
    out = headings.split_markdown(spark.createDataFrame([(1, md), (2, None), (3, "")], "id int, t string"), "id", "t").orderBy("ord").collect()
    assert [r.title for r in out if r.id == 1] == [None, "A", "A > B x", "D"] and out[-1].text.startswith("# C\n\n# D") and not [r for r in out if r.id == 2]
    links = markup.links_outside_code(spark.createDataFrame([(1, "[a](b.md) `[c](d)`\n```\n[e](f)\n```\n![g](h.png) [i](j)"), (2, None)], "id int, t string"), "id", "t")
    assert {(r.line, r.target) for r in links.collect()} == {(1, "b.md"), (5, "h.png"), (5, "j")}


def test_store(spark, tmp_path):
    base = {"doc_id": "d1", "source_path": "p", "n_pages": 2, "source_pages": 2, "config_hash": "c", "ocr_all": False, "created_at": "2026-01-01T00:00:00"}
    for i, m in enumerate([base, base | {"n_pages": 1, "source_path": "q"}, base | {"doc_id": "d2", "degraded": True, "n_pages": 1}]):
        (tmp_path / f"{i}.json").write_text(json.dumps(m))
    (tmp_path / "bad.json").write_text("{not json")
    m = store.tier(store.read_manifests(spark, str(tmp_path)))
    assert sorted((r.doc_id, r.tier) for r in m.collect()) == [("d1", "canonical"), ("d1", "variant"), ("d2", "degraded")]
    assert {(r.doc_id, r.source_path) for r in store.corpus(m).collect()} == {("d1", "p"), ("d2", "p")}
    wanted = spark.createDataFrame([("d1", "c", False), ("d1", "x", False), ("d2", "c", False)], "doc_id string, config_hash string, ocr_all boolean")
    assert [(r.doc_id, r.config_hash) for r in store.cache_hits(wanted, m).collect()] == [("d1", "c")]
    store.save(m.drop("tier"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert store.refreshed(m, spark.createDataFrame([("d2", "New")], "doc_id string, title string")).filter("title = 'New'").count() == 1
    assert store.find_document(m, "d1") == "d1"
    with pytest.raises(LookupError):
        store.find_document(m, "zzzzzzzzz")


def test_placed_images_are_measured(spark, tmp_path):
    import json

    from foliant.sources import pages

    m = lambda a=1, b=0, c=0, d=1, e=0, f=0: dict(zip("abcdef", map(float, (a, b, c, d, e, f))))
    turned = m(0, 1, -1, 0, 1, 0)  # a quarter turn about the middle of the unit square
    docs = [{"path": "x", "title": "t", "pages": [
        {"text": "some text", "width": 100.0, "height": 100.0, "images": [[m(50, 0, 0, 50), m(e=75, f=-10)], [turned, m(20, 0, 0, 10)]]}, {"text": None, "width": 0.0, "height": 5.0, "images": None},
        {"text": "", "width": 10.0, "height": 10.0, "images": [[m(50, 0, 0, 50)], [m(50, 0, 0, 50)]]}]}, {"path": "y", "pages": []}]
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, docs)))
    rows = pages.recorded_pages(spark, str(tmp_path / "p.json"))
    got = {r.page: r for r in pages.measured(rows).collect()}
    assert [(got[i].n_chars, got[i].n_images, got[i].image_coverage) for i in (1, 2, 3)] == [(9, 2, 0.12), (0, 0, 0.0), (0, 2, 1.0)] and got[1].n_pages == 3
    b = rows.filter("page = 1").select(pages.bounds(F.col("images")[1]).alias("b")).first().b
    assert tuple(b) == (0.0, 0.0, 20.0, 10.0)
    (tmp_path / "f.json").write_text(json.dumps({"path": "i", "frames": [{"width": 1, "height": 2}, {"width": 3, "height": 4}]}))
    assert [tuple(r) for r in pages.recorded_frames(spark, str(tmp_path / "f.json")).collect()] == [("i", 1, 1, 2), ("i", 2, 3, 4)]
