import gzip
import json

import pytest

from foliant.__main__ import main
from foliant.errors import NotConfigured
from foliant.plans.ingest import ingest


@pytest.fixture
def inbox(tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    (box / "a.md").write_text("# One\n\ntext of one\n\n## Two\n\ntext of two")
    (box / "b.txt").write_text("plain text about engines")
    (box / "copy.txt").write_text("plain text about engines")
    (box / "c.html").write_text("<html><head><title>Page</title></head><body><p>words here</p></body></html>")
    (box / "d.tex.gz").write_bytes(gzip.compress(b"\\documentclass{article}\\begin{document}\\section{S}latex words\\end{document}"))
    (box / "e.pdf").write_bytes(b"%PDF-1.7 ...")
    (box / "f.bin").write_bytes(b"\x00\x01")
    (box / "b.txt.meta.json").write_text("{}")
    (box / ".hidden").write_text("x")
    return box


def test_files_become_documents(spark, inbox):
    manifests, segments, failures = ingest(spark, [str(inbox)])
    rows = {r.source_name: r for r in manifests.collect()}
    assert set(rows) == {"a.md", "b.txt", "c.html", "d.tex.gz"} and rows["a.md"].n_pages == 2 and all(r.tier == "canonical" for r in rows.values())
    texts = {(r.doc_id, r.seg_index): (r.title, r.text) for r in segments.collect()}
    assert texts[rows["c.html"].doc_id, 0] == ("Page", "words here") and texts[rows["d.tex.gz"].doc_id, 1] == ("S", "latex words") and texts[rows["a.md"].doc_id, 1][0] == "One > Two"
    bad = {r.path.rsplit("/", 1)[1]: r.problem for r in failures.collect()}
    assert set(bad) == {"e.pdf", "f.bin"} and "pdf" in bad["e.pdf"]
    partly = {r.source_name: (r.n_pages, r.tier) for r in ingest(spark, [str(inbox)], first=1)[0].collect()}
    assert partly["a.md"] == (1, "variant") and partly["b.txt"] == (1, "canonical")


def test_commands(spark, inbox, tmp_path, capsys):
    corpus, root = str(tmp_path / "corpus"), str(tmp_path / "index")
    assert main(["ingest", corpus, str(inbox), "--index", root]) == 0
    assert "e.pdf" in capsys.readouterr().out
    assert main(["index", "status", root]) == 0 and main(["ask", root, corpus, "plain text about engines"]) == 0
    assert "plain text about engines" in capsys.readouterr().out
    (tmp_path / "r.json").write_text("\n".join(json.dumps(x) for x in ({"doc_id": "d", "page": 1, "text": "a b c"}, {"doc_id": "d", "page": 2, "text": "x"})))
    (tmp_path / "t.json").write_text(json.dumps({"doc_id": "d", "pages": ["a b d", "x"]}))
    assert main(["eval-ocr", str(tmp_path / "r.json"), str(tmp_path / "t.json")]) == 0
    assert "0.2" in capsys.readouterr().out
    tables = "/root/testdata/sf0.001"
    assert main(["bench", "prepare", tables]) == 0 and main(["bench", "report", tables]) == 0
    assert "## throughput" in capsys.readouterr().out
    with pytest.raises(NotConfigured):
        main(["bench", "run", tables])
    (tmp_path / "c.toml").write_text('[[candidates]]\nname = "a"\nmodel = "m/x"\nrevision = "0123456789abcdef0123456789abcdef01234567"\n')
    assert main(["bench", "candidates", str(tmp_path / "c.toml")]) == 0 and "m/x" in capsys.readouterr().out
    assert main(["adapters"]) == 0
