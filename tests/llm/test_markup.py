import re

import pytest
from pyspark.sql import functions as F

from foliant.llm.markup import ANY, clean, clean_texts, containers, has_markup, host_paths

PIECES = [
    "a <b>bold</b> word", "line<br/>break", 'x <a href="https://a.example/x">y</a>', "see <!-- page 3 | method=x --> it", "a&nbsp;b", "&#8212; dash",
    "# Heading\n\ntext", "a **bold** word", "an __under__ score", "~~struck~~", "run `code` now", "```text\nx\n```", "[text](b.md)", "![alt](fig.png)",
    "note[^3] here", "| a | b |\n|---|---|", "> quoted line", "- [ ] task", "* item", "Title\n=====\n\ntext", "[[link]] x", "''sic'' x", "== Head ==",
    "{| class=\"t\"\n|-\n|}", "a {{cite|k=3}} b", "[https://wiki.example/p at] least", "** item", "\\section{On x}", "the \\alpha sign", "5 \\% of",
    "with $x_{1}+k$ in", "$$a = b$$", "\\[ x \\]", "``the'' word", "{\\it first,} x", "% todo check",
]
PROSE = [
    "If a == b, then c_1 <= c_2 by rule (3).", "A Q&A list (cf. note *) follows.", "The file read_page_v2 ran for ~10 minutes.", "given as <LOD or as 2^10.",
    "the A* search written in C# for 5 * 3 runs", "|x| < 3 holds for the set {a, b} only", "n > 30 and p < 0.05 alike", "cited in [3] and [14].",
    "grant of $ 40 per page covers it", "in C:\\data\\run_7. See item #12 and R&D", "x² + y² = r²", "(2) second item", "* 3 runs of it", "+ 2c and more", ": records prefer it", "> 30 and p < 0.05", "α = 1/n", "", "   ",
]


@pytest.mark.parametrize("text", PIECES)
def test_pieces_are_found_and_removed(text):
    assert re.search(ANY, text)
    assert not re.search(ANY, re.sub(r"(?m)^    .*$", "", clean(text)))


@pytest.mark.parametrize("text", PROSE)
def test_prose_is_no_markup(text):
    assert not re.search(ANY, text)


def test_java_and_python_agree(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*PIECES, *PROSE, None])], "i int, text string")
    found = {r.i for r in rows.filter(has_markup(rows.text)).collect()}
    assert found == set(range(len(PIECES)))


LONG = "so long a passage, " * 30 + "ends"
LONG_PIECES = {
    f"a **{LONG}** b": f"a {LONG} b", f"an __{LONG}__ b": f"an {LONG} b", f"~~{LONG}~~": LONG, f"`{LONG}`": LONG, f"[{LONG}](b.md)": LONG, f"[x](https://a.example/{'p/' * 400})": "x",
    "see [x](https://a.example/a_(b)_(c(d))) y": "see x y", f"[[{LONG}]] x": f"{LONG} x", f"== {LONG} ==": LONG, "a {{cite\n| k = 3\n| t = x\n}} b": "a b", f"a {{{{{LONG}}}}} b": "a b", f"``{LONG}''": f"“{LONG}”",
}


def test_pieces_of_any_length_and_over_lines(spark):
    texts = [*LONG_PIECES, f"with ${LONG}$ in"]
    found = spark.createDataFrame([(t,) for t in texts], "text string").filter(has_markup(F.col("text")))
    assert {r.text for r in found.collect()} == set(texts) and all(re.search(ANY, t) for t in texts)
    assert {t: clean(t) for t in LONG_PIECES} == LONG_PIECES and "$" not in clean(texts[-1]).replace("$$", "")
    hard = ["**x " * 3_000, "__x " * 3_000, "[x](" + "(a" * 20_000, "{{x\n" * 3_000, "$x " * 3_001, "[" * 50_000]
    assert spark.createDataFrame([(t,) for t in hard], "text string").filter(has_markup(F.col("text"))).count() <= len(hard)


def test_structure_is_kept():
    text = clean("<h2>Title</h2>\n<p>One &amp; two</p><ul><li>a</li><li>b</li></ul><table><tr><td>x</td><td>1</td></tr></table><pre><code>if a &lt; b:\n    go()</code></pre>")
    assert text == "Title\n\nOne & two\n\n• a\n• b\n\nx\t1\n\n    if a < b:\n        go()"
    assert clean("# T\n\n$$\\frac{1}{n} \\sum_{i} x_{i}$$\n\n- [ ] one\n- [x] two") == "T\n\n(1)/(n) ∑_i x_i\n\n• one\n• two"
    assert clean("\\section{On x}\n\\begin{itemize}\n\\item a\n\\end{itemize}\n\\begin{tabular}{lr}\nk & 1 \\\\\n\\end{tabular}") == "On x\n\n• a\n\nk\t1"
    assert clean("{| class=\"t\"\n|-\n| a || 1\n|-\n| b || 2\n|}") == "a\t1\nb\t2"


def test_clean_table_with_awkward_rows(spark, with_clashes):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "<b>x</b>"), (4, "<b>x</b>"), (5, "plain " * 40_000), (6, "<p>" * 5000 + "**deep**")]
    out = clean_texts(with_clashes(spark.createDataFrame(rows, "id int, text string")), "id", "text").collect()
    assert len(out) == len(rows)
    by = {r.id: r for r in out}
    assert by[1].text is None and not by[1].had_markup and by[4].text == "x" and by[5].text == rows[5][1] and by[6].text == "deep"
    assert clean_texts(spark.createDataFrame([], "id int, text string"), "id", "text").count() == 0


def test_containers_have_generalised_paths():
    found = {p: n for p, n, _, _ in containers('<div class="post17"><p>text <a href="x">link</a></p></div><p>loose')}
    assert found == {"/div.post/p": 8, "/p": 5}


@pytest.mark.parametrize("broadcast", [5000, 0])
def test_host_paths_elect_the_shared_container(spark, with_clashes, monkeypatch, broadcast):
    monkeypatch.setattr("foliant.llm.markup.BROADCAST_HOSTS", broadcast)
    page = lambda i: f'<div class="nav"><a href="#">menu</a></div><div class="body{i}"><p>the article text of page {i}</p></div>'
    rows = [(i, "h", page(i)) for i in range(20)] + [(100, "h", "plain"), (101, None, None), (102, "other", "<p>alone</p>")]
    out = {r.id: r for r in host_paths(with_clashes(spark.createDataFrame(rows, "id int, host string, text string")), "id", "text", "host").collect()}
    assert out[3].text == "the article text of page 3" and out[3].paths == ["/div.body/p"]
    assert out[100].text == "plain" and out[101].text == "" and out[101].host == "?" and out[102].text == "alone"
    assert host_paths(spark.createDataFrame([], "id int, host string, text string"), "id", "text", "host").count() == 0


def test_host_paths_keep_structure_and_clean_other_marks(spark):
    nav = '<ul class="nav"><li><a href="#">menu</a></li><li><a href="#">more</a></li></ul><script>var x = 1;</script>'
    page = lambda i: nav + f"<div class='c'><h2>Part {i}</h2><p>Some **bold** text &amp; $a_1$ of page {i}, long enough to win.</p><ul><li>one point of it</li><li>other point of it</li></ul><table><tr><td>cell</td><td>{i}</td></tr></table></div>"
    rows = [(i, "h", page(i)) for i in range(30)] + [(100, "h", "# T\n\n- [x] a *b*"), (101, "h", "<p>only &lt;i&gt;</p>")]
    out = {r.id: r for r in host_paths(spark.createDataFrame(rows, "id int, host string, text string"), "id", "text", "host").collect()}
    assert out[3].text == "Part 3\n\nSome bold text & a_1 of page 3, long enough to win.\n\n• one point of it\n• other point of it\n\ncell\t3"
    assert out[100].text == "T\n\n• a *b*" and out[100].paths == [""] and out[101].text == "only <i>"
