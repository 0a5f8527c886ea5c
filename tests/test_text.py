import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions.normal import clean_transcription, edit_distance, normal_form, plain_text, tex_to_text


def one(spark, value, f, **more):
    row = spark.createDataFrame([(value, *more.values())], ["t STRING".split()[0], *more]) if value is not None else spark.createDataFrame([(None,)], "t string")
    return row.select(f(F.col("t")).alias("x")).first().x


def test_garbage_and_letters(spark):
    assert one(spark, "abcd", T.garbage_ratio) == 0
    assert one(spark, "ab� \x02", T.garbage_ratio) == pytest.approx(2 / 5)
    assert one(spark, "(cid:12)ab", T.garbage_ratio) == pytest.approx(8 / 10)
    assert one(spark, "   ", T.garbage_ratio) == 0 and one(spark, None, T.garbage_ratio) is None
    assert one(spark, "ab1é", T.alpha_ratio) == pytest.approx(0.75)


def test_text_layer(spark):
    clean = lambda s: one(spark, s, T.clean_text_layer)
    assert clean("transduction\nof trans\x02duction and sequence\x02aligned") == "transduction\nof transduction and sequence-aligned"
    assert clean("a\r\nb  \n\n\n\nc\x07") == "a\nb\n\nc"
    assert clean("2019-\n2020") == "2019-2020"


@pytest.mark.parametrize(
    ("n", "cover", "garbage", "alpha", "force", "reasons"),
    [
        (1000, 0.0, 0.0, 0.9, False, []), (10, 0.0, 0.0, 0.9, False, ["only 10 embedded chars (<50)"]),
        (100, 0.9, 0.0, 0.9, False, ["image covers 90% of page with little text"]), (1000, 0.9, 0.2, 0.4, False, ["garbled text layer (20% bad glyphs)", "low alphabetic ratio (40%)"]),
        (1000, 0.0, 0.0, 0.9, True, ["forced (--ocr-all)"]), (10, 0.0, 0.0, 0.1, True, ["only 10 embedded chars (<50)"]),
    ],
)
def test_routing(spark, n, cover, garbage, alpha, force, reasons):
    row = spark.range(1).select(T.ocr_reasons(F.lit(n), F.lit(cover), F.lit(garbage), F.lit(alpha), F.lit(force)).alias("r")).first()
    assert row.r == reasons


def test_pages_round_trip(spark):
    pages = [(1, "m", "one\n\ntwo"), (3, "m", ""), (7, "m", "# not a title")]
    df = spark.createDataFrame([(pages,)], "p array<struct<number:int,method:string,text:string>>")
    md = df.select(T.render_pages(F.lit("Title"), F.col("p")).alias("m"))
    assert md.first().m.startswith("# Title\n\n<!-- page 1 | method=m -->\none")
    back = md.select(T.split_pages(F.col("m")).alias("p")).first().p
    assert [(x.number, x.text) for x in back] == [(n, t) for n, _, t in pages]
    again = one(spark, "<!-- page 1 | method=m -->\na\n<!-- page 2 | method=m -->\nb\n<!-- page 1 | method=m -->\nc", T.split_pages)
    assert [(x.number, x.text) for x in again] == [(1, "c"), (2, "b")]


def test_small_texts(spark):
    assert one(spark, "# Old\n\nbody", lambda c: T.retitled(c, F.lit("Old"), F.lit("New"))) == "# New\n\nbody"
    assert one(spark, "# Other", lambda c: T.retitled(c, F.lit("Old"), F.lit("New"))) is None
    cite = lambda a, y: spark.range(1).select(T.citation(F.lit("T"), F.array(*map(F.lit, a)) if a else F.array().cast("array<string>"), F.lit(y), F.lit("1.2v3"), F.lit("file")).alias("c")).first().c
    assert cite(["Ann B. Smith", "X"], 2001) == "Smith et al. (2001). T. arXiv:1.2v3" and cite([], None) == "T. arXiv:1.2v3" and cite(["Ann Lee"], None) == "Lee. T. arXiv:1.2v3"
    assert one(spark, "Some Org/Model-4B!", T.slug) == "some-org-model-4b"
    assert one(spark, "https://arxiv.org/pdf/1706.03762v7.pdf", T.arxiv_id) == "1706.03762" and one(spark, "arXiv:math/0211159v1", T.arxiv_version) == "v1"
    assert one(spark, "ids: a1, b2 a1v2", T.id_list) == ["a1", "b2"]
    assert one(spark, 'attachment; filename="x y.tar.gz"', T.disposition_name) == "x y.tar.gz"
    assert one(spark, 'W/"abc"', T.bare_etag) == "abc"
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    assert one(spark, "120", lambda c: T.retry_after_seconds(c, now)) == 120 and one(spark, "Thu, 01 Jan 2026 00:01:00 GMT", lambda c: T.retry_after_seconds(c, now)) == 60
    assert one(spark, "soon", lambda c: T.retry_after_seconds(c, now)) is None
    assert one(spark, "https://a/b", lambda c: T.with_query(c, q=F.lit("x y"), n=F.lit("1"))) == "https://a/b?q=x+y&n=1"
    assert one(spark, " \n<!DOCTYPE html>", T.is_html) and not one(spark, "see <html>", T.is_html)
    assert one(spark, "what", lambda c: T.format_query(F.lit("Find it"), c)) == "Instruct: Find it\nQuery:what"


@pytest.mark.parametrize(
    ("question", "english"),
    [("What is the effect of heat?", True), ("transformer attention", True), ("¿Cuál es la fuente?", False), ("Wie hängt die Fassung zusammen?", False), ("Comment la boîte dépend-elle de ce seuil ?", False), ("résumé naïve", False), (None, False)],
)
def test_looks_english(spark, question, english):
    assert one(spark, question, T.looks_english) is english


def test_unit_vectors(spark):
    v = spark.createDataFrame([([3.0, 4.0],)], "v array<double>").select(T.unit(F.col("v")).alias("u"), T.dot(F.col("v"), F.col("v")).alias("d")).first()
    assert v.u == pytest.approx([0.6, 0.8]) and v.d == 25


def test_normal_forms():
    assert tex_to_text(r"\mathrm{softmax}\left(\frac{QK^T}{\sqrt{d_k}}\right)") == "softmax(QKT √dk)"
    assert tex_to_text(r"$d_{model}$ is $\alpha = 0.3$") == "dmodel is α = 0.3" and tex_to_text("plain 5 % text") == "plain 5 % text"
    assert tex_to_text(r"\begin{tabular}a & b\\c & d\end{tabular} e & f") == "a   b c   d e & f" and tex_to_text("\\begin{x} a & b \\ c") == " a & b  c"
    assert tex_to_text(r"\left. x \right) 50\% \|v\| \, \hspace{2em}y\[z\] \alpha*") == " x ) 50% ‖v‖   y\\[z\\] α"
    assert plain_text("![alt](x.png) [text](u) <b>bold</b> &amp;").split() == ["text", "bold", "&"]
    assert normal_form("**Trans-\nduction** of `x` ﬁne") == "transduction of x fine"
    assert edit_distance("kitten", "sitting") == 3 and edit_distance([], ["a"]) == 1 and edit_distance("", "") == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_edit_distance_is_a_distance(a, b):
    d = edit_distance(a, b)
    assert d == edit_distance(b, a) and abs(len(a) - len(b)) <= d <= max(len(a), len(b)) and (d == 0) == (a == b)


def test_furniture(spark):
    from foliant.operators.scoring import without_furniture

    page = "Short Title\narXiv:1706.03762v7 [cs.CL] 2 Aug 2023\nBody text\nmore\n12"
    rows = [
        (1, "d", page, "Short Title\nBody text\nmore\n12", "Body text\nmore", "Body text\nmore"), (2, "other", "Title\nBody", "Title\nBody", "Title\nBody", "Title\nBody"), (3, "d", None, None, "", ""),
        (4, "d", "Short Title\na\n\nb", "Short Title\nx\nShort Title", "a\n\nb", "x\nShort Title"), (5, "d", "Short Title", "Short Title", "", ""), (6, None, "7\na\nb\n8", "7\na\nb\n9", "a\nb", "a\nb\n9"),
        (7, "d", "a\nb\nc\nShort Title\nd\ne\nf", "Short Title", "a\nb\nc\nShort Title\nd\ne\nf", "Short Title"),
    ]
    pairs = spark.createDataFrame([r[:4] for r in rows], "k int, doc string, ref string, hyp string")
    running = spark.createDataFrame([("d", "short title", 2)], "doc string, line string, pages long")
    out = {r.k: (r.ref, r.hyp) for r in without_furniture(pairs, running, "doc", "ref", "hyp").collect()}
    assert out == {r[0]: r[4:] for r in rows}


def test_transcription_is_unwrapped(spark):
    assert one(spark, "<think>hm</think>\n```markdown\nText\n```", clean_transcription) == "Text"
    assert one(spark, "Text<|end|>", clean_transcription) == "Text"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab\n ", max_size=20), min_size=1, max_size=5))
def test_any_pages_survive_rendering(spark, texts):
    rows = [(i + 1, "m", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(rows,)], "p array<struct<number:int,method:string,text:string>>")
    back = df.select(T.split_pages(T.render_pages(F.lit("T"), F.col("p"))).alias("p")).first().p
    assert [(x.number, x.text) for x in back] == [(n, t.strip()) for n, _, t in rows]


def test_stems_of_english_words(spark):
    from foliant.functions.stemming import english_words, stem

    wanted = {
        "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consistency": "consist", "consolation": "consol", "knack": "knack", "knackeries": "knackeri",
        "kneading": "knead", "knives": "knive", "generate": "generat", "generous": "generous", "communism": "communism", "ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "gaps": "gap", "kiwis": "kiwi",
        "hopping": "hop", "hoped": "hope", "luxuriated": "luxuri", "by": "by", "say": "say", "cry": "cri", "skies": "sky", "news": "news", "proceed": "proceed", "agreed": "agre", "feed": "feed", "relational": "relat",
        "conditional": "condit", "hopefulness": "hope", "sensibility": "sensibl", "apology": "apolog", "adoption": "adopt", "adjustment": "adjust", "probate": "probat", "controlling": "control", "roll": "roll", "national": "nation", "bed": "bed", "shed": "shed", "happily": "happili",
    }
    assert {w: stem(w) for w in wanted} == wanted
    df = spark.createDataFrame([("Running dogs' ways",), (None,), ("",)], "t string").select(english_words(F.col("t")).alias("w"))
    assert [r.w for r in df.collect()] == [["run", "dog", "way"], None, []]
