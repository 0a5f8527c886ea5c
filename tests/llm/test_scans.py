import math

import pytest
from pyspark.sql import functions as F

from foliant.llm.scans import CONFUSION_COST, LEAST_COST, Confusions, WordFilter, build_index, continuous, corpus_counts, defects, deleted_forms, fold, learned_confusions, page_lines, repaired, repairs, roman, split_words, tokens, unwrapped

KNOWN = frozenset("two to mid or segmentation experiment the of state".split())


@pytest.mark.parametrize(("text", "split"), [("segmen-\ntation", True), ("exper¬\niment", True), ("soft\xad\nened", True), ("segme- \n ntation", True), ("a two-\nto three-fold", False), ("mid-\nor high", False), ("1987-\n1991", False), ("- 3 -\nOn", False), ("plain\ntext", False)])
def test_split_words(text, split):
    assert split_words(text, KNOWN) is split


@pytest.mark.parametrize(
    ("text", "page", "first", "last", "in_head", "misread"),
    [
        ("body\n— 4 —", 4, False, True, False, False), ("4\nbody", 4, True, False, False, False), ("body\niv", 4, False, True, False, False),
        ("body\n[4]", 4, False, True, False, False), ("body\nPage l of 3", 1, False, True, False, True), ("body\n1904", 4, False, False, False, False),
        ("4 Calibration in independent\nbody", 4, False, False, True, False), ("Calibration in 4\nbody", 4, False, False, True, False),
        ("body\n(iii)", 3, False, False, False, False), ("8. Notes on geobractar\n\nbody", 8, False, False, False, False), ("```markdown\n7\nbody\n```", 7, True, False, False, False),
        ("body\np. 1O", 10, False, True, False, True), ("", 1, False, False, False, False),
    ],
)
def test_page_numbers(text, page, first, last, in_head, misread):
    x = page_lines(text, page)
    assert (x.number_first, x.number_last, x.number_in_header, x.misread_number) == (first, last, in_head, misread)


def test_small_parts():
    assert [roman(i) for i in (1, 4, 9, 14, 40)] == ["i", "iv", "ix", "xiv", "xl"]
    assert fold("Re†rodralean Bulletin, V0l. 54") == fold("Retrodralean Bulletin, Vol. 54")
    assert unwrapped("Here is the text of the page:\n\n<page>x y</page><|end|>") == "x y"
    assert tokens("The compara¬\nble re@ding wi†h Be!trag fell!") == ["the", "comparable", "re@ding", "wi†h", "be!trag", "fell"]
    assert tokens("cut in the mid")[-1] == "the"
    assert ("mark\x01t", "c", "") in deleted_forms("markct", False) and ("mark\x01t", "e", "") in deleted_forms("market", True)


def corpus():
    rows, i = [], 0
    base = "the market of conditions was held constant and the reader from the number table with a hypothesis . the good hast was also in the house"
    for d in range(12):
        for p in range(1, 6):
            head = f"Bulletin of studies, Vol. {d}" if d % 2 else None
            text = "\n".join(x for x in (head, base + f" and page word{chr(97 + d)} .", base + " .", f"— {p} —" if d % 3 == 0 else None) if x)
            rows.append((i, f"d{d}", p, text, None))
            i += 1
    dirty = "Bulletin of stuclies, Vol. 1\nthe markct of con-\nditions was hcld constant frorn the riumber ."
    rows.append((1000, "d1", 7, dirty, "wi†h the table"))
    rows += [(1001, None, None, "the market 5 .", ""), (1002, "d1", 8, None, None), (1003, "d1", 9, "", " "), (1004, "d2", 1, "the market " * 30_000 + ".", None), (1001, None, None, "the market 5 .", "")]
    return rows


SCHEMA = "result_id long, doc_id string, page_no int, text string, raw_text string"


def test_defects_and_repairs(spark, with_clashes):
    df = with_clashes(spark.createDataFrame(corpus(), SCHEMA))
    found = {(r.result_id, r.field, r.defect) for r in defects(df).collect()}
    assert {(1000, "text", "hyphenation"), (1000, "text", "misread"), (1000, "text", "header"), (1000, "raw_text", "misread")} <= found
    rest = {f for f in found if f[0] < 1000}
    assert {f[0] for f in rest if f[2] == "header"} == {i for i in range(60) if (i // 5) % 2}
    assert {f[0] for f in rest if f[2] == "pagenum"} == {i for i in range(60) if (i // 5) % 3 == 0}
    assert not [f for f in rest if f[2] in ("misread", "hyphenation")] and not [f for f in found if f[0] > 1000]
    fixed = {(r.result_id, r.field): r.text for r in repaired(df).collect()}
    assert fixed[1000, "text"] == "the market of conditions was held constant from the number ." and fixed[1000, "raw_text"] == "with the table"
    assert (1002, "text") not in fixed and fixed[1003, "text"] == ""
    assert "— 1 —" not in fixed[0, "text"]


def test_defects_of_an_empty_table(spark):
    e = spark.createDataFrame([], SCHEMA)
    assert defects(e).count() == 0 and repaired(e).count() == 0


def test_index_finds_candidates_by_frequency(spark):
    text = "the market was good . " * 80 + "the markct was good . he sets a bad car . " + "she had an ear . he had an ear . " * 30 + "the car was red . " * 20
    counts = corpus_counts(spark.createDataFrame([(1, text)], "id int, text string"), ["text"])
    r = {x.word: x.candidates[0].repair for x in repairs(counts).collect()}
    assert r.get("markct") == "market" and "car" not in r and "market" not in r


def test_known_words_of_the_index(spark):
    ix = build_index(spark.createDataFrame(corpus(), SCHEMA), ["text", "raw_text"])
    assert {"market", "conditions", "table"} <= ix.known and "markct" not in ix.known


def test_continuous_keeps_lists_and_paragraphs():
    out = continuous("3 Running head\nFirst line of a para-\ngraph goes on\nhere.\n\n1) one item\n2) two items\n- 3 -", 3, fold("Running head"), {}, frozenset())
    assert out == "First line of a paragraph goes on here.\n\n1) one item\n2) two items"


def test_rare_words_are_repair_targets_in_a_large_corpus(spark):
    counts = spark.createDataFrame([("the", 400_000_000), ("mesoquenine", 40), ("mcsoquenine", 1), ("two", 90), ("three", 90)], "word string, n long")
    assert {r.word: r.candidates[0].repair for r in repairs(counts).collect()} == {"mcsoquenine": "mesoquenine"}


def test_words_beyond_the_sent_ones_are_joined(spark):
    rows = corpus() + [(2000, "e", 1, "the reader of the num-\nber and the good-\nmarket .", None), (2001, "e", 2, "the good-\nhouse . the hast-\nhypothesis .", None), (2002, "e", 3, "the good-\nabcd . the mar- \xa0\nket .", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole, part = build_index(df, ["text", "raw_text"]), build_index(df, ["text", "raw_text"], 5)
    assert whole.trusted is None and part.known < whole.known and len(part.known) <= 5
    assert {r.word for r in part.trusted.collect()} == whole.known
    found = [sorted(map(tuple, defects(df, sent=n).collect())) for n in (100_000, 5, 0)]
    assert found[0] == found[1] == found[2] and {r[0] for r in found[0] if r[2] == "hyphenation"} == {1000, 2000, 2002}
    texts = [sorted(map(tuple, repaired(df, sent=n).collect())) for n in (100_000, 5, 0)]
    assert texts[0] == texts[1] == texts[2]


def test_word_filter_holds_all_words(spark):
    f = WordFilter(WordFilter.bits_of(spark.createDataFrame([("market",), ("the",), ("naïve",)], "w string")))
    assert all(w in f for w in ("market", "the", "naïve")) and "house" not in f and f.isdisjoint(["house"]) and not f.isdisjoint(["house", "the"])
    assert "the" not in WordFilter(WordFilter.bits_of(spark.createDataFrame([], "w string")))


def test_confusions_are_learned_from_the_corpus(spark):
    names = ["water", "letter", "butter", "matter", "bitter", "winter", "sister", "better", "center", "poster"]
    rows = [(w, 900) for w in names] + [(w.replace("t", "f", 1), 2) for w in names]  # a confusion that no table knows
    rows += [(w + "s", 2) for w in names] + [("wafcr", 1)]  # grammar is none
    learned = {(a, b): c for a, b, c in learned_confusions(spark.createDataFrame(rows, "word string, n long")).pairs}
    assert learned["f", "t"] == LEAST_COST and learned["c", "e"] == CONFUSION_COST and not any(a == "" or b == "" or a == "s" for a, b in learned)
    fixed = {r.word: (r.candidates[0].repair, round(r.candidates[0].cost + math.log10(900) / 10, 3)) for r in repairs(spark.createDataFrame(rows, "word string, n long"), learned_confusions(spark.createDataFrame(rows, "word string, n long"))).collect()}
    assert fixed["lefter"] == ("letter", LEAST_COST) and fixed["wafcr"] == ("water", round(LEAST_COST + CONFUSION_COST, 3)) and "waters" not in fixed
    assert learned_confusions(spark.createDataFrame([], "word string, n long")) == Confusions(tuple(sorted(Confusions().pairs, key=lambda x: (x[2], x[0], x[1]))))


def test_confusions_are_learned_from_all_rare_words(spark):
    names = ["hospital", "material", "practice", "customer", "chapters"]  # as many as a confusion needs
    rows = spark.createDataFrame([(w, 900) for w in names] + [(w.replace("t", "f", 1), 2) for w in names], "word string, n long")
    others = spark.range(400_000).select(F.translate(F.lpad(F.lower(F.conv("id", 10, 26)), 4, "0"), "0123456789", "qrstuvwxyz").alias("word"), F.lit(1).cast("long").alias("n"))
    learned = {(a, b): c for a, b, c in learned_confusions(rows.unionByName(others)).pairs}
    assert learned["f", "t"] == LEAST_COST
