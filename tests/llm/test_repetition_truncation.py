import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm.repetition import SHARE, STATISTICS, learn_list, list_expression, measured, repeated_share, repetitive, with_statistics
from foliant.llm.truncation import cut_rates, ending, find_limits, fit_censored, fit_endings, length_limits, truncation, truncation_rates

PROSE = (
    "The survey cost less than three hundred coins and was faded enough for workers. In the second year critics found that a camera cannot change a "
    "reliable battery on its own. Every team has its own scanner, so images must describe both before the work began. Neither the camera nor the report "
    "proved useful for the builders, which is good news. There was a reliable street in the village, but few volunteers showed it. "
)


@pytest.mark.parametrize(
    ("text", "low", "high"),
    [
        (None, 0, 0), ("", 0, 0), (PROSE, 0, 0.01), ("the " * 60, 0.9, 1), (PROSE + "and then again " * 60, 0.6, 1),
        (PROSE + PROSE, 0.49, 0.51), (PROSE + PROSE.replace("survey", "survcy").replace("team", "tearn") * 1, 0.4, 0.51),
        ("".join(f"Figure {i}: The market cost less than nine coins in the end.\n" for i in range(12)), 0.85, 1),
        ("\n".join("| bandwidth | 0.62 | 2.5 |" for _ in range(20)), 0.9, 1),
        ("\n".join(f"| row{chr(97 + i)} | {i * 7} | {i * 3}.5 |" for i in range(20)), 0, 0.1),
        (" ".join(f"Table {i} lists the value of {chr(97 + i) * 5} and of {chr(98 + i) * 7} in the year." for i in range(20)), 0, 0.2),
        ("a b c", 0, 0), ("7 " * 60, 0.9, 1), (" ".join(map(str, range(60))), 0, 0), (" ".join(f"page {i} of the book" for i in range(40)), 0.9, 1),
        ("\n".join(f"| {i * 7 % 11} | {i * 5 % 13} | {i * 3 % 17} |" for i in range(40)), 0, 0.2),
    ],
)
def test_repeated_share(text, low, high):
    assert low <= repeated_share(text) <= high


def test_learned_list_separates_what_thresholds_can():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(600), "b": rng.random(600), "c": rng.random(600)}
    y = (x["a"] < 0.2) & (x["b"] > 0.5) | (x["c"] > 0.9)
    rules = learn_list(x, y)
    hit = np.zeros(600, dtype=bool)
    for r in rules:
        hit |= np.logical_and.reduce([x[c.statistic] <= c.threshold if c.at_most else x[c.statistic] > c.threshold for c in r])
    assert (hit & y).sum() / y.sum() > 0.9 and (hit & y).sum() / hit.sum() > 0.7
    assert hit[y].all()  # the last rule takes what the others leave
    assert learn_list(x, np.zeros(600, dtype=bool)) == [()]


def test_long_loops_take_linear_time():
    for text in ("7 " * 100_000, "of the " * 50_000, " ".join(map(str, range(100_000))), " ".join(f"{i % 10} {i % 7}" for i in range(50_000))):
        began = time.perf_counter()
        repeated_share(text)
        assert time.perf_counter() - began < 2


def test_list_and_exact_measure_agree_on_the_test_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/ocr_results.parquet")
    found = {r.result_id for r in repetitive(rows, "result_id", "text").collect()}
    exact = {r.result_id for r in measured(rows, "result_id").collect() if r.share >= SHARE}
    assert found <= exact and len(found) >= 0.99 * len(exact)


def test_repetition_with_awkward_rows(spark, with_clashes):
    rows = [(i, PROSE.replace("team", f"team{i}")) for i in range(60)] + [(100 + i, "loop again " * 80) for i in range(30)] + [(200, None), (201, ""), (202, "x " * 60_000), (None, "y " * 50)]
    df = with_clashes(spark.createDataFrame(rows, "id long, text string"))
    assert {r.id for r in repetitive(df, "id", "text").collect()} == {*range(100, 130), 202}
    assert with_statistics(df, "id", "text").columns == ["id", "text", *STATISTICS]
    empty = spark.createDataFrame([], "id long, text string")
    assert repetitive(empty, "id", "text").count() == 0 and measured(empty, "id").count() == 0
    assert spark.range(1).select(list_expression([]).alias("x")).first().x == 0


def test_repetition_that_the_sample_does_not_hold_is_found(spark):
    rows = [(i, PROSE.replace("team", f"team{i}")) for i in range(400)] + [(1000, "loop again " * 80), (1001, PROSE + PROSE)]
    df = spark.createDataFrame(rows, "id long, text string")
    assert {r.id: r.rule for r in repetitive(df, "id", "text", sample=1).collect()} == {1000: 1, 1001: 1}


ENDINGS = {
    "closed": ["It ends.", "He said “so.”", "see Ondeskas et al.", "text.\n- 2 -", "text.\niv", "text.\nPage 2 of l3", "| a | 1 |", "text.\n\n1904", "* * *", "text.\n[3]", "k ≤ √n   (4)", "fell (see x1)."],
    "standalone": ["text.\n\nFig. 3 Sobre la fuente", "text.\n\n6.7 Kopie und Treffer", "text.\n\n1) one thing\n2) two things", "text.\n\nx² + y² = 25"],
    "open": ["the effect of the", "these results\nshow that latency", "text.\n\nD'habitude, quand le fragm", "of of of of o"],
    "broken": ["reported by Jasimarx (198", "text | 0.", "| samp | 1", "care&am", "were com <t", "perturb $\\frac{", "by Wexibr (", "state-of-"],
    "mark": ["the distribut...", "of the attribut…", "factoris [truncated]", "persi (more)", "residu�"],
}


def test_kinds_of_endings(spark):
    rows = [(k, t) for k, ts in ENDINGS.items() for t in ts] + [(None, None), (None, ""), (None, " \n ")]
    df = spark.createDataFrame(rows, "wanted string, text string").withColumn("got", ending(F.col("text")))
    assert [(r.wanted, r.text, r.got) for r in df.collect() if r.wanted != r.got and not (r.text and not r.text.strip())] == []


def test_only_page_numbers_are_numbered_endings(spark):
    rows = [
        ("standalone", "200 drivers a day. In the\nl", 1), ("open", "| corpus | 0.05 |\n\nL", 7), ("open", "it was led by\nvi", 3), ("open", "a total of\n14", 3), ("open", "as it fell on\npage lo", 3),
        ("closed", "in the\n17", 17), ("closed", "in the\n1l", 11), ("closed", "in the\nxiv", 14), ("closed", "text.\nl", 1), ("closed", "text.\n\n1904", 5), ("closed", "text.\n12", 5),
        ("closed", "in the\n- 4 -", 6), ("broken", "by Jasimarx\n(198", 198), ("open", "in the\n14", None), ("closed", "text.\n14", None), ("open", "in the\nxx", 500), ("open", "in the\nvi", 0),
    ]
    df = spark.createDataFrame(rows, "wanted string, text string, page int").withColumn("got", ending(F.col("text"), F.col("page")))
    assert [(r.wanted, r.text, r.page, r.got) for r in df.collect() if r.wanted != r.got] == []


def test_censored_fit_finds_the_uncensored_distribution():
    rng = np.random.default_rng(1)
    x = rng.normal(7.3, 0.4, 4000)
    cut = np.minimum(x, 7.5)
    mu, sd = fit_censored(cut, np.ones(4000), x > 7.5)
    assert abs(mu - 7.3) < 0.03 and abs(sd - 0.4) < 0.03


def test_limits_are_found_and_natural_lengths_are_not():
    rng = np.random.default_rng(2)
    v = np.minimum(np.exp(rng.normal(7.3, 0.4, 3000)).astype(int), 2000)
    values, counts = np.unique(v, return_counts=True)
    found = find_limits(values, counts)
    assert any(lo <= 2000 <= hi and p > 0.95 for lo, hi, p, _, _ in found)
    v = np.exp(rng.normal(7.3, 0.4, 3000)).astype(int)
    assert all(p < 0.9 or hi < 1000 for lo, hi, p, _, _ in find_limits(*np.unique(v, return_counts=True))[:1])


def test_a_sure_limit_overrules_a_closed_ending(spark):
    rng = np.random.default_rng(4)
    rows, story = [], PROSE * 40
    for source in ("cut", "free"):
        for n in np.exp(rng.normal(7.3, 0.4, 1500)).astype(int):
            at = int(rng.integers(0, len(PROSE)))
            end = story.find(". ", at + n) + 1
            rows.append((len(rows), source, story[at : at + 1500] if source == "cut" and end - at > 1500 else story[at:end]))
    df = spark.createDataFrame(rows, "id long, source string, text string")
    by = {r.id: r for r in truncation(df, "id", "text", "source", {"chars": F.length("text")}).collect()}
    sure = [by[i] for i, s, t in rows if s == "cut" and len(t) == 1500]
    assert any(r.ending == "closed" for r in sure) and all(r.truncated for r in sure)
    assert not any(by[i].truncated for i, _, t in rows if len(t) != 1500)
    assert all(by[i].by_ending is False for i, s, t in rows if s == "cut" and len(t) == 1500 and by[i].ending == "closed")


def test_shares_of_endings_and_cut_rates_are_recovered():
    rng = np.random.default_rng(5)
    at, whole = np.array([0.02, 0.1, 0.8, 0.05, 0.03]), np.array([0, 0, 0, 0.1, 0.9])
    true, n = np.array([0.01, 0.97, 0.6]), np.array([20_000, 300, 200])
    counts = np.array([rng.multinomial(int(m * r), at) + rng.multinomial(int(m * (1 - r)), whole) for m, r in zip(n, true)], dtype=float)
    limited, prior = np.array([False, True, True]), np.array([0.05, 0.95, 0.9])
    cut, off, ends, rate = fit_endings(counts, prior, limited, 1000 * at)
    assert np.abs(rate - true).max() < 0.05 and abs(cut[2] - 0.8) < 0.05 and abs(ends[4] - 0.9) < 0.02 and ends[:3].max() <= 0.0001
    assert np.allclose(cut_rates(counts[1:], prior[1:], cut, ends), rate[1:], atol=0.01)
    assert np.isfinite(np.concatenate([*fit_endings(np.zeros((0, 5)), np.zeros(0), np.zeros(0, dtype=bool), np.zeros(5))[:3]])).all()


def test_captions_of_several_sentences_need_a_stop(spark):
    rows = [("open", "Fig. 3 shows the range. The effect of the"), ("standalone", "Fig. 3 On the range"), ("open", "1) one thing. And then the\n2) other things. And so"), ("closed", "x" * 5000 + "\n" + "y.")]
    df = spark.createDataFrame(rows, "wanted string, text string").withColumn("got", ending(F.col("text")))
    assert [(r.wanted, r.text, r.got) for r in df.collect() if r.wanted != r.got] == []


def test_truncation_combines_limit_and_ending(spark, with_clashes):
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for source in ("cut", "free", None):
        for n in np.exp(rng.normal(5.5, 0.5, 400)).astype(int):
            text = ("word " * (n // 5 + 2))[: max(10, n)].strip() + "."
            if source == "cut" and len(text) > 300:
                text = text[:300]
            rows.append((i, source, text, None))
            i += 1
    rows += [(i, "free", "stops within a wo", 5), (i + 1, "free", None, 5), (i + 2, "free", "", None), (i + 3, "free", "text.\n\nFig. 3 A caption", 7), (i + 4, "free", "w " * 50_000 + "end.", 1)]
    df = with_clashes(spark.createDataFrame(rows, "id long, source string, text string, tokens long"), but=("tokens",))
    out = truncation(df, "id", "text", "source", {"chars": F.length("text"), "tokens": F.col("tokens")})
    by = {r.id: r for r in out.collect()}
    assert by[i].truncated and i + 1 not in by and i + 2 not in by and not by[i + 3].truncated and not by[i + 4].truncated
    cut = [r for r in rows[:400] if len(r[2]) == 300 and not r[2].endswith(".")]
    assert len(cut) > 50 and all(by[r[0]].truncated and by[r[0]].censored > 0.9 for r in cut)
    assert not any(by[r[0]].truncated for r in rows[400:1200])
    assert {r.source for r in truncation_rates(out).collect()} == {"cut", "free", "?"}
    empty = spark.createDataFrame([], "id long, source string, text string, tokens long")
    assert truncation(empty, "id", "text", "source", {"chars": F.length("text")}).count() == 0
    assert length_limits(spark.createDataFrame([], "source string, measure string, value long")).count() == 0
