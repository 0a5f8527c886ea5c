import base64

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions.vectors import decoded_base64, half_precision
from foliant.operators import telemetry
from foliant.operators.chunking import token_windows
from foliant.plans import config, report
from foliant.sources import html


def test_settings(tmp_path):
    (tmp_path / "s.toml").write_text("[chunks]\nchars = 500\n[other]\nx = 1\n")
    s = config.load(tmp_path / "s.toml", {"chunks": {"overlap": 50}})
    assert (s.chunks.chars, s.chunks.overlap, s.plugins) == (500, 50, {"other": {"x": 1}}) and config.load().routing.min_chars == 50
    (tmp_path / "bad.toml").write_text("[routing]\nmin_charz = 1\n")
    with pytest.raises(ValueError):
        config.load(tmp_path / "bad.toml")
    with pytest.raises(FileNotFoundError):
        config.load(tmp_path / "none.toml")
    assert config.candidates([{"name": "a", "revision": "1"}])
    for rows in ([{"name": "pdfs", "revision": "1"}], [{"name": "a", "revision": "1"}] * 2, [{"name": "a"}]):
        with pytest.raises(ValueError):
            config.candidates(rows)


def test_report(spark):
    assert report.interval(0.5, 0.25, 0.75) == "0.500 [0.250, 0.750]" and report.interval(None, 1, 2) == "–" and report.p_value(0.0001) == "< 0.001" and report.percent(0.123) == "12.3 %"
    text = report.report("Run", scores=spark.createDataFrame([("a|b", 0.5), (None, None)], "n string, x double"))
    assert "| a\\|b | 0.500 |" in text and "| – | – |" in text and "## scores" in text
    out = spark.createDataFrame([("m", "1"), ("m", "2"), ("n", "1"), ("n", "zz")], "candidate string, sample_id string")
    gate = {r.candidate: r.problem for r in report.score_gate(out, spark.createDataFrame([("1",), ("2",)], "sample_id string")).collect()}
    assert gate == {"m": None, "n": "1 outputs missing"}
    first = spark.createDataFrame([("a", "best"), ("b", "tied"), ("c", "apart")], "candidate string, verdict string")
    assert [r.candidate for r in report.not_in_second_round(first, spark.createDataFrame([("a",)], "candidate string")).collect()] == ["b"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.6, 0.8],), (None,), ([],), ([float("nan")],)], "v array<float>")
    got = [r.h for r in df.select(half_precision("v").alias("h")).collect()]
    assert got[0] == pytest.approx(np.array([0.6, 0.8], dtype="float16").astype("float32").tolist()) and got[1] == got[0] and got[2:] == [None, None, None]
    raw = base64.b64encode(np.array([1.5, -2.0], dtype="<f4").tobytes()).decode()
    assert spark.createDataFrame([(raw,), (None,)], "t string").select(decoded_base64("t").alias("v")).first().v == [1.5, -2.0]


def test_token_windows(spark):
    df = spark.createDataFrame([(1, list(range(10))), (2, [1, 2]), (3, [])], "id int, t array<int>")
    out = {(r.id, r.start): r.t for r in token_windows(df, "id", "t", 4, 1).collect()}
    assert out == {(1, 0): [0, 1, 2, 3], (1, 3): [3, 4, 5, 6], (1, 6): [6, 7, 8, 9], (2, 0): [1, 2]}


def test_runs(spark):
    t = lambda rows, s: spark.createDataFrame(rows, s)
    c = telemetry.run_counters(t([("1",), ("2",), ("3",), ("4",)], "sample_id string"), t([("m", "1")], "candidate string, sample_id string"), t([("m", "2", None), ("m", "3", "x")], "candidate string, sample_id string, error string")).first()
    assert tuple(c) == ("m", 4, 1, 1, 1, 1)
    row = spark.range(1).select(telemetry.attempt_ladder(F.lit(600), F.lit(2)).alias("a"), telemetry.acceptable(F.lit("length"), F.lit("x")).alias("b"), telemetry.acceptable(F.lit(None), F.lit("x")).alias("c"), telemetry.environmental(F.lit(137)).alias("d")).first()
    assert [x.attempt for x in row.a] == [1, 2, 3] and (row.b, row.c, row.d) == (False, True, True)
    saved = t([("a", 0, 5, 5, 0.5, 3, 10), ("b", 0, 4, 5, 0.5, 3, 10), ("c", 0, 5, 5, 0.5, 2, 10), ("d", 0, 5, 5, 0.5, 3, 9), ("f", 0, 5, 5, None, 3, 10)], "candidate string, errors int, n_outputs int, n_samples int, mean double, scoring_version int, records long")
    now = t([(x, 10) for x in "abcdef"], "candidate string, records long")
    assert {r.candidate for r in telemetry.stale_scores(saved, now, "candidate", 3).collect() if not r.stale} == {"a"}


def test_html(spark):
    page = "<html><head><title>A  page</title><style>x{}</style></head><body><h2>Head</h2><p>One <b>two</b> &amp; three</p><ul><li>a</li><li>b</li></ul><table><tr><td>x</td><td>1</td></tr></table><pre>code  here</pre><script>no</script></body></html>"
    title, text = html.convert(page)
    assert title == "A page" and "## Head" in text and "- a\n- b" in text and "|x |1 |" in text and "```\ncode  here\n```" in text and "no" not in text.split()
    assert html.converted(spark.createDataFrame([("p", page), ("q", None)], "path string, text string")).count() == 1
