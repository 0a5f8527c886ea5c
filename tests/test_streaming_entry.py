import importlib
import json
import sys

import duckdb
import pytest

from foliant.operators.index import ChunkIndex
from foliant.plans import queries as core
from foliant.plans.sql import oracle_sql
from foliant.streaming import indexing, telemetry


SQL = oracle_sql()


def write(path, rows, n):
    path.mkdir(exist_ok=True)
    (path / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows))


def attempt(c, s, ts, n=1, error=None, reason="stop"):
    return {"candidate": c, "sample_id": s, "ts": ts, "attempts": n, "error": error, "finish_reason": reason}


def test_latest_attempts_as_a_stream(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    out.mkdir()
    write(src, [attempt("a", "1", "2026-01-01T00:00:00"), attempt("a", "2", "2026-01-01T00:00:05", error="x")], 1)
    run = lambda: telemetry.keep_latest(telemetry.stream(spark, str(src)), str(out), str(tmp_path / "cp")).awaitTermination(120)
    run()
    write(src, [attempt("a", "2", "2026-01-01T00:01:00", 2), attempt("a", "1", "2025-12-31T00:00:00", 3)], 2)
    run()
    rows = telemetry.stored(spark, str(out)).collect()
    assert {(r.sample_id, r.attempts, r.error) for r in rows} == {("1", 1, None), ("2", 2, None)}


def test_failure_rates_by_event_time(spark, tmp_path):
    src = tmp_path / "in"
    write(src, [attempt("a", str(i), f"2026-01-01T00:{i:02d}:00", error="x" if i % 2 else None, reason="length") for i in range(20)], 1)
    q = telemetry.failure_rates(telemetry.stream(spark, str(src))).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.pages, r.errors, r.truncated) for r in spark.table("rates").collect()) == [(10, 5, 10), (10, 5, 10)]


def test_index_follows_a_stream_of_pages(spark, tmp_path):
    src = tmp_path / "pages"
    pages = lambda rows, n: spark.createDataFrame(rows, "doc_id string, page long, text string, title string").coalesce(1).write.mode("append").parquet(str(src))
    pages([("a", 1, "one", None), ("b", 1, "two", None)], 1)
    ix = ChunkIndex(spark, str(tmp_path / "ix"))
    run = lambda: indexing.index_stream(spark.readStream.schema("doc_id string, page long, text string, title string").parquet(str(src)), ix, str(tmp_path / "cp")).awaitTermination(120)
    run()
    pages([("a", 1, "one", None), ("b", 1, "changed", None)], 2)
    run()
    assert {(r.doc_id, r.text.strip()) for r in ix.search_state().collect()} == {("a", "one"), ("b", "changed")}


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_queries_run_and_match_their_sql(spark, sf, name):
    got = core.queries()[name](spark, sf).toPandas()
    if name not in SQL:
        assert len(got.columns)
        return
    con = duckdb.connect()
    for t in ("manifests", "segments", "chunks", "questions", "hits", "ocr_results", "documents", "eval_items", "embeddings", "events"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    cell = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "fiub" else str(v)
    rows = lambda df: sorted(str([cell(v) if str(v) not in ("<NA>", "NaT") else None for v in r]) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def test_entry_and_optional_subpackage(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    hidden = {k: sys.modules.pop(k) for k in [k for k in sys.modules if k.startswith("foliant.llm")]}
    sys.modules["foliant.llm"] = None
    try:
        alone = importlib.reload(entry)
        assert set(alone.queries()) == set(core.queries())
    finally:
        del sys.modules["foliant.llm"]
        sys.modules.update(hidden)
        importlib.reload(entry)
