import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.errors import NotConfigured
from foliant.operators import corpus, index, retrieval, scoring, statistics, telemetry
from foliant.operators.chunking import chunk_pages, content_keys
from foliant.operators.ranking import prefix_sums, top_per_group, value_ranks
from foliant.plans import registry


# ------------------------------------------------------------------------------------------------- ranking


def test_ranking_helpers_equal_brute_force(spark):
    r = random.Random(0)
    rows = [(r.choice("aab"), i, r.choice([None, 1.0, 2.0, 3.5, r.random()])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, id long, v double")
    got = {(x.k, x.id): x.rank for x in top_per_group(df, ["k"], [F.desc_nulls_last("v"), F.asc("id")], 20, F.col("id")).collect()}
    for k in "ab":
        own = sorted((x for x in rows if x[0] == k), key=lambda x: (x[2] is None, -(x[2] or 0), x[1]))[:20]
        assert {i: n for (kk, i), n in got.items() if kk == k} == {x[1]: n for n, x in enumerate(own, 1)}
    for x in value_ranks(df, ["k"], "v", parts=4).collect():
        vs = [v for k, _, v in rows if k == x.k and v is not None]
        assert (x.n_below, x.n_equal, x.n_group) == (sum(v < x.v for v in vs), sum(v == x.v for v in vs), len(vs))
    sums = {(x.k, x.id): x.s for x in prefix_sums(df.withColumn("one", F.lit(1)), ["k"], "id", "one", "s", width=16).collect()}
    for k in "ab":
        ids = sorted(i for kk, i, _ in rows if kk == k)
        assert all(sums[k, i] == n for n, i in enumerate(ids))
    empty = df.filter("false")
    assert top_per_group(empty, ["k"], [F.asc("id")], 3, F.col("id")).count() == 0 and value_ranks(empty, ["k"], "v").count() == 0


# ------------------------------------------------------------------------------------------------- chunks


def loop_chunks(pages, size, overlap):
    buffer, base, touched, out = "", 0, [], []
    for n, t in pages:
        buffer += t + "\n\n"
        touched.append(n)
        while len(buffer) > size:
            out.append((buffer[:size], touched[0], touched[-1], base))
            buffer, base, touched = buffer[size - overlap :], base + size - overlap, [n]
    if touched:
        out.append((buffer[:size], touched[0], touched[-1], base))
    return out


def test_chunks_equal_the_loop(spark):
    r = random.Random(1)
    for size, overlap in ((40, 10), (7, 0), (30, 29), (900, 100)):
        docs = {f"d{i}": [(p, "".join(r.choice("abc ") for _ in range(r.choice([0, 1, 5, 60, 300])))) for p in sorted(r.sample(range(1, 30), r.randint(1, 8)))] for i in range(12)}
        rows = [(d, p, t or None, "References" if p == 2 else None) for d, ps in docs.items() for p, t in ps]
        out = chunk_pages(spark.createDataFrame(rows, "doc_id string, page long, text string, title string"), size, overlap).collect()
        for d, ps in docs.items():
            got = [(x.text, x.first_page, x.last_page, x.start) for x in sorted((x for x in out if x.doc_id == d), key=lambda x: x.chunk)]
            assert got == loop_chunks(ps, size, overlap)
        pages_of = {d: {p for p, _ in ps} for d, ps in docs.items()}
        assert all(x.is_reference == (x.first_page <= 2 <= x.last_page and 2 in pages_of[x.doc_id]) for x in out)
    empty = spark.createDataFrame([], "doc_id string, page long, text string, title string")
    assert chunk_pages(empty).count() == 0 and content_keys(empty).count() == 0
    with pytest.raises(ValueError):
        chunk_pages(empty, 10, 10)


# ------------------------------------------------------------------------------------------------- retrieval


def test_dense_top_equals_numpy(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(300, 16)).astype("float32")
    m[17] = m[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(900, None), (901, [1.0])], "vec_id long, embedding array<float>").repartition(5)
    asked = df.filter("vec_id < 6").select(F.col("vec_id").alias("query_id"), "embedding")
    out = retrieval.dense_top(df, asked, 7).collect()
    u = m.astype("float64") / np.linalg.norm(m.astype("float64"), axis=1, keepdims=True)
    for q in range(6):
        s = u @ u[q]
        want = sorted(range(300), key=lambda i: (-round(s[i], 9), i))[:7]
        assert [x.vec_id for x in sorted((x for x in out if x.query_id == q), key=lambda x: x.rank)] == want
    assert retrieval.dense_top(df, asked.filter("false"), 3).count() == 0


def test_bm25_by_hand(spark):
    rows = spark.createDataFrame([(1, "heat and light"), (2, "heat heat cold"), (3, "none of it"), (4, None)], "chunk_id int, text string")
    asked = spark.createDataFrame([(1, "Heat?"), (2, "!!!"), (3, "zzz")], "question_id int, question string")
    out = {x.chunk_id: x.score for x in retrieval.bm25_top(rows, asked, 5).collect()}
    idf = math.log(1 + (3 - 2 + 0.5) / 2.5)
    assert out == pytest.approx({1: idf * 2.2 / 2.2, 2: idf * 2 * 2.2 / 3.2})


def test_rrf_ties_keep_first_appearance(spark):
    a = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "q int, k int, rank long")
    b = spark.createDataFrame([(1, 7, 1), (1, 6, 2)], "q int, k int, rank long")
    out = [(x.k, x.rank) for x in retrieval.rrf(a, b, "q", "k").orderBy("rank").collect()]
    assert out == [(6, 1), (5, 2), (7, 3)]
    assert [x.k for x in retrieval.rrf(a, b.filter("false"), "q", "k").orderBy("rank").collect()] == [5, 6]


def test_cap_and_rerank(spark):
    df = spark.createDataFrame([(1, i, "hot" if i < 6 else f"d{i}", i) for i in range(1, 10)], "q int, k int, doc string, rank long")
    assert [x.k for x in retrieval.cap_per_document(df, "q", "doc", 2, 4).orderBy("rank").collect()] == [1, 2, 6, 7]
    assert retrieval.cap_per_document(df, "q", "doc", 0, 100).count() == 9
    best = retrieval.rerank(df, "q", F.when(F.col("k") == 4, 1.0).when(F.col("k") == 5, 1.0), 3).orderBy("context").collect()
    assert [x.k for x in best] == [4, 5, 1]


# ------------------------------------------------------------------------------------------------- index and corpus


def test_index_life_cycle(spark, tmp_path):
    ix = index.ChunkIndex(spark, str(tmp_path / "ix"))
    make = lambda keys: spark.createDataFrame([(d, 0, f"{d} {k}") for d, k in keys.items()], "doc_id string, start long, text string")
    table = lambda keys: spark.createDataFrame(list(keys.items()), "doc_id string, key string")
    assert ix.search_state() is None and not ix.pending()
    first = {"a": "1", "b": "1", "c": "1"}
    assert tuple(index.update_index(ix, make(first), table(first)).first()) == (3, 0, 0, 0)
    second = {"a": "1", "b": "2", "d": "1"}
    assert tuple(index.update_index(ix, make(second), table(second)).first()) == (1, 1, 1, 1)
    assert {(r.doc_id, r.text) for r in ix.search_state().collect()} == {("a", "a 1"), ("b", "b 2"), ("d", "d 1")}
    seen = ix.search_state()
    ix.upsert(make({"e": "1"}).withColumn("key", F.lit("1")))
    assert ix.pending() and seen.count() == 3 and tuple(ix.stats().first()) == (4, 4, 3, 3, True)
    ix.commit()
    assert not ix.pending() and ix.search_state().count() == 4
    with ix.writer(), pytest.raises(RuntimeError), ix.writer():
        pass
    before = ix.table.state()["parts"]
    ix.remove(spark.createDataFrame([("e",)], "doc_id string"))
    ix.commit()
    after = ix.table.state()["parts"]
    assert ix.search_state().count() == 3 and {b: p for b, p in after.items()} == {b: p for b, p in before.items() if b in after}  # other buckets are not written
    assert ix.clean() == [] and len(ix.clean(0)) >= 1 and ix.search_state().count() == 3


def test_diff_states(spark):
    t = lambda rows: spark.createDataFrame(rows, "doc_id string, key string")
    d = {r.doc_id: r.state for r in index.diff(t([("a", "1"), ("b", None), ("c", "2")]), t([("b", None), ("c", "1"), ("z", "1")])).collect()}
    assert d == {"a": "new", "b": "unchanged", "c": "changed", "z": "stale"}


def test_corpus_tables(spark):
    m = spark.createDataFrame([("a", 3, 5, "p1"), ("a", 2, 2, "p2"), ("a", 2, 2, "p0"), ("b", None, 3, "p3"), (None, 1, 1, "p4")], "doc_id string, n_pages int, source_pages int, source_path string")
    assert {(r.doc_id, r.source_path) for r in corpus.best_variant(m, [F.asc("source_path")]).collect()} == {("a", "p0"), ("b", "p3")}
    items = spark.createDataFrame([(c, i) for c in "xy" for i in range(50)], "c string, i int")
    small, large = ({(r.c, r.i) for r in corpus.nested_sample(items, "c", "i", n).collect()} for n in (5, 12))
    assert small < large and len(small) == 10
    s = corpus.compare_sets(a=spark.createDataFrame([(1,), (2,), (2,)], "k int"), b=spark.createDataFrame([(2,), (None,)], "k int")).first()
    assert (s.both, s.only_a, s.only_b) == (1, 1, 0)
    rows, owners = spark.range(0, 20_000, 7).toDF("row"), spark.createDataFrame([("a", 0, 5000), ("b", 5000, 10_000), ("c", 16_000, 0)], "who string, start long, size long")
    assert {r.who: r.n for r in corpus.owner_as_of(rows, owners).groupBy("who").agg(F.count("*").alias("n")).collect()} == {"a": 715, "b": 1428}
    late = corpus.latest(spark.createDataFrame([("k", 1, 1, "x"), ("k", None, 2, "y"), ("k", 1, 3, "z")], "k string, ts int, id int, v string"), ["k"], ["ts"], "id").first()
    assert late.v == "z"


# ------------------------------------------------------------------------------------------------- telemetry


def test_streaks_budget_rank(spark):
    df = spark.createDataFrame([("a", i, e, 2.0) for i, e in enumerate([None, "x", "x", None, "x"])] + [("b", 0, None, None)], "c string, t int, error string, s double")
    out = [(r.c, r.streak, r.length, r.first, r.last) for r in telemetry.failure_streaks(df, ["c"], ["t"], F.col("error").isNotNull()).orderBy("streak").collect()]
    assert out == [("a", 1, 2, 1, 2), ("a", 2, 1, 4, 4)]
    assert telemetry.within_budget(df, ["c"], ["t"], "s", 5.0).filter("c = 'a'").count() == 3
    s = spark.createDataFrame([("x", 0.5, False, True), ("y", 0.9, True, True), ("z", None, False, True), ("w", 0.7, False, True)], "n string, m double, e boolean, h boolean")
    assert [r.n for r in telemetry.rank_candidates(s, "n", "m", "e", "h").orderBy("place").collect()] == ["w", "x", "y", "z"]


# ------------------------------------------------------------------------------------------------- statistics and scores


def brute_p(w):
    total = sum(w)
    return sum(abs(sum(s * x for s, x in zip(signs, w))) >= abs(total) - 1e-12 for signs in itertools.product((1, -1), repeat=len(w))) / 2 ** len(w)


def test_sign_flip(spark):
    cases = {"k1": [0.4], "k3": [1.0, 2.0, 3.0], "zero": [0.0, 0.0], "mixed": [1.0, -2.0, 0.5, 3.0, -1.5]}
    rows = [(k, i, x, 1) for k, ws in cases.items() for i, x in enumerate(ws)]
    rows += [("many", i, 1.0, 1) for i in range(20)]
    out = {r.k: r for r in statistics.sign_flip(spark.createDataFrame(rows, "k string, c int, w double, n long"), ["k"], "c").collect()}
    for k, ws in cases.items():
        assert out[k].p_value == pytest.approx(brute_p(ws)) and out[k].exact
    assert out["k1"].p_value == 1 and out["k3"].p_value == 0.25 and not out["many"].exact and 0 < out["many"].p_value < 0.01


def test_holm(spark):
    rows = [("a", 0.01), ("b", 0.04), ("c", 0.02), ("d", None), ("e", 0.9)]
    out = {r.n: r.rejected for r in statistics.holm(spark.createDataFrame(rows, "n string, p double"), "p", ["n"]).collect()}
    assert out == {"a": True, "c": False, "b": False, "e": False, "d": False}


def test_bootstrap_and_strata(spark):
    rng = np.random.default_rng(0)
    rows = [("k", f"c{i}", "g", float(x), 1) for i, x in enumerate(rng.normal(5, 1, 60))] + [("one", "c", "g", 3.0, 1)]
    out = {r.k: r for r in statistics.bootstrap(spark.createDataFrame(rows, "k string, cl string, g string, s double, n long"), ["k"], "cl", "g").collect()}
    assert out["k"].low < out["k"].mean < out["k"].high and 0.3 < out["k"].high - out["k"].low < 0.8 and out["one"].low is None and out["one"].mean == 3
    s = spark.createDataFrame([("x", "c1", "a"), ("x", "c2", "a"), ("x", "c3", "b"), ("y", "c1", "a"), ("y", "c2", "b")], "k string, cl string, st string")
    pools = {(r.k, r.cl): r.pool for r in statistics.collapsed_strata(s, ["k"], "st").collect()}
    assert pools["x", "c3"] == "a" and pools["y", "c1"] == pools["y", "c2"]


def test_bootstrap_in_parts_agrees_with_that_in_one_place(spark):
    rng = np.random.default_rng(5)
    rows = [(k, f"c{i}", f"g{i % 3}", f"p{i % 2}", float(x), 2) for k in ("a", "b") for i, x in enumerate(rng.normal(10, 2, 600) + 40 * np.array([i % 2 for i in range(600)]))]
    cells = spark.createDataFrame(rows, "k string, cl string, g string, st string, s double, n long")
    for stratum in ("st", None):
        one, parts, again = ({r.k: r for r in statistics.bootstrap(cells, ["k"], "cl", "g", stratum, held=h).collect()} for h in (4096, 50, 50))
        for k in ("a", "b"):
            assert parts[k].mean == pytest.approx(one[k].mean) and parts[k].n_clusters == one[k].n_clusters == 600
            assert (parts[k].high - parts[k].low) == pytest.approx(one[k].high - one[k].low, rel=0.1) and parts[k].low == pytest.approx(one[k].low, rel=0.03)
            assert again[k].low == pytest.approx(parts[k].low) and again[k].high == pytest.approx(parts[k].high)


def test_bootstrap_query_draws_documents_within_kinds(spark):
    from foliant.plans.queries import q_bootstrap

    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/ocr_results.parquet").filter("seconds is not null and doc_id is not null and category is not null")
    wanted = {r.candidate: r.n for r in rows.groupBy("candidate").agg(F.countDistinct("doc_id").alias("n")).collect()}
    assert {r.candidate: r.n_clusters for r in q_bootstrap(spark, d).collect()} == wanted


def test_scores(spark):
    df = spark.createDataFrame([(1, "a b c", "a b d"), (2, "", "x"), (3, "x", ""), (4, "**A** b", "a b"), (5, None, None)], "u int, r string, h string")
    out = {x.u: x for x in scoring.score(df, ["u"], "r", "h").collect()}
    assert (out[1].cer, out[1].wer, out[1].word_f1) == (0.2, 0.3333, 0.6667) and out[2].cer is None and out[3].cer == 1.0 and out[4].cer == 0.0 and out[5].ref_chars == 0
    swapped = {x.u: x.word_f1 for x in scoring.word_f1(df, ["u"], "h", "r").collect()}
    assert swapped[1] == 0.6667 and swapped[5] == 0.0
    pages = spark.createDataFrame([("d", p, f"Short title\nbody {p}\nmore\n{p}") for p in range(1, 5)] + [("e", 1, "Only once")], "doc string, p int, t string")
    assert {(r.doc, r.line, r.pages) for r in scoring.running_lines(pages, "doc", "p", "t").collect()} == {("d", "short title", 4), ("d", "more", 4)}


def test_plugins(spark):
    assert "hashed" in registry.available("embedder")
    embed = registry.create("embedder", "hashed", dims=8)
    v = spark.createDataFrame([("a b", 1), (None, 2)], "t string, i int").select(embed("t").alias("v")).collect()
    assert len(v[0].v) == 8 and sum(x * x for x in v[0].v) == pytest.approx(1) and set(v[1].v) == {0.0}
    with pytest.raises(NotConfigured):
        registry.create("reranker", "absent")
    with pytest.raises(NotConfigured):
        registry.create("embedder", "none")("x")


def test_salted_join(spark):
    from foliant.operators.joins import salted_left_join

    left = spark.createDataFrame([("hot", i) for i in range(100)] + [("b", 200), (None, 300), ("none", 400)], "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("b", 2)], "k string, v int")
    got = {r.i: r.v for r in salted_left_join(left, right, ["k"], F.col("i")).collect()}
    assert len(got) == 103 and got[5] == 1 and got[200] == 2 and got[300] is None and got[400] is None


def test_comparisons_have_difference_interval_and_p(spark):
    rng = np.random.default_rng(3)
    rows = [(c, f"u{i}", f"cl{i % 12}", f"g{i % 2}", float(rng.normal(5 + (c == "b"), 1))) for c in ("a", "b") for i in range(240)] + [("c", "u0", "cl0", "g0", 1.0), ("c", "u1", "cl1", "g1", None)]
    out = {(r.a, r.b): r for r in statistics.compare(spark.createDataFrame(rows, "n string, u string, cl string, g string, v double"), "n", "u", "v", "cl", "g").collect()}
    ab = out["a", "b"]
    assert ab.low < ab.diff < ab.high < 0 and ab.n == 240 and ab.n_clusters == 12 and ab.p_value < 0.05
    assert out["a", "c"].n == 1 and out["a", "c"].low is None


def test_joins_with_small_and_hot_sides_agree(spark):
    from foliant.operators.joins import semi_join, small_join, small_left_join

    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(900, None)], "id long, k string")
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("none", 3)], "k string, v int")
    for join, args in ((small_left_join, (["k"], F.col("id"))), (small_join, (["k"], F.col("id")))):
        assert sorted(map(tuple, join(left, right, *args).select("id", "v").collect()), key=str) == sorted(map(tuple, join(left, right, *args, most=1).select("id", "v").collect()), key=str)
    assert semi_join(left, right.select("k"), "k").count() == semi_join(left, right.select("k"), "k", 1).count() == 201


def test_pages_beside_their_truth(spark):
    from foliant.operators.evaluation import given_documents, suite_identity, truth_pages

    records = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y"), ("c", 1, "z")], "doc_id string, page int, text string")
    truth = spark.createDataFrame([("a", ["p", "q"]), ("b", ["r", "s"]), ("d", []), ("e", None)], "doc_id string, pages array<string>")
    assert {tuple(r) for r in truth_pages(records, truth).select("doc_id", "page", "truth", "complete").collect()} == {("a", 1, "p", True), ("a", 2, "q", True), ("b", 1, "r", False)}
    assert {r.doc_id: r.given for r in given_documents(records, truth).collect()} == {"a": True, "b": True, "c": False}
    rows = spark.createDataFrame([("s", "1"), ("s", "2"), ("s", "2"), ("t", "2")], "s string, x string")
    ids = {r.s: (r.samples, r.identity) for r in suite_identity(rows, "s", "x").collect()}
    assert ids["s"][0] == 2 and ids["t"][0] == 1 and ids["s"][1] != ids["t"][1]


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_shares_reached_in_groups_of_any_size(spark, ranges):
    from foliant.operators.ranking import reached_shares

    rng = np.random.default_rng(ranges)
    rows = [("hot", "x", i, float(rng.integers(0, 5))) for i in range(400)] + [("one", "x", i, 7.0) for i in range(150)] + [("hot", "y", i, float("nan") if i % 4 == 0 else float(rng.normal())) for i in range(90)]
    rows += [(f"g{i}", "x", i, 1.0) for i in range(40)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = {(r.a, r.b, r.i): r.p for r in reached_shares(spark.createDataFrame(rows, "a string, b string, i long, v double"), ["a", "b"], "v", "i", "p").collect()}
        more = reached_shares(spark.createDataFrame(rows, "a string, b string, i long, v double"), ["a", "b"], "v", "i", "p", 40_000_000)
        assert {(r.a, r.b, r.i): r.p for r in more.collect()} == got
        empty = reached_shares(spark.createDataFrame([], "a string, b string, i long, v double"), ["a", "b"], "v", "i", "p").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    groups = {}
    for a, b, i, v in rows:
        groups.setdefault((a, b), []).append(float("inf") if v != v else v)
    wanted = {(a, b, i): sum(w <= (float("inf") if v != v else v) for w in groups[a, b]) / len(groups[a, b]) for a, b, i, v in rows}
    assert empty == 0 and got.keys() == wanted.keys() and all(got[k] == pytest.approx(wanted[k]) for k in wanted)
