import random
from collections import defaultdict

import pytest

from foliant.llm.capping import cap_contributors, capped_hits, dropped_hits, kept_hits
from foliant.llm.leximin import leximin_ranking

HITS = "hit_id long, question_id long, retriever string, chunk_id long, doc_id string, score double"


def hits(seed=0, n=600):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        doc = "hot" if r.random() < 0.4 else r.choice(["a", "b", "c", "d", None])
        rows.append((i, r.choice([1, 1, 1, 2, 3, None]), r.choice(["dense", "keyword", "rerank", None]), r.choice([*range(60), None]), doc, r.choice([None, 1.0, 2.0, r.random(), float("nan")])))
    return rows


def first_rows(rows):
    once = {}
    for h in sorted(rows, key=lambda x: x[0]):
        once.setdefault((h[1], h[2], h[3]), h)
    return list(once.values())


def score_key(h):
    s = h[5]
    return (0 if s is not None else 1, 0 if s is not None and s != s else 1, -(s if s is not None and s == s else 0), h[0])


def brute_cap(rows, level_of):
    by = defaultdict(list)
    for h in first_rows(rows):
        by[(h[1], h[2]), h[4]].append(h)
    return {h[0] for (g, _), hs in by.items() for h in sorted(hs, key=score_key)[: level_of[g]]}


@pytest.mark.parametrize("count", [1, 4])
def test_cap_by_count_equals_brute_force(spark, with_clashes, count):
    rows = hits()
    out = capped_hits(with_clashes(spark.createDataFrame(rows, HITS)), count).collect()
    assert {r.hit_id for r in out if r.kept} == brute_cap(rows, defaultdict(lambda: count))
    assert len(out) == len(first_rows(rows))
    df = with_clashes(spark.createDataFrame(rows, HITS))
    kept = {r.hit_id: r.quality_rank for r in kept_hits(df, count).collect()}
    assert kept == {r.hit_id: r.quality_rank for r in out if r.kept}
    assert sorted(r.hit_id for r in dropped_hits(df, count).collect()) == sorted(r.hit_id for r in out if not r.kept)


@pytest.mark.parametrize("share", [0.2, 0.34, 0.6])
def test_share_levels_equal_brute_force(spark, share):
    rows = hits(1)
    sizes = defaultdict(lambda: defaultdict(int))
    for h in first_rows(rows):
        sizes[h[1], h[2]][h[4]] += 1
    levels = {}
    for g, c in sizes.items():
        fits = [x for x in range(1, max(c.values()) + 1) if x <= share * sum(min(x, v) for v in c.values()) + 1e-9]
        levels[g] = max(fits, default=1)
    out = capped_hits(spark.createDataFrame(rows, HITS), None, share).filter("kept").collect()
    assert {r.hit_id for r in out} == brute_cap(rows, levels)
    assert all(r.level == levels[r.question_id, r.retriever] for r in out)


def test_cap_of_empty_table_and_without_groups(spark):
    assert capped_hits(spark.createDataFrame([], HITS)).count() == 0
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "a", 2.0), (4, "b", None)], "id int, who string, s double")
    out = cap_contributors(df, [], "who", "s", "id", max_count=1).filter("kept").collect()
    assert {r.id for r in out} == {2, 4}


def brute_leximin(rows, top):
    best = defaultdict(dict)
    for h in rows:
        if h[1] is None or h[2] is None or h[3] is None:
            continue
        s = h[5]
        if s is not None and s != s:
            s = float("inf")
        old = best[h[1], h[2]].get(h[3], None)
        best[h[1], h[2]][h[3]] = s if old is None else old if s is None else max(old, s)
    out = {}
    for q, k in top.items():
        items = {c for (g, _), l in best.items() if g == q for c in l}
        v = {}
        for c in items:
            p = []
            for r in ("dense", "keyword", "rerank"):
                scored = [x for x in best[q, r].values() if x is not None]
                s = best[q, r].get(c)
                p.append(sum(x <= s for x in scored) / len(scored) if s is not None else 0.0)
            v[c] = sorted(p)
        out[q] = sorted(items, key=lambda c: ([-x for x in v[c]], c))[: k or 0]
    return {(q, c) for q, cs in out.items() for c in cs}


def test_leximin_equals_brute_force(spark, with_clashes):
    rows, top = hits(2, 500), {1: 7, 2: 3, 3: None, 9: 4}
    asked = spark.createDataFrame([*top.items(), (1, 2)], "question_id long, top_k int")
    out = leximin_ranking(with_clashes(spark.createDataFrame(rows, HITS)), asked).collect()
    assert {(r.question_id, r.chunk_id) for r in out} == brute_leximin(rows, top)


def test_leximin_keeps_its_order_under_rescaling(spark):
    rows = [h for h in hits(3) if h[5] is None or h[5] == h[5]]
    scaled = [(*h[:5], None if h[5] is None else h[5] * (1000 if h[2] == "dense" else 0.01) - 5) for h in rows]
    asked = spark.createDataFrame([(1, 5), (2, 5)], "question_id long, top_k int")
    a, b = (leximin_ranking(spark.createDataFrame(x, HITS), asked).select("question_id", "chunk_id", "rank").collect() for x in (rows, scaled))
    assert set(a) == set(b)


def test_leximin_of_empty_tables(spark):
    e = spark.createDataFrame([], HITS)
    assert leximin_ranking(e, spark.createDataFrame([(1, 5)], "question_id long, top_k int")).count() == 0
    assert leximin_ranking(spark.createDataFrame(hits(), HITS), spark.createDataFrame([], "question_id long, top_k int")).count() == 0
