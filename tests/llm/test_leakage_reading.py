import math
import random

import pytest

from foliant.llm.leakage import OUTER, bounds, find_leaks, leak_report, longest_stretch, words_of
from foliant.llm.reading import reading_features, reading_levels


def sentence(r, n):
    return " ".join("".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4))) for _ in range(n))


def test_words_without_markup():
    assert words_of('The <b>big</b> [house](https://a.b/c), 0.78 &amp; l\'eau') == ["the", "big", "house", "0", "78", "l", "eau"]


def test_stretch_allows_single_changes_only():
    item = list(range(1, 241, 4))  # words that are no numbers
    need, allowed, _ = bounds(60)
    changed = [0 if i % 10 == 5 else x for i, x in enumerate(item)]
    assert longest_stretch(item, [1001] * 7 + changed + [1005], [(0, 7)], need, allowed) == 60
    lost = [x for i, x in enumerate(item) if i % 12 != 6]
    assert longest_stretch(item, lost, [(0, 0)], need, allowed) == 60
    split = [y for i, x in enumerate(item) for y in ([1001, 1005] if i % 11 == 6 else [x])]
    assert longest_stretch(item, split, [(0, 0)], need, allowed) == 60
    pattern = [x if i % 4 else 0 for i, x in enumerate(item)]
    assert longest_stretch(item, pattern, [(1, 1)], need, allowed) == 0
    adjacent = [1001 if i % 12 in (5, 6) else x for i, x in enumerate(item)]
    assert longest_stretch(item, adjacent, [(0, 0)], need, allowed) == 0
    number = [x | 2 if i % 24 in (5, 6) else x for i, x in enumerate(item)]
    other = [1003 if i % 24 in (5, 6) else x for i, x in enumerate(item)]
    assert longest_stretch(number, other, [(0, 0)], need, allowed) == 60


def test_bounds_leave_a_shingle_however_the_changes_lie():
    for n in range(9, 260):
        need, changes, survive = bounds(n)
        assert survive >= 1 and changes <= need // 6
        # changes as far apart as they can be spoil the most
        for first in range(6):
            spoiled = {p - o for c in range(changes) for p in [first + c * max(1, need // max(1, changes))] for o in OUTER}
            assert len([p for p in range(need - 4) if p not in spoiled]) >= survive
    assert [bounds(n) for n in (1, 4, 8)] == [(1, 0, 1), (2, 0, 1), (4, 0, 1)]


def test_passages_with_changes_wherever_they_lie_are_found(spark):
    r = random.Random(9)
    own = sentence(r, 48).split()
    every_fifth = [w if (i + 1) % 5 else "xx" for i, w in enumerate(own[:24])]
    near_end = own[:20] + ["xx"] + own[21:24]
    one_short = own[:23]
    doubled = [y for i, w in enumerate(own[:24]) for y in ([w, w] if i % 6 == 3 else [w])]
    lost = [w for i, w in enumerate(own[:24]) if i % 6 != 3]
    cases = [every_fifth, near_end, doubled, lost, one_short, own[:10] + sentence(r, 30).split() + own[10:30]]
    docs = [(i, " ".join(sentence(r, 40).split() + c + sentence(r, 40).split())) for i, c in enumerate(cases)]
    items = [(1, " ".join(own)), (2, "alpha beta gamma delta"), (3, "Omega!"), (4, " ".join(own).upper() + ".")]
    docs += [(10, "x beta, gamma y"), (11, "so beta x gamma"), (12, "this omega that")]
    found = {(x.doc_id, x.item_id) for x in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(d, i) for d in (0, 1, 2, 3) for i in (1, 4)} | {(10, 2), (12, 3)}


def leak_case():
    r = random.Random(5)
    items = [(i, sentence(r, r.randint(45, 110))) for i in range(40)]
    items += [(100, items[0][1].upper()), (101, "too short"), (102, None), (103, "")]
    docs, wanted = [], set()
    for d in range(200):
        words = sentence(r, 150).split()
        if d % 4 == 0:
            i, text = items[d // 4 % 40]
            own = text.split()
            share = r.choice([0.3, 0.4, 0.6, 0.8, 1.0])
            n = int(len(own) * share)
            at = r.randint(0, len(own) - n)
            part = own[at : at + n]
            part = [w if k % 11 != 6 else r.choice(["", w + " " + w, "zzz"]) for k, w in enumerate(part)]
            words[70:70] = [f"**{w}**," if k % 9 == 0 and w else w for k, w in enumerate(part)]
            if share > 0.5:
                wanted.add((d, i))
                if i == 0:
                    wanted.add((d, 100))
        docs.append((d, " ".join(words)))
    docs += [(900, None), (901, ""), (902, "w " * 100_000), (None, items[0][1]), (903, items[5][1]), (904, items[5][1])]
    return items, docs, wanted | {(903, 5), (904, 5)}


@pytest.mark.parametrize(("broadcast", "block"), [(500_000, 2_000_000), (3, 500)])
def test_planted_passages_are_found(spark, with_clashes, monkeypatch, broadcast, block):
    items, docs, wanted = leak_case()
    d = with_clashes(spark.createDataFrame(docs, "doc_id long, text string"))
    e = with_clashes(spark.createDataFrame(items, "item_id long, text string"))
    monkeypatch.setattr("foliant.llm.leakage.BROADCAST_ROWS", broadcast)
    leaks = find_leaks(d, e, block=block)
    assert {(r.doc_id, r.item_id) for r in leaks.collect()} == wanted
    report = {r.item_id: r.documents for r in leak_report(leaks, e).collect()}
    assert report[5] == sum(i == 5 for _, i in wanted) and report[101] == 0


def test_leaks_of_empty_tables(spark):
    d, e = (spark.createDataFrame([], s) for s in ("doc_id long, text string", "item_id long, text string"))
    assert find_leaks(d, e).count() == 0
    assert find_leaks(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), e).count() == 0
    assert find_leaks(d, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_levels_agree_with_labels_held_out(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/reading_labels.parquet").filter("level is not null")
    taught, held = labels.filter("label_id % 3 != 0"), labels.filter("label_id % 3 = 0")
    seen = taught.select("doc_id").distinct()
    judged = held.join(seen, "doc_id", "left_anti").join(reading_levels(docs, taught).select("doc_id", "level").withColumnRenamed("level", "got"), "doc_id").toPandas()
    assert len(judged) > 150 and (judged.level == judged.got).mean() > 0.84 and ((judged.level - judged.got).abs() <= 1).all()


def test_reading_with_awkward_rows(spark, with_clashes):
    easy, hard = "The cat sat on the mat. It was warm. " * 12, "Heterogeneous epistemological considerations notwithstanding, the aforementioned methodological incommensurability, " * 12 + "."
    rows = [(i, easy if i % 2 else hard, "en") for i in range(40)] + [(100, None, "en"), (101, "", None), (102, "12 34 " * 60, "en"), (103, easy, None), (104, "x " * 70_000, "xx"), (105, "few words", "en"), (105, easy, "en"), (None, easy, "en")]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    labels = with_clashes(spark.createDataFrame([(i, i, 1 if i % 2 else 4) for i in range(20)] + [(90, 0, None), (91, None, 2), (92, 5, 4)], "label_id long, doc_id long, level int"), but=("level",))
    got = {r.doc_id: r.level for r in reading_levels(docs, labels).collect()}
    assert all(got[i] == (1 if i % 2 else 4) for i in range(40)) and got[103] == 1 and got[105] == 1 and 104 in got
    assert not {100, 101, 102, None} & set(got)
    none = labels.filter("false")
    assert {r.level for r in reading_levels(docs, none).collect()} == {None}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert reading_levels(empty, labels).count() == 0 and reading_features(empty).count() == 0


def test_ranks_of_words_that_are_not_sent(spark):
    r = random.Random(2)
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ["n", "rt", "st", "x"]]
    texts = [(i, " ".join(r.choice(words[: 20 + 2 * (i % 60)]) for _ in range(100 + i)) + ".", "en" if i % 3 else "fr") for i in range(90)] + [(900, "zzz qqq " * 60, "en"), (901, "ban dan " * 60, "xx")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    counts: dict = {}
    for _, t, g in texts:
        for w in t.replace(".", "").split():
            counts.setdefault(g, {}).setdefault(w, 0)
            counts[g][w] += 1
    whole = {x.doc_id: x for x in reading_features(docs).collect()}
    few = {x.doc_id: x for x in reading_features(docs, vocabulary=60).collect()}
    none = {x.doc_id: x for x in reading_features(docs, vocabulary=0).collect()}
    assert whole.keys() == few.keys() == none.keys() and all(whole[k].lang == few[k].lang for k in whole)
    for k, t, g in texts:
        ws = t.replace(".", "").split()
        place = sorted(sum(n >= counts[g][w] for n in counts[g].values()) for w in ws)
        for share, name in ((0.8, "rank_80"), (0.95, "rank_95")):
            wanted = math.log(place[min(len(ws) - 1, int(len(ws) * share))])
            assert none[k][name] == pytest.approx(wanted)
            assert few[k][name] == pytest.approx(wanted, abs=0.5) and whole[k][name] <= wanted + 1e-9
