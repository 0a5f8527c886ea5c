import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm.packing import container_report, pack, pack_texts, token_sizes
from foliant.llm.splitting import cut, page_extents, range_table, split_chunks, split_files, split_texts

WORDS = "alpha beta. Gamma, delta; epsilon\n zeta! Eta\n\ntheta iota kappa? Lambda: mu".split(" ")


def make_text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice([*WORDS, "x" * r.randint(1, 300)]) for _ in range(n))


def assert_pieces(text, pieces, limit, overlap):
    at = 0
    for i, (s, e, t) in enumerate(pieces):
        assert t == text[s:e] and 0 < len(t) <= limit
        assert s <= at and (i == 0 or at - s <= overlap) and e > at
        at = e
    assert at == len(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n!é𝔸", max_size=400), st.integers(20, 80), st.integers(0, 6))
def test_cut_covers_everything_within_the_limit(text, limit, overlap):
    _, positions, classes = range_table(text, 0, len(text))
    if len(text) > limit:
        assert_pieces(text, [(s, e, text[s:e]) for s, e in cut(0, len(text), positions, classes, limit, overlap)], limit, overlap)


def test_cut_prefers_strong_boundaries():
    text = "One sentence here. " * 3 + "\n\n" + "Another sentence there. " * 4
    _, p, c = range_table(text, 0, len(text))
    s, e = cut(0, len(text), p, c, 100, 10)[0]
    assert text[:e].endswith("\n\n")


@pytest.mark.parametrize("range_chars", [65536, 200])
def test_split_texts(spark, with_clashes, range_chars):
    rows = [(1, make_text(1, 400)), (2, "y" * 5000), (3, None), (4, ""), (5, "short"), (6, "é" * 200), (7, "é" * 201), (8, make_text(8, 20_000)), (9, make_text(1, 400))]
    out = split_texts(with_clashes(spark.createDataFrame(rows, "id int, text string")), "id", "text", 200, 20, range_chars).collect()
    texts = dict(rows)
    assert {r.id for r in out} == {1, 2, 7, 8, 9}
    for k in (1, 2, 7, 8, 9):
        own = sorted((r for r in out if r.id == k), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert_pieces(texts[k], [(r.start, r.end, r.text) for r in own], 200, 20)
    assert split_texts(spark.createDataFrame([], "id int, text string"), "id", "text", 200, 20).count() == 0


def test_split_files_by_byte_ranges(spark, tmp_path):
    texts = [make_text(3, 3000) + "ü𝔸" * 900, "", "tiny"]
    paths = []
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.txt").write_bytes(t.encode())
        paths.append(str(tmp_path / f"{i}.txt"))
    out = split_files(spark, paths, 300, 30, range_bytes=1000).collect()
    own = sorted((r for r in out if r.path == paths[0]), key=lambda r: r.piece)
    assert_pieces(texts[0], [(r.start, r.end, r.text) for r in own], 300, 30)
    assert [r.text for r in out if r.path == paths[2]] == ["tiny"] and not [r for r in out if r.path == paths[1]]


def test_pages_of_pieces(spark):
    segments = spark.createDataFrame([(1, "d", 0, "a" * 998), (2, "d", 1, "b" * 1498), (3, "d", 1, "dup"), (4, "d", 2, None), (5, None, 0, "x"), (6, "d", None, "x")], "segment_id long, doc_id string, seg_index int, text string")
    assert [(r.page, r.page_start, r.page_end) for r in page_extents(segments).orderBy("page").collect()] == [(1, 0, 1000), (2, 1000, 2500), (3, 2500, 2502)]
    joined = "a" * 998 + "\n\n" + "b" * 1498 + "\n\n\n\n"
    chunks = spark.createDataFrame([(7, "d", joined[100:2400], 100, 9, 9), (8, "gone", "z" * 1000, 0, 3, 4), (9, "gone", "z" * 1000, 0, None, None), (10, "d", "short", 0, 1, 1)], "chunk_id long, doc_id string, text string, start long, first_page int, last_page int")
    out = split_chunks(chunks, segments).collect()
    for r in out:
        if r.chunk_id == 7:
            assert joined[r.start : r.start + len(r.text)] == r.text
            assert (r.first_page, r.last_page) == (1 if r.start < 1000 else 2, 1 if r.start + len(r.text) - 1 < 1000 else 2)
        elif r.chunk_id == 8:
            assert 3 <= r.first_page <= r.last_page <= 4
        else:
            assert r.chunk_id == 9 and r.first_page is None


def sized(n, seed=0, hot=0.4):
    r = random.Random(seed)
    return [(i, "hot" if r.random() < hot else r.choice("abcde"), r.choice([0, 1, r.randint(1, 60), r.randint(1, 250)])) for i in range(n)]


@pytest.mark.parametrize("parts", [100_000, 150])
def test_pack_is_valid_and_full(spark, parts):
    rows = sized(900)
    out = pack(spark.createDataFrame(rows, "id long, source string, tokens long"), "id", 100, None, parts).toPandas()
    assert out.groupby("container").tokens.sum().max() <= 100
    assert out.groupby("id").tokens.sum().to_dict() == {i: t for i, _, t in rows}
    whole = out[out.tokens < 100].groupby("id").container.nunique()
    assert whole.max() == 1
    assert out[["container", "place"]].duplicated().sum() == 0
    for _, g in out[out.n_pieces > 1].groupby("id"):
        assert sorted(g.piece) == list(range(g.n_pieces.iloc[0])) and (g[g.piece < g.n_pieces - 1].tokens == 100).all()
    assert out.tokens.sum() / (100 * out.container.nunique()) > 0.97


def test_pack_holds_the_mixture(spark):
    rows = [(i, "a" if i % 2 else "b", 5) for i in range(4000)]
    out = pack(spark.createDataFrame(rows, "id long, source string, tokens long"), "id", 100, None, 500).toPandas()
    share = out[out.source == "a"].groupby("container").tokens.sum().reindex(out.container.unique()).fillna(0) / out.groupby("container").tokens.sum()
    assert ((share - 0.5).abs() < 0.11).mean() > 0.8  # the others pay what a source was owed when their partition began
    one = pack(spark.createDataFrame(rows, "id long, source string, tokens long"), "id", 100, None, 5000).toPandas()
    own = one[one.source == "a"].groupby("container").tokens.sum().reindex(one.container.unique()).fillna(0)
    assert ((own - 50).abs() <= 5).all()


def test_pack_texts_with_awkward_rows(spark, with_clashes):
    rows = [(1, None, "s"), (2, "", "s"), (3, "a few words", None), (4, "word " * 9000, "t"), (5, "a few words", "s")]
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string, source string"), but=("source",))
    out = pack_texts(df, tokenizer=None).toPandas()
    assert set(out.doc_id) == {1, 2, 3, 4, 5} and out.groupby("container").tokens.sum().max() <= 4096
    assert out[out.doc_id == 4].tokens.sum() == 45_000 and out[out.doc_id == 1].tokens.sum() == 0
    assert pack_texts(spark.createDataFrame([], "doc_id long, text string, source string"), tokenizer=None).count() == 0
    assert container_report(pack_texts(df, tokenizer=None)).agg({"items": "sum"}).first()[0] == len(out)


def test_token_counts_by_public_tokenizers(spark):
    df = spark.createDataFrame([(1, "The quick brown fox", "s"), (2, "<|endoftext|>", "s")], "id int, text string, source string")
    from foliant.llm.tokens import DIR

    for name, counts in (("byte_bpe_50k.tiktoken", {1: 4, 2: 7}), ("byte_bpe_50k.json", {1: 4, 2: 7}), (None, {1: 19, 2: 13})):
        got = token_sizes(df, "id", "text", "source", name and f"{DIR}/{name}").collect()
        assert {r.id: r.tokens for r in got} == counts
