"""Problems 4 and 6."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import splitting, tokens

AWKWARD = ["", "a's!'s x", "  　 日本語 abc  \n\n x'reqJ", "~'s !'S", "<|endoftext|> hi", " " * 500 + "a", "\t\t\n \r\n a  b", "qJxZ kQ’s 漢字かな    x", "x" * 3000, "👩‍🔬 é é ﬁ   ", "IT'S they'll 31926178072813684"]


@pytest.fixture(scope="module")
def encoder():
    return tokens.encoder(tokens.vocabulary_path())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=("Cs",))), max_size=4))
def test_fragments_encode_like_the_whole(texts):
    own = tokens.encoder(tokens.vocabulary_path())
    offsets, flat = own.encode_batch(texts + AWKWARD)
    for i, text in enumerate(texts + AWKWARD):
        assert list(flat[offsets[i] : offsets[i + 1]]) == own.whole.encode_ordinary(text)


def test_equal_to_the_other_library(encoder):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(tokens.vocabulary_path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    offsets, flat = encoder.encode_batch(AWKWARD)
    assert [list(flat[offsets[i] : offsets[i + 1]]) for i in range(len(AWKWARD))] == [x.ids for x in other.encode_batch(AWKWARD, add_special_tokens=False)]


def test_encode_frame(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "hello world", None), (3, "hello world", "z"), (None, "a", "")], "doc_id long, text string, ids string")
    out = sorted(((r.doc_id or 0, r.ids) for r in tokens.encode(rows).collect()), key=str)
    assert [x for x in out if x[0] in (1, 2)] == [(1, []), (2, [])] and len(out) == 5
    assert tokens.encode(rows.where("false")).count() == 0
    counted = {r.doc_id: r.tokens for r in tokens.count_tokens(rows.select("doc_id", "text")).collect()}
    assert counted[1] == 0 and counted[3] == 2


def test_memory_of_fragments_may_be_emptied(encoder, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    offsets, flat = encoder.encode_batch(["one two three four five six one two"])
    assert list(flat) == encoder.whole.encode_ordinary("one two three four five six one two")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=90), st.integers(1, 12), st.floats(0, 0.4))
def test_cuts_cover_all_words_within_the_limit(strength, limit, ratio):
    import numpy as np

    ranges = splitting.cut_points(np.array(strength), limit, round(limit * ratio))
    assert ranges[0][0] == 0 and ranges[-1][1] == len(strength)
    assert all(0 < b - a <= limit for a, b in ranges)
    assert all(a2 <= b1 and a2 > a1 for (a1, b1), (a2, _) in zip(ranges, ranges[1:]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=40), st.data())
def test_range_maximum_is_rightmost(values, data):
    import numpy as np

    low = data.draw(st.integers(0, len(values) - 1))
    high = data.draw(st.integers(low, len(values) - 1))
    best = splitting.RangeMaximum(np.array(values)).best(low, high)
    assert best == max(range(low, high + 1), key=lambda i: (values[i], i))


def test_cuts_at_the_paragraph():
    text = "a b c d e f\n\ng h i j k l"
    pieces = splitting.split_text(text, 8, 0.13)
    assert pieces[0][0] == "a b c d e f" and pieces[1][0] == "f\n\ng h i j k l"


def test_split_oversized_edge_cases(spark):
    rows = [("a", "w " * 30, 10, 0.1, 2, 4), ("b", None, 10, 0.1, 1, 1), ("c", "", 10, 0.1, None, None), ("d", "x y", None, None, 1, 1), ("e", "w " * 11, 10, None, 1, 1), ("f", "w " * 5, 0, 0.5, 1, 1)]
    items = spark.createDataFrame(rows, "item_id string, text string, max_words int, overlap_ratio double, page_start int, page_end int")
    out = {}
    for r in splitting.split_oversized(items).collect():
        out.setdefault(r.item_id, []).append(r)
    assert {k: len(v) for k, v in out.items()} == {"a": 4, "b": 1, "c": 1, "d": 1, "e": 2, "f": 1}
    assert all(r.token_count <= 10 for r in out["a"]) and {r.page for r in out["a"]} <= {2, 3, 4}
    assert (out["b"][0].text, out["b"][0].token_count, out["c"][0].text) == (None, 0, "")
    assert splitting.split_oversized(items.where("false")).count() == 0


def test_oversized_and_pieces_of_tables(spark):
    documents = spark.createDataFrame([("d1", "notes", "x"), ("d2", None, "x")], "document_id string, doc_kind string, text string")
    parents = spark.createDataFrame([("p1", "d1", 1, 2, "w " * 9), ("p1", "d1", 1, 2, "w " * 9), ("p2", "d1", 3, 3, "w")], "parent_id string, document_id string, page_start int, page_end int, text string")
    chunks = spark.createDataFrame([("c1", "d2", 0, 1, "w w w w w"), ("c2", "d2", 1, 1, None), ("c3", None, 2, 1, "w w w w w")], "chunk_id string, document_id string, chunk_index int, page int, text string")
    limits = spark.createDataFrame([("notes", 4, 8, 0.2)], "doc_kind string, child_tokens int, parent_tokens int, overlap_ratio double")
    assert sorted(map(tuple, splitting.oversized_items(parents, chunks, documents, limits).collect())) == [("chunk_parents", "p1"), ("chunks", "c1"), ("chunks", "c3")]
    rows = splitting.split_all(parents, chunks, documents, limits).collect()
    own = sorted((r.chunk_index, r.item_id, r.piece_no) for r in rows if r.document_id == "d1")
    assert own == [(0, "p1", 0), (1, "p1", 1), (2, "p2", 0)]
    assert all(r.token_count <= (8 if r.item_table == "chunk_parents" else 4) for r in rows)
