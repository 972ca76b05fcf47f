"""Inputs on which an operator once was wrong."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from stationwatch.llm import chat, html_extract, mixing, near_dup, suffix_dedup


def _thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate({97: 98, 98: 97})
    return word


@pytest.mark.parametrize("n", [512, 1024, 2048])
def test_words_of_one_polynomial_are_two_words(spark, n):
    """Sums of codes times powers modulo 2**64 are equal for the Thue-Morse word and its complement."""
    word = _thue_morse(n)
    other = word.translate({97: 98, 98: 97})
    rest = " ".join(f"w{i}" for i in range(3))
    docs = spark.createDataFrame([(1, word), (2, other), (3, f"{word} {rest} end"), (4, f"{other} {rest} end")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


@pytest.mark.parametrize(("before", "behind", "gram"), [("7Z", '"-', "thdrlfdybwknxliv"), ("&W", '"4', "thmiiguimbybexpn"), (")\\", "$8", "dzqyhnieqosyrlid")])
def test_runs_of_one_polynomial_stay(spark, before, behind, gram):
    """Sums of codes times powers modulo 2**64 are equal for these two texts without a common string of 400 bytes; both once were removed whole."""
    word = _thue_morse(256)
    one, other = (f"{w.translate(str.maketrans('ab', before))}{gram}{w.translate(str.maketrans('ab', behind))}" for w in (word, word.translate({97: 98, 98: 97})))
    docs = spark.createDataFrame([(1, one), (2, other), (3, f"{other} again")], "doc_id long, text string")
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.digest(suffix_dedup.remove_repeats(docs)).collect()}
    assert found == {1: (528, 0, 0), 2: (528, 528, 1), 3: (534, 528, 1)}


@pytest.mark.parametrize(("one", "other"), [
    ("kkhofckgoihdbgkfj+o?LZ27ikclenjiolnjnnbnegapnhbo:yZvm)f6jkhcjdhb", "kkhofckgoihdbgkfN^6ZtEjgikclenjiolnjnnbnegapnhbo:yZvOJ&zjkhcjdhb"),
    ("ojihpnikbanbfhen0@Pu|lnBkeiafbapboonlfjfcednlooi:A$Ff})diojekebn", "ojihpnikbanbfhen`miU%F$bkeiafbapboonlfjfcednlooi:A$F>#*)iojekebn"),
])
def test_texts_of_one_xxhash_keep_their_own_spans(spark, one, other):
    """Two heads with the same xxhash64 under most seeds, before one tail; only the first one's head stands elsewhere."""
    tail = " ".join(f"word{i * i}" for i in range(60))
    docs = spark.createDataFrame([(1, one + tail), (2, other + tail), (3, f"{one}{tail[:400]} and more")], "doc_id long, text string")
    assert docs.selectExpr("xxhash64(text) AS a", "xxhash64(7, text) AS b").distinct().count() == 2
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.digest(suffix_dedup.remove_repeats(docs)).collect()}
    size = 64 + len(tail)
    assert found == {1: (size, size, 1), 2: (size, 8 + len(tail), 1), 3: (473, 464, 1)}  # the heads share their last 8 bytes


@pytest.mark.parametrize(("page", "blocks"), [
    ('<p>seen</p><script src="x"/>var tracker = 1;</script><p>too', ["seen", "too"]),
    ("<p>seen</p><script src=http://x/>var tracker = 1;</script ><p>too", ["seen", "too"]),
    ("<p>a <svg><g><svg><text>chart</text></svg><text>chart label</text></g></svg> b</p>", ["a b"]),
    ("<p>a <svg/> b</p><p>c", ["a b", "c"]),
    ("<p>The formula <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> is as known.</p>", ["The formula x=1 is as known."]),
    ("<p>left open <math><mi>x</mi><p>next</p>", ["left open x", "next"]),
    ("<select><option>1<select></select>2</select><p>seen", ["seen"]),
])
def test_silent_elements_end_where_they_should(page, blocks):
    assert [b[0] for b in html_extract.leaf_blocks(page)] == blocks


def test_a_slash_closes_no_article():
    assert all("<article" in b[1] for b in html_extract.leaf_blocks("<article class=x/><p>one</p><p>two</p></article>"))


def test_large_and_negative_turns_keep_their_order(spark):
    turns = [1700000000009, 1700000000001, -5, -1, None, 0, 3, -(1 << 63) + 1, (1 << 63) - 1, 10**12]
    df = spark.createDataFrame([(1, t, "user", f"{t}") for t in turns], "conv_id long, turn long, role string, text string")
    found = chat.link(df).collect()
    assert len({r.place for r in found}) == len(turns)
    assert [r.turn for r in sorted(found, key=lambda r: r.place)] == sorted(turns, key=lambda t: (t is not None, t or 0))


def test_own_columns_with_inner_names_come_back(spark):
    names = ("t1", "t2", "spans", "row", "_row", "_source", "_chars", "_draw", "_piece", "_slots", "_before")
    rows = [(i, f"text {i}", "s", *(f"{c}{i}" for c in names)) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names))
    for found in (mixing.mix_sources(docs), suffix_dedup.remove_repeats(docs)):
        assert sorted(map(tuple, found.select(*docs.columns).collect())) == rows


def test_pipeline_stage_with_a_column_of_an_inner_name(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([(1, "one two three four five six", 3), (1, "other words are here as well", 2)], "doc_id long, text string, _nth long")
    assert corpus_pipeline.remove_near_duplicates(spark, docs, "").select("_nth").count() == 1


def test_block_comparison_takes_little_memory_beside_its_sets():
    """Near copies in two blocks: the links are right, and arrays made on the way stay under three times the sets (five times before)."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 6000, dtype=np.uint64)
    sets = []
    for i in range(240):
        s = base.copy()
        s[rng.choice(len(s), 100 if i % 3 else 2000, replace=False)] = rng.integers(0, 1 << 63, 100 if i % 3 else 2000, dtype=np.uint64)
        sets.append(np.unique(s))
    group = pa.table({
        "rep": pa.array(range(240), pa.int64()), "component": pa.array([i % 5 for i in range(240)], pa.int64()), "mine": pa.array([i % 2 for i in range(240)], pa.int32()),
        "low": pa.array([0] * 240, pa.int32()), "high": pa.array([1] * 240, pa.int32()), "sig": pa.array([near_dup.signature(base).tobytes()] * 240, pa.binary()),
        "hashes": pa.chunked_array([pa.array([s.tobytes() for s in sets[:100]], pa.binary()).slice(0, 60), pa.array([s.tobytes() for s in sets], pa.binary()).slice(60)]),
    })
    tracemalloc.start()
    try:
        found = near_dup._compare_blocks(group)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 3 * sum(s.nbytes for s in sets)
    assert {x for r in found.to_pylist() for x in r.values()} == {i for i in range(240) if i % 3} and set(found.column("b").to_pylist()) == {1}
