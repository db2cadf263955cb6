"""Every operator on the awkward rows: nulls in any column, empty and very long texts, repeated rows and ids, clashing columns, empty tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from inkwell.llm import decontaminate, licenses, lines, mixing, near, neighbours, pii, quality, repeats, tokens

LONG = " ".join(f"word{i % 997} of line {i}" for i in range(250_000))  # over 5 MB in one line
COMMON = "a line that stands on very many sites"
ROWS = [
    (1, f"{COMMON}\nfirst body of text one two three four five six seven", "s1"), (2, f"{COMMON}\nother body here", "s2"), (3, COMMON, "s3"), (4, COMMON, "s4"), (5, COMMON, "s5"), (6, COMMON, None), (None, COMMON, "s6"), (None, None, None),
    (9, "unique beta text must stay", "s1"), (9, f"{COMMON}\nsame id, other text", "s2"), (9, f"{COMMON}\nsame id, other text", "s2"), (10, "", "s1"), (11, None, "s1"), (12, "   ", ""), (13, "\n\n", "s1"), (14, LONG, "s7"), (15, LONG, "s7"),
]
CLASHES = ("lines_removed", "kept_text", "entities", "score", "overlaps", "licenses", "n_words", "row", "key", "doc", "mark", "gone", "body", "mix_key", "mix_copies", "mix_copy", "id", "rate", "copies", "copy", "m1", "m2", "every", "mine", "w", "at", "has", "__pii")


@pytest.fixture(scope="module")
def documents(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    for name in CLASHES:
        frame = frame.withColumn(name, F.lit("given"))
    return frame.repartition(3)


def kept(out, documents, new):
    """Columns of the input that no new one replaces are there, once, with their values."""
    assert len(set(out.columns)) == len(out.columns)
    left = [c for c in CLASHES if c not in new]
    assert all(r[c] == "given" for r in out.select(*left).collect() for c in left)
    assert sorted(map(str, out.select("doc_id", "source").collect())) == sorted(map(str, documents.select("doc_id", "source").collect()))


def test_lines(documents):
    out = lines.with_lines(documents)
    kept(out, documents, ("lines_removed", "kept_text"))
    got = {(r["doc_id"], r["text"]): (r["lines_removed"], r["kept_text"]) for r in out.collect()}
    # the smallest id stays, and a null id is smaller than any other
    assert got[None, COMMON] == ([], COMMON) and got[3, COMMON] == ([0], "") and got[9, "unique beta text must stay"] == ([], "unique beta text must stay")
    assert got[9, f"{COMMON}\nsame id, other text"] == ([0], "same id, other text") and got[14, LONG] == ([], LONG) and got[11, None] == ([], None) and got[13, "\n\n"] == ([], "\n\n")


def test_near(spark, documents):
    out = near.classes(documents).collect()
    assert len(out) == len(ROWS)
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out if r["doc_id"] not in (None, 9)}
    assert by[14] == by[15] and by[15][1] == 14 and by[4] == (4, 3) and by[10] == (0, 10) and by[11] == (0, 11) and by[12] == (0, 12)
    assert sorted((r["n_shingles"], r["component_id"]) for r in out if r["doc_id"] is None) == [(0, None), (4, None)]


def test_tokens(documents):
    out = tokens.token_counts(documents).collect()
    assert len(out) == len(ROWS) and {r["n_tokens"] for r in out if r["doc_id"] in (10, 11)} == {0}
    assert len({(r["n_bytes"], r["n_tokens"]) for r in out if r["doc_id"] in (14, 15)}) == 1


def test_licenses(documents):
    out = licenses.with_licenses(documents)
    kept(out, documents, ("licenses", "n_words"))
    assert {r["n_words"] for r in out.where("doc_id IN (10, 11, 12, 13)").collect()} == {0}


def test_mixing(documents):
    settings = mixing.Settings(weights={None: 1.0, "": 1.0, "s1": 2.0}, size=20.0)
    rate = {r["source_key"]: r["rate"] for r in mixing.rates(documents, settings).collect()}
    assert rate[None] > 0 and rate[""] > 0 and rate["s2"] == 0 and rate[None] != rate[""]
    out = mixing.mixed(documents, settings)
    rows = out.collect()
    assert {r["source"] for r in rows} <= {None, "", "s1"} and all(r["row"] == r["id"] == "given" for r in rows)
    # rows without an id draw by their texts
    assert len({r["mix_key"] for r in rows if r["doc_id"] is None and r["mix_copy"] == 0}) == len({r["text"] for r in rows if r["doc_id"] is None})


def test_pii(documents):
    out = pii.with_surrogates(documents, pii.Settings("k"))
    kept(out, documents, ("entities",))
    assert {hashlib.md5((r["text"] or "").encode()).hexdigest() for r in out.where("doc_id IN (9, 10, 11)").collect()} == {hashlib.md5((t or "").encode()).hexdigest() for i, t, _ in ROWS if i in (9, 10, 11)}


def test_quality(spark, documents):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in (1, 2, 3, 4, 5, 9, 14)] + [(2, 7, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(documents, labels, quality.Settings(epochs=2))
    out = quality.with_score(documents, model)
    kept(out, documents, ("score",))
    scores = out.select("text", "score").collect()
    assert all(0 <= r["score"] <= 1 for r in scores) and len({r["score"] for r in scores if r["text"] == COMMON}) == 1


def test_labels_are_bounded(spark):
    """A labelled id that very many rows repeat is one row of the sample, and the smallest text holds."""
    documents = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text")).union(spark.createDataFrame([(8, "other one")], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(documents, labels, quality.Settings(epochs=1))
    again = quality.train(documents.repartition(7), labels, quality.Settings(epochs=1))
    assert (model.w == again.w).all() if model.w is not None else model.constant == again.constant


def test_repeats(documents):
    out = repeats.removed(documents).collect()
    assert len(out) == len(ROWS)
    sizes = {r["doc_id"]: (r["n_bytes"], len(r["kept"])) for r in out if r["doc_id"] in (14, 15)}
    assert sizes[15] == (len(LONG), 0) and 0 < sizes[14][1] <= len(LONG)


def test_decontaminate(spark, documents):
    items = spark.createDataFrame([(1, "first body of text one two three four five six seven"), (2, None), (None, "x y z")], "item_id long, text string")
    for settings in (decontaminate.Settings(), decontaminate.Settings(block_items=1)):
        out = decontaminate.with_overlaps(documents, items, settings)
        kept(out, documents, ("overlaps",))
        assert {r["doc_id"] for r in out.where(F.size("overlaps") > 0).collect()} == {1}


def test_empty(spark, documents):
    none = documents.where("false")
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (
        lines.with_lines(none), near.classes(none), tokens.token_counts(none), licenses.with_licenses(none), mixing.mixed(none), pii.with_surrogates(none, pii.Settings("k")), repeats.removed(none), decontaminate.with_overlaps(none, items),
    ):
        assert out.count() == 0
    vectors = neighbours.usable(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert neighbours.search(vectors, vectors).count() == 0
