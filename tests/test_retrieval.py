"""Rules of evidence on small tables: nulls, empties, ties, repeats."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import evidence as E
from lodestone.operators import retrieval as R
from lodestone.operators import search


def test_a_term_counts_in_its_first_field(spark):
    rows = spark.createDataFrame([(1, "red ring", "ring", None), (2, None, "ring", "a red ring"), (3, None, None, None)], "k int, title string, tags string, body string")
    fields = {"title": F.col("title"), "tags": F.col("tags"), "full_text": F.col("body")}
    score = R.field_score(fields, ["red", "ring"], F.lit(False), F.lit(True), "red ring", F.lit(0))
    assert dict(rows.select("k", score).collect()) == {1: 12 + 12 + 15 + 12, 2: 4 + 10 + 12, 3: 0}
    three = R.field_score(fields, ["red", "ring", "gold"], F.lit(True), F.lit(True), "which repo", F.lit(9))
    assert dict(rows.select("k", three).collect())[3] == 1 + 2 + 9 - 24


@pytest.mark.parametrize("text, term, found", [("a go.", "go", True), ("ago go", "go", True), ("gopher", "go", False), ("c++", "c++", True), ("xc++", "c++", False), ("the gopher", "e go", True), ("", "go", False), ("a", " ", False)])
def test_words_have_bounds(spark, text, term, found):
    assert spark.createDataFrame([(text,)], "t string").select(R.has_word(F.col("t"), term)).first()[0] is found


def test_boosts_need_two_terms_of_several(spark):
    entities = spark.createDataFrame([("a", "Red Ring", 1, ["red ring"]), ("b", "Red", 9, ["red"]), ("c", "Ring of red", 0, ["ring of red"])], "key string, name string, refs int, candidates array<string>")
    refs = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("c", 2)], "key string, ref int")
    found = R.entity_boosts(entities, refs, "", ["red", "ring"], E.text_score, 5)
    assert {r.ref: (r.boost, r.entities) for r in found.collect()} == {1: (16, ["Red Ring", "Ring of red"]), 2: (8, ["Ring of red"])}
    assert {r.ref for r in R.entity_boosts(entities, refs, "", ["red", "ring"], E.text_score, 1).collect()} == {1}
    assert R.expanded(found, spark.createDataFrame([(1,), (1,)], "key int")).select("ref").collect() == [(2,)]


def test_sections_keep_the_first_of_equal_texts(spark):
    rows = spark.createDataFrame([(1, " a ", "a", "b"), (2, None, "", " ")], "k int, x string, y string, z string")
    found = R.sections(rows, ["k"], {n: F.col(n) for n in "xyz"}).collect()
    assert [tuple(r) for r in found] == [(1, 0, "x", "a"), (1, 1, "z", "b")]
    assert [r[0] for r in rows.select(R.index_text(F.col("x"), F.col("y"), F.col("z"))).collect()] == ["a\n\na\n\nb", ""]


def test_related_results_keep_their_share(spark):
    rows = spark.createDataFrame([(i, i >= 6, i) for i in range(9)] + [(0, True, 0)], "key int, is_related boolean, at int")
    found = R.primary_and_related(rows, 4, 2, [F.asc("at")]).collect()
    assert [tuple(r) for r in found] == [(0, "primary"), (1, "primary"), (6, "related"), (7, "related")]
    assert R.primary_and_related(rows.limit(0), 4, 2, [F.asc("at")]).count() == 0


def test_due_work_without_media(spark):
    row = spark.createDataFrame([(None, "", "", "")], "kinds array<string>, text string, status string, done string")
    assert row.select(R.transcription_due(*map(F.col, row.columns), "2024"), R.ocr_due(F.col("kinds"), F.col("status"))).first() == (False, False)


def test_authors_without_names_give_none(spark):
    rows = spark.createDataFrame([("Ann", "Ann A"), ("ann", None), (None, "Bo  B."), (" ", None)], "h string, n string")
    found = {r.entity_key: (r.name, r.refs) for r in R.author_entities(rows, "h", "n").collect()}
    assert found == {"author:ann": ("Ann A", 2), "author:name:bo-b": ("Bo  B.", 1)}


def test_search_without_terms_finds_nothing(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "red ring", 0)], "k int, t string, at int")
    assert search.scored(docs, "k", "t", []).count() == 0
    assert search.scored(docs, "k", "t", ["re"]).select("k").collect() == [(3,)]
    assert [(r.k, r.stage) for r in search.cascade(docs, "k", "t", "3", "at").collect()] == [(3, 1)]
    assert [(r.k, r.stage) for r in search.cascade(docs, "k", "t", "ed ri", "at").collect()] == [(3, 3)]
