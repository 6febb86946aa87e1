"""Families and variants of questions, lanes of many questions in one scan, checks of cases."""

import pytest

from lodestone.operators import search
from lodestone.plans import families as Q
from lodestone.plans import research
from lodestone.plans.terms import terms_of

CASES = [
    ("Where is src:ab-12/x. in the list", "exact_title_source_lookup", ["src:ab-12/x list", "src:ab-12/x"]),
    ("Which title has tulips", "exact_title_source_lookup", ["title has tulips"]),
    ("tulips not roses", "corrective_followup", ["tulips"]),
    ("Which father killed kids", "person_news_event_lookup", ["father killed kids", "father kill children", "father charged killing children", "man charged killing children", "father son daughter"]),
    ("children in a vehicle, killed and charged", "person_news_event_lookup", ["children vehicle killed charged", "children vehicle kill charge", "children found vehicle", "vehicle kill charge"]),
    ("the video of tulips", "media_transcript_ocr_lookup", ["video tulips", "transcript tulips", "ocr tulips"]),
    ("latest tulips", "timeline_history", ["latest tulips", "latest tulips timeline", "latest tulips history"]),
    ("tulips vs roses", "comparison", ["tulips vs roses", "tulips vs roses alternatives", "tulips vs roses replacement"]),
    ("which models for an agent", "model_tool_selection", ["models agent", "model agent", "llm model stack agent", "qwen gpt agent", "model stack agent"]),
    ("a library for tulips", "software_project_lookup", ["library tulips", "github library tulips", "library tulips documentation"]),
    ("tulips", "entity_topic_overview", ["tulips"]),
    ("red green blue black white", "entity_topic_overview", ["red green blue black white", "red green blue", "green blue black", "blue black white"]),
]


@pytest.mark.parametrize(("question", "family", "queries"), CASES)
def test_families(question, family, queries):
    terms = terms_of(question)
    assert Q.family_of(question, terms, Q.concepts_of(terms)) == family
    got = Q.variants(question)
    assert got[: len(queries)] == queries or [q for q in queries if q in got] == queries
    assert len(got) <= Q.MOST_VARIANTS and len({q.casefold() for q in got}) == len(got)


def test_concepts_shape_the_searches():
    concepts = [Q.Concept("knowledge"), Q.Concept("base"), Q.Concept("knowledge_base", "knowledge base"), Q.Concept("show", role="intent", required=False), Q.Concept("r_lang", "r lang")]
    assert Q.subject(concepts) == "knowledge base r lang"
    assert '"r-lang"' in Q.variants("knowledge base", concepts)
    assert Q.subject([Q.Concept("show", role="intent")]) == "show"
    assert Q.named_keys("see http://h/x:not-a-key and (yt:abc).") == ["yt:abc"]
    assert Q.variants("") == [""] and Q.variants("Red RED red")[0] == "red"


TEXTS = ["red ring of gold", "red red ring", "gold gold", "a ring", "", None, "redder rings"]


def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_lanes_are_the_queries_one_by_one(spark):
    df, lanes = frame(spark), {"a": ["red", "ring"], "b": ["gold"], "c": ["zzz"], "d": [], "e": ["ring", "ring"]}
    got = [(r.lane, r.doc_id, round(r.score, 9), r["rank"]) for r in search.ranked_lanes(df, "doc_id", "text", lanes, 2).collect()]
    want = []
    for name, terms in lanes.items():
        one = search.scored(df, "doc_id", "text", list(dict.fromkeys(terms))) if terms else None
        rows = [] if one is None else sorted((r for r in one.collect() if all(r.tf)), key=lambda r: (-r.score, r.doc_id))[:2]
        want += [(name, r.doc_id, round(r.score, 9), i) for i, r in enumerate(rows, 1)]
    assert sorted(got) == sorted(want)


def test_checks(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/d")
    df = spark.read.parquet(f"{tmp_path}/d")
    cases = [
        {"id": 1, "question": "red ring", "expected": [0, 1], "top": 1},
        {"id": 2, "question": "red ring", "expected": [3]},
        {"id": 3, "question": "gold", "forbidden": [0]},
        {"id": 4, "question": "zzz", "forbidden": [0]},
        {"id": 5, "question": "zzz", "top": 0},
    ]
    got = {r.id: r for r in research.checked(df, "doc_id", "text", cases).collect()}
    assert {i: r.passes for i, r in got.items()} == {"1": True, "2": False, "3": False, "4": True, "5": False}
    assert got["2"].missing == [3] and got["3"].forbidden == [0] and got["5"].hits == []
    many = [{"id": i, "question": q} for i, q in enumerate(["red ring", "gold", "a ring"] * 17)]
    plan = research.checked(df, "doc_id", "text", many)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2  # the rows, and the row of statistics
    with pytest.raises(ValueError):
        research.checked(df, "doc_id", "text", cases[:1] * 2)
