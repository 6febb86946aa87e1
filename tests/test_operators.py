"""Golden cases and properties of the core operators."""

import random
from datetime import datetime, timezone

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunks, events, fusion, graph, merges, search, vectors
from lodestone.operators import windows as W
from lodestone.plans import research


TRACKERS = ("utm_medium=mail", "UTM_Term=b", "gclid=9", "fbclid=z", "ref_src=n")


@pytest.mark.parametrize("host", ["docs.lantern.test", "a-b.example.net:8443", "127.0.0.1:9000", "localhost"])
def test_web_urls_lose_trackers_and_order(spark, host):
    rng = random.Random(host)
    local = host.startswith(("127.", "localhost"))
    for scheme in ("http", "HTTPS"):
        kept = {f"p{i}": f"p{i}={i}" for i in rng.sample(range(9), 3)}
        query = [*kept.values(), *rng.sample(TRACKERS, 2)]
        rng.shuffle(query)
        raw = f"  {scheme}://{host.upper()}/one//./two/../three/?{'&'.join(query)}#part "
        want = f"{scheme.lower() if local else 'https'}://{host}/one/three?{'&'.join(kept[k] for k in sorted(kept))}"
        u = spark.createDataFrame([(raw,)], "raw string").select(T.normalised_url(F.col("raw")).alias("u")).first().u
        assert (u.url, u.kind) == (want, "web")


def test_kinds_of_links(spark):
    cases = {
        "https://m.youtube.com/watch?v=Qq&start=7": ("https://youtube.com/watch?v=Qq", "youtube"),
        "https://files.lantern.test/report.PDF": ("https://files.lantern.test/report.PDF", "pdf"),
        "http://www.github.com/lamp/wick/blob/main/a.py": ("https://github.com/lamp/wick", "github"),
        "https://mobile.twitter.com/i/article/77?lang=en": ("https://x.com/i/article/77?lang=en", "x_article"),
        "https://t.co/Zz9": None,
        "https://x.com/lamp": None,
        "mailto:lamp@lantern.test": None,
        "not a link": None,
        None: None,
    }
    rows = spark.createDataFrame([(i, raw) for i, raw in enumerate(cases)], "i int, raw string").select("i", T.normalised_url(F.col("raw")).alias("u")).orderBy("i").collect()
    assert [(r.u.url, r.u.kind) if r.u else None for r in rows] == list(cases.values())


def test_chunks_cover_and_fit():
    rng = random.Random(5)
    for _ in range(100):
        text = "".join(rng.choice("abcd  .é\n") for _ in range(rng.randint(0, 700)))
        found = chunks.windows(text, 80, 120, 90)
        assert "".join(text[a:b] for a, b in found) == text
        assert all(b - a <= 120 and len(text[a:b].encode()) <= 90 for a, b in found)


def test_an_edit_moves_few_chunks():
    rng = random.Random(9)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(6000))
    edited = text[:15000] + "changed " + text[15000:]
    before = {text[a:b] for a, b in chunks.windows(text)}
    after = {edited[a:b] for a, b in chunks.windows(edited)}
    assert len(before - after) <= 3


def test_fused_ranks(spark):
    lane = lambda *keys: spark.createDataFrame([(k, i + 1) for i, k in enumerate(keys)], "k string, rank int")
    got = fusion.reciprocal_rank({"lexical": (lane("a", "b"), 1.0), "semantic": (lane("a", "c"), 1.0)}, "k").collect()
    assert [r.k for r in got] == ["a", "b", "c"]
    assert got[0].score == pytest.approx(2 / 61)


def test_nearest_in_blocks_of_queries(spark):
    rng = random.Random(8)
    held = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    rows = spark.createDataFrame(held, "id long, v array<double>").repartition(3)
    probe = rows.where("id % 5 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    want = {(q, i) for q, v in held if q % 5 == 0 for _, i in sorted((1 - sum(a * b for a, b in zip(v, w)), i) for i, w in held)[:3]}
    assert {(r.query_id, r.id) for r in vectors.nearest(rows, probe, "id", "v", 3, block=2).collect()} == want
    assert vectors.distances(rows, probe, ["id"], "v", block=5).count() == 12 * 60
    assert vectors.nearest(rows, probe.limit(0), "id", "v", 3).count() == 0


def test_capped_nearest_leaves_tasks_few(spark):
    """The best five with two of a group at most, equal vectors and a null group among them; tasks give away five rows for each query."""
    rng = random.Random(3)
    held = [(i, None if i % 7 == 0 else i % 3 if i < 300 else i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(600)]
    rows = spark.createDataFrame(held, "id long, label int, v array<float>").repartition(3)
    probe = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    want = []
    for q, _, v in held[::50]:
        taken = {}
        near = sorted((1 - sum(a * b for a, b in zip(v, w)), i, g) for i, g, w in held)
        best = [x for x in near if taken.setdefault(x[2], []).append(1) or len(taken[x[2]]) <= 2][:5]
        want += [(q, i, g, d) for d, i, g in best]
    got = vectors.nearest_capped(rows, probe, "id", "label", "v", 2, 5, block=5)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert vectors.nearest_capped(rows, probe.limit(0), "id", "label", "v", 2, 5).count() == 0
    for first in (2, 256):
        left = vectors._nearest_capped(rows, probe.collect(), "id", "label", "v", 2, 5, first=first)
        assert left.count() <= 3 * 5 * 12


def test_signals_are_the_greedy_choice(spark):
    """Many long phrases inside one another come before the short ones of fewer rows."""
    long = " ".join(f"word{i:03d}" for i in range(40))
    held = [(i, long) for i in range(3)] + [(i, f"other{i % 2} thing") for i in range(10, 14)]
    got = graph.signal_clusters(spark.createDataFrame(held, "k long, t string"), "k", F.col("t"), limit=41)
    found = {r.phrase: r.n for r in got.collect()}
    assert found["thing"] == 4 and found["other0 thing"] == 2
    plain = [p for p in found if p.startswith("word")]
    assert len(plain) == 38 and all(len(p.split()) == 3 for p in plain)


def test_links_of_classes(spark):
    left = [(1, "a"), (1, "b"), (2, "b"), (2, "a"), (3, "c"), (4, "z"), (4, "z")]
    right = [(10, "a"), (10, "b"), (11, "b"), (12, "c"), (13, "c"), (13, "q")]
    frame = lambda rows, k: spark.createDataFrame(rows, f"{k} long, t string")
    got = {tuple(r) for r in graph.linked_classes(frame(left, "left_key"), frame(right, "right_key"), "t").collect()}
    assert got == {(1, 1, 2, 3), (2, 1, 2, 3), (3, 3, 2, 2), (4, 4, 0, 0)}


def test_vector_ties_go_by_key(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in (5, 3, 9)] + [(1, [0.0, 1.0])], "id long, v array<float>")
    probe = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<float>")
    assert [r.id for r in vectors.nearest(rows, probe, "id", "v", 3).orderBy("distance", "id").collect()] == [3, 5, 9]


def test_compaction_leaves_one_percent_alone(spark):
    rows = spark.createDataFrame([("a", 1, 99, 1), ("b", 2, 6000, 0), ("c", 3, 7000, 0)], "segment string, created int, live int, dead int")
    assert sorted((r.segment, r.action) for r in vectors.compaction_plan(rows).collect()) == [("b", "merge"), ("c", "merge")]


def test_pages_have_no_gaps(spark):
    rng = random.Random(2)
    rows = [("2024-01-01", rng.choice("ab"), i) for i in range(40)]
    log = spark.createDataFrame(rows, "at string, entity string, id long")
    keys, cursor, seen = ["at", "entity", "id"], None, []
    while page := [tuple(r) for r in events.page(log, keys, cursor, 7).collect()]:
        seen += page
        cursor = list(page[-1])
    assert seen == sorted(rows)


def test_cursor_and_since():
    now = datetime(2024, 3, 1, tzinfo=timezone.utc)
    assert events.decode_cursor(events.encode_cursor(["é", 1])) == ["é", 1]
    assert events.since("7d", now).day == 23
    assert events.since("2024-02-01T00:00:00Z", now).month == 2
    assert [events.bucket_hours(h) for h in (12, 24, 72, 168, 169)] == [1, 2, 6, 12, 24]


def test_upsert_keeps_enrichment(spark):
    schema = "k int, h string, s string"
    current = spark.createDataFrame([(1, "x", "old"), (2, "y", "old"), (3, "z", "old")], schema)
    batch = spark.createDataFrame([(1, "x", "new"), (2, "w", ""), (4, "n", "new")], schema)
    got = {r.k: (r.s, r.action) for r in merges.upsert(current, batch, "k", "h", ["s"]).collect()}
    assert got == {1: ("old", "unchanged"), 2: ("old", "updated"), 3: ("old", "kept"), 4: ("new", "created")}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, text string, at timestamp")
    assert search.scored(empty, "id", "text", ["a"]).count() == 0
    assert search.cascade(empty, "id", "text", "some words", "at").count() == 0
    assert chunks.chunked(empty, "id", "text").count() == 0
    assert W.merged_ranges(empty.select("id", F.lit(1).alias("a"), F.lit(2).alias("b")), "id", "a", "b").count() == 0
    assert graph.link_candidates(empty.select("id", F.split("text", " ").alias("urls")), "id", "urls").count() == 0


def test_questions():
    assert research.terms_of("What is licensed under the thing that is not open?") == ["licensed", "under", "thing", "that"]
    assert research.variants("red ring")[0] == ["red", "ring"]


@given(st.text(alphabet="ab", min_size=1, max_size=6), st.text(alphabet="ab", min_size=1, max_size=6))
def test_query_terms_are_unique(a, b):
    found = search.query_terms(f"{a} {b} {a}!")
    assert found == list(dict.fromkeys([a, b]))


def test_pages_by_tag(spark):
    df = spark.createDataFrame([("a, b,,a\nc",), ("",)], "csv string")
    assert [r.t for r in df.select(T.tags(F.col("csv")).alias("t")).collect()] == [["a", "b", "c"], []]
    assert [r.t for r in df.select(T.compact(F.lit("a  b\nc" * 10), 12).alias("t")).collect()][0] == "a b ca b..."


def test_incidents(spark, tmp_path):
    from lodestone.streaming import events as S

    rows = [(1, 7, "2024-01-01 00:00:00", "error"), (2, 7, "2024-01-01 01:00:00", "error"), (3, 7, "2024-01-02 02:00:00", "error"), (4, 7, "2024-01-02 03:00:00", "purchase"), (5, 7, "2024-01-02 04:00:00", "error"), (6, 8, "2024-01-01 00:00:00", "view")]
    spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "e"))
    got = S.drained(S.incidents(S.stream_of(spark, str(tmp_path / "e"))), "append").orderBy("at").collect()
    assert [(r.change, r.errors) for r in got] == [("opened", 1), ("reminder", 3), ("recovered", 3), ("opened", 4)]


def test_query_windows_of_all_texts(spark, tmp_path):
    from lodestone.queries import QUERIES

    texts = [(1, "x " * 200 + "under it"), (2, "one Token"), (3, "licensed"), (4, "none"), (5, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.window for r in QUERIES["query_windows"](spark, str(tmp_path)).collect()}
    assert "under it" in got.pop(1) and got == {2: "one Token", 3: "licensed", 4: "", 5: ""}


def test_latest_in_group_gathers_no_list(spark):
    from lodestone.operators import evidence
    from lodestone.queries import QUERIES

    rows = [(1, "2024-01-02T00:00:00Z"), (1, "2024-01-03T01:00:00+02:00"), (1, "odd"), (2, "a"), (2, "b"), (3, None)]
    df = spark.createDataFrame(rows, "k long, t string").groupBy("k")
    got = {r.k: (r.x, r.y) for r in df.agg(evidence.latest_in_group(F.col("t")).alias("x"), evidence.latest_time(F.collect_list("t")).alias("y")).collect()}
    assert got == {1: ("2024-01-02T23:00:00Z",) * 2, 2: ("b", "b"), 3: ("", "")}
    assert "collect_list" not in QUERIES["latest_evidence"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_words_of_a_text_are_taken_once(spark):
    """The index and its statistics come from one scan that takes the words of each text once, and equal the whole index."""
    from lodestone.operators import search

    docs = spark.createDataFrame([(1, "Three blew three. able"), (2, "thread"), (3, None), (4, "")], "id long, t string")
    held = search.tokenised(docs, "id", "t", ["thre", "ble"])
    assert sorted((r.id, r.n_tokens, r.words) for r in held.where("id <> 3").collect()) == [(1, 4, ["three", "blew", "three"]), (2, 1, ["thread"]), (4, 0, [])]
    assert held.count() == 4
    whole = search.postings(docs, "id", "t")
    assert sorted(map(tuple, search.posted(held, "id").collect())) == sorted(map(tuple, whole.where("term like 'thre%' or term like 'ble%'").collect()))
    assert whole._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_sample_of_few_strata_is_cut_before_they_meet(spark):
    """Of one large stratum the tasks give away a bounded number of rows, and the sample is that of a plain sort."""
    import hashlib

    rows = spark.range(20_000).select("id", F.when(F.col("id") % 1000 == 0, "b").when(F.col("id") % 1000 == 1, "c").otherwise("a").alias("s"))
    got = W.stratified_sample(rows, "s", "id", "x", {"a": 30, "b": 50, "d": 5, "c": 0})
    key = lambda i: (hashlib.sha256(f"x{i}".encode()).hexdigest(), i)
    want = {(i, "a") for i in sorted((i for i in range(20_000) if i % 1000 > 1), key=key)[:30]} | {(i, "b") for i in range(0, 20_000, 1000)}
    assert {tuple(r) for r in got.collect()} == want
    assert "Partial" in got._jdf.queryExecution().executedPlan().toString()  # a limit in each group before the shuffle
