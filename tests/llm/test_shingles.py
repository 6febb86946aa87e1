"""Near-duplicates by shingles against brute-force Jaccard."""

import random

import pytest
from test_ops import fingerprint

import corpus_pipeline
from pyspark.sql import functions as F
from lodestone.llm import shingles as near
from lodestone.llm import simhash


def shingles(t, k=5):
    w = (t or "").encode().lower().split()
    return {tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))} if w else set()


def alike(a, b):
    return a == b or 9 * len(a & b) >= 4 * (len(a) + len(b))


def groups(rows):
    held = {i: shingles(t) for i, t in rows}
    root = {i: i for i in held}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in held:
        for b in held:
            if a < b and 4 * len(held[a]) <= 5 * len(held[b]) and 4 * len(held[b]) <= 5 * len(held[a]) and alike(held[a], held[b]) and (x := find(a)) != (y := find(b)):
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in held}


@pytest.fixture(scope="module")
def edited():
    """Copies of three texts with up to eight words changed, and texts that share a passage."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(5000)}"
    out = []
    for _ in range(3):
        base = [word() for _ in range(150)]
        for k in range(30):
            copy = list(base)
            for at in rng.sample(range(len(copy)), k % 9):
                copy[at] = word()
            out.append(" ".join(copy))
    passage = " ".join(word() for _ in range(60))
    out += [f"{passage} {' '.join(word() for _ in range(rng.randint(1, 60)))}" for _ in range(30)]
    rng.shuffle(out)
    return [(i + 1, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("emit", [8, 1])
def test_near_duplicates(spark, docs, rows, empty, edited, emit):
    frame = spark.createDataFrame(edited, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in near.near_duplicates(frame, emit=emit).collect()} == groups(edited)
    if emit == 8:
        assert {r.doc_id: r.component_id for r in near.near_duplicates(docs).collect()} == groups(rows)
        assert near.near_duplicates(empty).count() == 0


def test_small_sets_lose_no_link(spark, monkeypatch):
    """Texts of 1 to 17 words that begin or end otherwise, with the exact way alone."""
    rng = random.Random(5)
    texts = ["", "one", "one two"]
    for n in range(4, 18):
        for _ in range(4):
            base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            for begin in ([], ["a"], ["b"], ["a", "b"]):
                texts += [" ".join([*begin, *middle, *end]) for middle in (base, base[1:], base[:-1]) for end in ([], ["c"], ["d"], ["d", "e"])]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 1))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = near.sketches(frame, 5).groupBy("node").agg(F.min("doc_id").alias("first"), F.first("few").alias("few"))
    found = near.small_pairs(held, 80)
    first = {r.node: r["first"] for r in held.collect()}
    root = {i: i for i in first.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in near._one_by_one(near.whole_sets(frame, held, found, 5), found, 80).collect():
        x, y = find(first[r.a]), find(first[r.b])
        root[max(x, y)] = min(x, y)
    few = [i for i in root if len(shingles(texts[i - 1])) < 12]
    for a in few:
        for b in root:
            assert find(a) == find(b) or not alike(shingles(texts[a - 1]), shingles(texts[b - 1]))
    assert len({find(i) for i in few}) < len(few) / 2
    assert found.count() <= sum(r.n for r in held.select((F.size("few") + 78).alias("n")).where("n > 0").collect())
    assert {r.doc_id: r.component_id for r in near.near_duplicates(frame).collect()} == groups(rows)


def test_recall_on_whole_table(spark):
    """Every pair of 0.8 or more of sf0.01 is connected, and no other."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id: r.component_id for r in near.near_duplicates(docs).collect()} == groups(rows)


def test_stage_finds_copies_many_bits_apart(spark, edited):
    want = groups(edited)
    prints = {i: fingerprint(t, 5) for i, t in edited}
    assert any(want[a] == want[b] and alike(shingles(s), shingles(t)) and (prints[a] ^ prints[b]).bit_count() > 2 for a, s in edited for b, t in edited if a < b)
    frame = spark.createDataFrame(edited, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").collect()} == set(want.values())


def test_cells_and_pairs_agree(spark, edited):
    """Both ways of checking pairs, on all pairs."""
    frame = spark.createDataFrame(edited, "doc_id long, text string")
    marked = near.sketches(frame, 5).groupBy("node").agg(F.min("doc_id").alias("first"))
    nodes = sorted(r.node for r in marked.collect())
    found = spark.createDataFrame([(a, nodes[i + 1 :]) for i, a in enumerate(nodes[:-1])], "a long, held array<long>")
    whole = near.whole_sets(frame, marked, found, 5)
    pairs = {tuple(r) for r in near._one_by_one(whole, found, 80).collect()}
    assert pairs == {tuple(r) for r in near._in_cells(whole, found, 80).collect()} and len(pairs) > 50


def test_search_finds_all_within_a_distance(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(6)}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    for distance in (3, 5):
        links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), distance).collect()
        assert {tuple(r) for r in links} == {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance}
