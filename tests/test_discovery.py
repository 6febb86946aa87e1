"""Link discovery: a plain version, running twice, stops in the middle."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import discovery

A, B, C = "https://a.example/x", "http://www.b.example/y?utm_source=q", "https://b.example/y"
ITEMS = [(1, [A, B, None, "mailto:x"]), (2, [C, A, A + "#f"]), (3, None), (4, []), (None, [A]), (5, ["https://t.co/s"])]
SCHEMA = "id long, links array<string>, version string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def state(spark, root):
    return {n: sorted(map(tuple, discovery.read(spark, root, n).collect()), key=repr) for n in ("sources", "edges", "marks")}


def test_steps(spark, tmp_path):
    root = f"file://{tmp_path}"
    first = discovery.discover(frame(spark, ITEMS[:1]), "id", "links", root).first()
    assert tuple(first) == (1, 2, 2, 2)
    then = discovery.discover(frame(spark, ITEMS), "id", "links", root).first()
    assert tuple(then) == (4, 2, 0, 2)
    got = state(spark, root)
    assert {(r[1], r[4], r[5], r[6]) for r in got["sources"]} == {("https://a.example/x", 1, A, 1), ("https://b.example/y", 1, B, 1)}
    assert {(r[0], r[2], r[4]) for r in got["edges"]} == {(1, A, 1), (1, B, 1), (2, C, 2), (2, A, 2)}
    assert sorted(r[0] for r in got["marks"]) == [1, 2, 3, 4, 5]
    assert tuple(discovery.discover(frame(spark, ITEMS), "id", "links", root).first()) == (0, 0, 0, 0)
    assert state(spark, root) == got and discovery.version(spark, root) == 2
    forced = discovery.discover(frame(spark, ITEMS), "id", "links", root, force=True).first()
    assert tuple(forced) == (5, 4, 0, 0)
    assert {n: len(v) for n, v in state(spark, root).items()} == {n: len(v) for n, v in got.items()}


def test_changed_links_are_read_again(spark, tmp_path):
    root = f"file://{tmp_path}"
    discovery.discover(frame(spark, ITEMS[:2]), "id", "links", root)
    grown = [(1, [A, "https://new.example/z"]), ITEMS[1]]
    assert tuple(discovery.discover(frame(spark, grown), "id", "links", root).first()) == (1, 2, 1, 1)


@pytest.mark.parametrize("stop_at", ["edges", "manifests"])
def test_a_stop_in_the_middle_changes_nothing(spark, tmp_path, monkeypatch, stop_at):
    root, twin = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    for at in (root, twin):
        discovery.discover(frame(spark, ITEMS[:1]), "id", "links", at)
    before = state(spark, root)
    from pyspark.sql.readwriter import DataFrameWriter

    whole = DataFrameWriter.parquet

    def stops(self, path, *rest, **more):
        if f"/{stop_at}/version=2" in path:
            raise RuntimeError("stopped")
        return whole(self, path, *rest, **more)

    with monkeypatch.context() as patch:
        patch.setattr(DataFrameWriter, "parquet", stops)
        with pytest.raises(RuntimeError):
            discovery.discover(frame(spark, ITEMS), "id", "links", root)
    assert state(spark, root) == before and discovery.version(spark, root) == 1
    for at in (root, twin):
        discovery.discover(frame(spark, ITEMS), "id", "links", at)
    assert state(spark, root) == state(spark, twin)


def test_limits_and_nothing(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert tuple(discovery.discover(frame(spark, []), "id", "links", root).first()) == (0, 0, 0, 0)
    assert discovery.version(spark, root) == 0 and discovery.read(spark, root, "edges").count() == 0
    items = frame(spark, ITEMS)
    while discovery.discover(items, "id", "links", root, upto_items=2).first()["items"]:
        pass
    assert discovery.read(spark, root, "marks").select(F.count_distinct("item")).first()[0] == 5
    assert discovery.version(spark, root) == 3
