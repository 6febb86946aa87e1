"""The projection by watermark: stops, raises, late and equal revisions, against a plain version."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.streaming import projection

SCHEMA = "parent long, revision long, text string"


def cut(rows):
    return rows.select("parent", "revision", F.posexplode(F.split("text", " ")).alias("ordinal", "piece"))


def log(spark, path, files):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(f"{path}/f{i}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{path}/*")


def changes(seed, files=4, size=12):
    rng = random.Random(seed)
    row = lambda: (rng.randint(0, 9), rng.randint(1, 9), rng.choice([None, "a b", f"x{rng.randint(0, 99)} y z"]))
    return [[row() for _ in range(size)] for _ in range(files)]


def plainly(files, upto):
    """Newest change of each parent up to the watermark; of equal revisions that which came in an earlier batch, else the greatest text."""
    done, later = {}, {}
    for rows in files:
        newest = {}
        for p, r, t in rows:
            if r <= upto:
                newest[p] = max(newest.get(p, (0, "")), (r, t or ""))
            else:
                later[p] = max(later.get(p, 0), r)
        for p, (r, t) in newest.items():
            if p not in done or done[p][0] < r:
                done[p] = (r, t)
    return done, later


def state(held):
    pieces = {}
    for r in held.chunks().collect():
        pieces.setdefault((r.parent, r.revision), []).append((r.ordinal, r.piece))
    done = {r.parent: (r.revision, " ".join(x for _, x in sorted(pieces.pop((r.parent, r.revision), [])))) for r in held.projected().collect()}
    assert not pieces
    return done, {r.parent: r.revision for r in held.dirty().collect()}


def opened(spark, root):
    return projection.Projection(spark, root, spark.createDataFrame([], SCHEMA).schema, cut)


def test_up_to_a_watermark_and_on(spark, tmp_path):
    files = changes(1)
    held, stream = opened(spark, f"file://{tmp_path}/p"), log(spark, f"file://{tmp_path}/log", files)
    held.run(stream, 5)
    assert state(held) == plainly(files, 5)
    held.run(stream, 5)
    assert state(held) == plainly(files, 5)
    held.run(stream, 7)
    done, later = plainly(files, 7)
    assert {p: r for p, (r, _) in state(held)[0].items()} == {p: r for p, (r, _) in done.items()} and state(held)[1] == later
    held.run(stream, 99)
    done, later = state(held)
    assert not later and {p: r for p, (r, _) in done.items()} == {p: max(r for f in files for q, r, _ in f if q == p) for p in {q for f in files for q, _, _ in f}}


@pytest.mark.parametrize("stop", ["chunks/step=000000000001", "steps/step=000000000002"])
def test_a_stop_between_or_inside_batches(spark, tmp_path, monkeypatch, stop):
    """A run that stops and is started again ends as one run does; changes that came meanwhile are kept."""
    from pyspark.sql.readwriter import DataFrameWriter

    files = changes(2)
    stream = log(spark, f"file://{tmp_path}/log", files)
    held, whole = opened(spark, f"file://{tmp_path}/p"), DataFrameWriter.parquet

    def stops(self, path, *rest, **more):
        if path.endswith(stop):
            raise RuntimeError("stopped")
        return whole(self, path, *rest, **more)

    with monkeypatch.context() as patch:
        patch.setattr(DataFrameWriter, "parquet", stops)
        with pytest.raises(Exception):  # noqa: B017  the stream wraps it
            held.run(stream, 6)
    reached = len(projection.steps(spark, f"file://{tmp_path}/p"))
    assert 0 < reached < 4 and state(held) == plainly(files[:reached], 6)
    more = [[(3, 6, "raised meanwhile"), (4, 9, "beyond")]]
    spark.createDataFrame(more[0], SCHEMA).coalesce(1).write.json(f"file://{tmp_path}/log/f9")
    opened(spark, f"file://{tmp_path}/p").run(stream, 6)
    got, want = state(held), plainly(files + more, 6)
    assert got[1] == want[1] and {p: r for p, (r, _) in got[0].items()} == {p: r for p, (r, _) in want[0].items()}


def test_nothing(spark, tmp_path):
    held, stream = opened(spark, f"file://{tmp_path}/p"), log(spark, f"file://{tmp_path}/log", [[(None, 1, "x"), (1, None, "y")]])
    assert state(held) == ({}, {})
    held.run(stream, 5)
    assert state(held) == ({}, {})


def test_waiting_changes_are_written_once(spark, tmp_path):
    """What waits for a watermark is not written again by each batch, nor what a raise leaves waiting; a lower watermark takes nothing back."""
    files = [[(10 * n + i, 2 + i % 3, f"t{n} {i}") for i in range(6)] for n in range(4)]
    held, stream = opened(spark, f"file://{tmp_path}/p"), log(spark, f"file://{tmp_path}/log", files)
    held.run(stream, 1)
    held.run(stream, 2)
    assert spark.read.schema(SCHEMA).parquet(f"file://{tmp_path}/p/later").count() == 24
    assert state(held) == plainly(files, 2)
    held.run(stream, 1)
    held.run(stream, 3)
    assert state(held) == plainly(files, 3)
