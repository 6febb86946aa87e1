"""The pipeline against its stages done plainly, and the registered queries of this package."""

from test_ops import benchmark_hits, ids_of, line_decisions, words
from test_shingles import groups

import __spark_entry__
import corpus_pipeline
from lodestone.llm import rules


def test_pipeline(spark, docs, rows, tmp_path):
    items = [(1, " ".join(words(next(t for _, t in rows if t and 60 < len(words(t)) < 100))[5:40]))]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = {r.doc_id for r in rules.judge(docs).where("rules.kept").collect()}
    left = [(i, t) for i, t in rows if i in kept]
    gone = line_decisions(left)
    left = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if not gone.get((i, n)))) for i, t in left]
    roots = groups(left)
    left = [(i, t) for i, t in left if roots[i] == i]
    hits = benchmark_hits(left, items)
    left = {i: t for i, t in left if not hits[i][1]}

    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    assert set(pieces) == set(left) and 10 < len(left) < len(rows)
    for i, t in left.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == len(ids_of(t))


def test_stages_keep_columns(spark, docs, empty, tmp_path):
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for frame in (docs, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, frame, str(tmp_path)).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, empty, str(tmp_path)).count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
