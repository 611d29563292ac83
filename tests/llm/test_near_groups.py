"""Classes of near copies without all pairs of a group."""

import numpy as np

import corpus_pipeline
from rolesieve.llm import jaccard_forest


def group(n: int):
    """Near copies of one text, as many that share much with it and link with few, and two texts of their own."""
    rng = np.random.default_rng(5)
    base = [f"b{j}" for j in range(200)]
    rows = [(-2, "a text of its own that nobody else has"), (-1, None)]
    for k in range(2 * n):
        v = base[:]
        for at in rng.integers(0, 200, 1 if k < n else 6):
            v[int(at)] = f"c{k}"
        rows.append((k, " ".join(v)))
    return rows


def test_classes_without_links_are_those_with_links(spark):
    df = spark.createDataFrame(group(60), "doc_id long, text string")
    want = {r["doc_id"]: (r["class_id"], r["kept"]) for r in jaccard_forest.near_copies(df, block=8).collect()}
    got = jaccard_forest.near_copies(df, block=8, links=False)
    assert got.columns == ["doc_id", "class_id", "kept"]
    assert {r["doc_id"]: (r["class_id"], r["kept"]) for r in got.collect()} == want
    assert sum(k for _, k in want.values()) > 3  # some stay apart


def test_rows_of_the_stage_grow_with_the_group(spark, monkeypatch):
    made, real = [], jaccard_forest.met_pairs

    def counted(tasks, *rest):
        made.append(tasks.count())
        return real(tasks, *rest)

    monkeypatch.setattr(jaccard_forest, "met_pairs", counted)
    rows = [r for r in group(1200) if r[0] < 1200]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.one_of_each_group(spark, df, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [-2, -1, 0]
    assert sum(made) < 16 * len(rows)  # a row a tree at most, whatever the size of the group
