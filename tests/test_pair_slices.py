"""The rows that a task keeps at once while pairs are made are those of a slice, not of two whole blocks."""

from pyspark.sql import functions as F

from rolesieve.operators import organisation as O


def made_at_once(df):
    """The generators of the plan that ran, and which of them are compiled into one function that keeps its rows."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    return [(line.lstrip("+- :").startswith("*"), line) for line in plan if "Generate " in line]


def test_blocks_are_cut_before_the_compiled_step(spark):
    documents = spark.range(40).select(F.col("id").alias("document_id"), F.lit("d").alias("doc_class"))
    users = spark.range(9).select(F.lit("u").alias("user_class"), F.col("id").alias("user_id"))
    matches = spark.createDataFrame([("d", "u")], "doc_class string, user_class string")
    pairs = O.class_pairs(documents, users, matches)
    steps = made_at_once(pairs)
    assert [compiled for compiled, _ in steps] == [True, True, False]  # from the last to the first
    assert "slice(_documents#" in steps[2][1] and f", {O.SLICE})" in steps[2][1]
    assert sorted(map(tuple, pairs.collect())) == [(u, d) for u in range(9) for d in range(40)]


def test_slices_of_any_block_hold_each_row_once(spark):
    for n in (1, O.SLICE - 1, O.SLICE, O.SLICE + 1, 5 * O.SLICE):
        documents = spark.range(n).select(F.col("id").alias("document_id"), F.lit("d").alias("doc_class"), F.lit(None).cast("string").alias("title"))
        users = spark.createDataFrame([("u", 7), ("v", 8)], "user_class string, user_id long")
        matches = spark.createDataFrame([("d", "u"), ("d", None)], "doc_class string, user_class string")
        assert sorted(map(tuple, O.class_pairs(documents, users, matches).collect())) == [(7, d, None) for d in range(n)]
