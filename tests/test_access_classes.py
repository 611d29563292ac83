"""Users and documents meet by classes: the same rows as pair by pair, and no exchange of pairs."""

from pyspark.sql import functions as F

from rolesieve.operators import organisation as O

DOCS = "document_id long, owner_user_id long, sensitivity int"


def org(spark):
    parents = spark.createDataFrame([("r", "corp"), ("n1", "r"), ("n2", "r")], "oui_id string, parent_oui_id string")
    assignments = spark.createDataFrame([(1, "corp", 11), (2, "n1", 31), (3, "n1", 35), (4, "n2", 32), (4, "n1", 31), (5, None, 35)], "user_id long, oui_id string, position_id int")
    positions = spark.createDataFrame([(11, 1), (31, 1), (32, 2), (35, 5)], "position_id int, clearance int")
    return parents, assignments, positions, O.org_closure(parents), O.org_root(parents)


def by_pairs(tuples, assignments, positions, closure, relations):
    owner = tuples.where("relation = 'owner'").select(F.expr("TRY_CAST(substring(subject, 6) AS BIGINT)").alias("user_id"), "document_id")
    subjects = O.subjects_of_users(assignments, closure).join(O.user_clearance(assignments, positions), "user_id")
    return owner.unionAll(tuples.where(F.col("relation").isin(relations)).join(subjects, "subject").where("clearance >= required").select("user_id", "document_id")).distinct()


def rows(df):
    return sorted(map(str, df.collect()))


def test_access_by_classes_is_access_by_pairs(spark):
    parents, assignments, positions, closure, roots = org(spark)
    docs = spark.createDataFrame([(i, (i % 7) or None, 1 + i % 5) for i in range(60)] + [(3, 2, 5), (None, 1, 1)], DOCS)
    at = docs.where("document_id % 10 > 0").select("document_id", F.when(F.col("document_id") % 3 == 0, "n1").when(F.col("document_id") % 3 == 1, "r").otherwise("n2").alias("oui_id"))
    tuples = O.document_tuples(docs, at, parents, closure, roots)
    for relations in (["viewer", "editor"], ["editor"]):
        want = rows(by_pairs(tuples, assignments, positions, closure, relations))
        assert rows(O.granted_documents(tuples, assignments, positions, closure, relations)) == want
    held, users, matches = O.access_classes(tuples, assignments, positions, closure, ["viewer", "editor"])
    one = rows(O.class_pairs(held.select("document_id", "doc_class"), users, matches, 2))
    assert one == rows(O.class_pairs(held.select("document_id", "doc_class"), users, matches)) and len(one) == len(set(one))


def test_no_exchange_holds_pairs(spark):
    parents, assignments, positions, closure, roots = org(spark)
    docs = spark.createDataFrame([(1, 1, 1)], DOCS)
    tuples = O.document_tuples(docs, docs.select("document_id", F.lit("n1").alias("oui_id")), parents, closure, roots)
    plan = O.viewable_documents(tuples, assignments, positions, closure)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate explode")]
    assert "Aggregate" not in above and "Join" not in above


def test_file_gate(spark):
    parents, assignments, positions, closure, roots = org(spark)
    docs = spark.createDataFrame([(1, 2, 5), (2, 9, 1), (3, 9, 3), (4, None, 1)], DOCS)
    at = spark.createDataFrame([(1, "n1"), (2, "n1"), (3, "n1")], "document_id long, oui_id string")
    levels = spark.createDataFrame([(2, 3)], "document_id long, level int")
    granted = spark.createDataFrame([(2, 2), (2, 3), (4, 4)], "user_id long, document_id long")
    tuples = O.document_tuples(docs, at, parents, closure, roots)
    got = O.file_gate(docs, levels, tuples, assignments, positions, closure, granted, "corp")
    seen = by_pairs(tuples, assignments, positions, closure, ["viewer", "editor"]).join(docs, "document_id").join(levels, "document_id", "left").join(O.user_clearance(assignments, positions), "user_id", "left")
    top = assignments.where("oui_id = 'corp'").select("user_id").distinct().withColumn("top", F.lit(True))
    seen = seen.join(top, "user_id", "left").join(granted.withColumn("g", F.lit(True)), ["user_id", "document_id"], "left")
    want = seen.where(F.col("top").isNotNull() | (F.col("owner_user_id") == F.col("user_id")) | (F.coalesce("level", "sensitivity") <= F.coalesce("clearance", F.lit(1))) | F.col("g").isNotNull()).select("user_id", "document_id")
    assert rows(got) == rows(want) and {(2, 1), (2, 2), (3, 3)} <= {tuple(r) for r in got.collect()}


def test_cleared_chunks_meet_by_classes(spark):
    requests = spark.createDataFrame([(1, 7), (1, 7), (2, 7), (3, 7), (None, 7), (2, 8)], "user_id long, document_id long")
    chunks = spark.createDataFrame([(70, 7, 1), (70, 7, 1), (71, 7, 3), (80, 8, 2), (90, None, 1)], "chunk_id long, document_id long, chunk_sensitivity int")
    clearance = spark.createDataFrame([(1, 1), (2, 3), (None, 5)], "user_id long, clearance int")
    got = O.cleared_chunks(requests, chunks, clearance)
    assert sorted(map(tuple, got.collect())) == [(70, 1), (70, 2), (71, 2), (80, 2)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("Generate explode")]
