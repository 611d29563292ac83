"""Organisation, policy, ranking and table upkeep on small frames."""

from pyspark.sql import functions as F

from rolesieve.operators import organisation as O
from rolesieve.operators import policy as P
from rolesieve.operators import retrieval as R
from rolesieve.operators import tables as D
from rolesieve.sources.files import read_text_files


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_closure_of_a_diamond(spark):
    p = spark.createDataFrame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "a")], "oui_id string, parent_oui_id string")
    assert rows(O.org_closure(p)) == [("b", "a"), ("c", "a"), ("d", "a"), ("d", "b"), ("d", "c")]
    assert rows(O.org_root(p)) == [("b", "a"), ("c", "a"), ("d", "a")]
    assert O.org_closure(p.limit(0)).count() == 0


def tier(spark, pairs, unit, position, enabled=True, clearance=1):
    parents = spark.createDataFrame([("hr", "hcm"), ("hr-sub", "hr")], "oui_id string, parent_oui_id string")
    a = spark.createDataFrame([(1, unit, position)], "user_id long, oui_id string, position_id long")
    p = spark.createDataFrame([("k", *x) for x in pairs], "entity_key string, tier string, oui_id string, position_id long")
    m = P.scope_match(p, a, O.expanded_ouis(a, O.org_closure(parents)))
    rule = spark.createDataFrame([("k", enabled)], "entity_key string, enabled boolean")
    user = spark.createDataFrame([(1, clearance)], "user_id long, clearance int")
    return P.resolve_tiers(rule, user, m).first()["tier"]


def test_tiers(spark):
    assert tier(spark, [("mask", "hcm", None)], "hcm", 1) == "require"
    assert tier(spark, [("mask", "other", None)], "hcm", 1) == "block"
    assert tier(spark, [("mask", "hr", None)], "hcm", 1) == "require"  # below the user's unit
    assert tier(spark, [("mask", "hr", 9)], "hcm", 1) == "require"
    assert tier(spark, [("mask", "hcm", 9)], "hr", 1) == "block"
    assert tier(spark, [("allow", "hr", None), ("mask", "__ALL__", None)], "hcm", 1) == "full"
    assert tier(spark, [("allow", "hr", None)], "hr", 1, enabled=False) == "block"
    assert tier(spark, [], "hr", 1, clearance=5) == "full"


def test_membership(spark):
    a = spark.createDataFrame([(1, "root", 1), (2, "hr", 2), (2, "hr", 2)], "user_id long, oui_id string, position_id long")
    assert rows(O.membership_tuples(a)) == [("user:1", "member", "oui:root"), ("user:2", "member", "oui:hr")]


def test_actions(spark):
    a = spark.createDataFrame([(1, 0, "Salary Amount", "BLOCK"), (1, 1, "salary_amount", "mask"), (1, 2, "person_name", "unknown")], "version_id long, pos int, entity_type string, action string")
    assert rows(P.normalize_actions(a).select("entity_type", "action")) == [("person_name", "full"), ("salary_amount", "block")]
    old = spark.createDataFrame([(1, "salary_amount", 7)], "version_id long, entity_type string, detection_count long")
    assert ("salary_amount", 7, 0) in rows(P.replace_actions(a, old).select("entity_type", "detection_count", "sort_order"))


def test_rerank(spark):
    r = spark.createDataFrame([(1, 1, 0.02, 0.0, 5, 1), (1, 2, 0.01, 2.0, 1, 1), (1, 3, 0.005, float("nan"), 3, 1)], "query_id long, chunk_id long, rrf double, ce double, level int, clearance int")
    got = rows(R.rerank_rwss(r, 3).select("rank", "chunk_id", "rwss"))
    assert [x[1] for x in got] == [2, 3, 1] and got[1][2] == 0.3 and got[2][2] == 0.2


def test_bm25_negative_idf(spark):
    post = spark.createDataFrame([(i, "common", 1) for i in range(4)] + [(0, "rare", 1), (1, "x", 1), (2, "y", 1), (3, "z", 1)], "chunk_id long, token string, tf long")
    got = dict(R.bm25(post, spark.createDataFrame([(7, "rare"), (7, "common")], "query_id long, token string")).select("chunk_id", "score").collect())
    assert set(got) <= {0, 1, 2, 3} and max(got, key=got.get) == 0


def test_rrf_counts_a_shared_chunk_twice(spark):
    lists = spark.createDataFrame([(1, 5, "semantic", 1, 0.9), (1, 5, "lexical", 2, 3.0), (1, 6, "lexical", 1, 4.0)], "query_id long, chunk_id long, source string, rank int, distance double")
    assert dict(R.rrf_fuse(lists).select("chunk_id", "rrf").collect()) == {5: round(1 / 61 + 1 / 62, 6), 6: round(1 / 61, 6)}


def test_gate_ladder(spark):
    cols = "query_id long, document_id long, chunk_id long, level int, clearance int, visible boolean, owned boolean, granted boolean"
    r = spark.createDataFrame([(1, 1, 1, 5, 1, True, True, False), (1, 2, 2, 5, 1, True, False, False), (1, 2, 3, 1, 1, True, False, False), (1, 3, 4, 5, 1, True, False, True), (1, 4, 5, 2, 1, False, False, False), (1, 5, 6, 1, 1, False, False, False)], cols)
    got = {x["chunk_id"]: (x["blurred"], x["restricted"]) for x in R.access_gate(r).collect()}
    assert got == {1: (False, False), 2: (True, True), 3: (False, True), 4: (False, False), 6: (False, True)}
    assert 2 not in {x["chunk_id"] for x in R.access_gate(r, reranking=False).collect()}


def test_finalize_keeps_the_best_when_none_passes(spark):
    r = spark.createDataFrame([(1, 1, 0.2, "a"), (1, 2, 0.3, "b"), (1, 3, 0.9, " "), (2, 4, 0.9, "c"), (2, 5, None, "d")], "query_id long, chunk_id long, score double, text string")
    assert rows(R.finalize_results(r, 0.5, 3).select("query_id", "chunk_id")) == [(1, 2), (2, 4)]


def test_upserts_and_reruns(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, seq int, v int")
    new = spark.createDataFrame([("a", 2, 5), ("c", 1, 9)], "k string, seq int, v int")
    once = D.upsert_by_key(old, new, ["k"], "seq")
    assert rows(once) == rows(D.upsert_by_key(once, new, ["k"], "seq")) == [("a", 2, 5), ("b", 1, 1), ("c", 1, 9)]


def test_version_files_are_overwritten_alone(spark, tmp_path):
    one = spark.createDataFrame([(1, "x"), (2, "y")], "version_id long, t string")
    D.write_version_chunks(one, str(tmp_path / "c"), "version_id")
    for _ in range(2):
        D.write_version_chunks(spark.createDataFrame([(2, "z")], "version_id long, t string"), str(tmp_path / "c"), "version_id")
    assert rows(spark.read.parquet(str(tmp_path / "c")).select("version_id", "t")) == [(1, "x"), (2, "z")]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("xin chào\r\n".encode() + b"\xff")
    (tmp_path / "b.txt").write_bytes(b" \n")
    texts, rejects = read_text_files(spark, str(tmp_path))
    assert [r["text"] for r in texts.collect()] == ["xin chào"] and rejects.count() == 1


def test_embedding_keeps_empty_slots(spark):
    got = D.embed_batches(spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "id long, text string"), D.hashing_embedder(8)).orderBy("id").collect()
    assert [len(r["embedding"]) for r in got] == [8, 0, 0]


def test_streams(spark, tmp_path):
    from rolesieve.streaming.incremental import dedupe_stream, upsert_stream

    src = tmp_path / "in"
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k long, seq long, v string").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.parquet(str(src))
    stream = lambda: spark.readStream.schema("k long, seq long, v string, ts timestamp").parquet(str(src))
    upsert_stream(stream(), str(tmp_path / "t"), ["k"], "seq", str(tmp_path / "cp")).awaitTermination(60)
    assert rows(spark.read.parquet(str(tmp_path / "t/v=0")).select("k", "v")) == [(1, "b"), (2, "c")]  # the first version, by bucket
    q = dedupe_stream(stream(), ["k"], "ts").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("once").count() == 2


def test_roots_and_levels_end_on_a_cycle(spark):
    from rolesieve.operators import organisation as O

    parents = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "y"), ("s", "s")], "oui_id string, parent_oui_id string")
    roots = {r["oui_id"]: r["root"] for r in O.org_root(parents).collect()}
    assert roots == {"b": "a", "c": "a", "x": None, "y": None, "z": None, "s": None}
    nodes = spark.createDataFrame([(x,) for x in "abcxyzsq"], "oui_id string")
    levels = {r["oui_id"]: r["level"] for r in O.topo_levels(nodes, parents).collect()}
    assert levels == {"a": 0, "q": 0, "b": 1, "c": 2, "x": 3, "y": 3, "z": 3, "s": 3}


def test_context_budget_counts_the_separator(spark):
    from rolesieve.operators import retrieval as R

    rows = spark.createDataFrame([(1, i, "x" * 10) for i in (1, 2, 3)], "query_id long, rank long, text string")
    assert R.context_budget(rows, 34).count() == 2 and R.context_budget(rows, 33).count() == 1 and R.context_budget(rows, 1).count() == 1


def test_keyword_f1_looks_for_the_longest_word(spark):
    from rolesieve.operators import retrieval as R

    chunks = spark.createDataFrame([("a", "hợp đồng lao động"), ("b", "hop dong"), ("c", "của công ty"), ("d", "")], "chunk_id string, chunk_text string")
    asked = spark.createDataFrame([(1, "Hợp của đồng?"), (2, "cong ty xyzzy"), (3, "?")], "query_id long, text string")
    got = {(r["query_id"], r["chunk_id"], r["rank"]): r["f1"] for r in R.keyword_f1(chunks, asked, 5).collect()}
    # 1 looks for "đồng" (longest, no stopword), which "b" has only without accents; 2 finds its word nowhere and looks at all
    assert got == {(1, "a", 1): round(4 / 6, 6), (2, "c", 1): round(4 / 6, 6)}


def test_merges_of_ranked_lists(spark):
    from rolesieve.operators import retrieval as R

    rows = spark.createDataFrame([(1, 0, 1, "a", 0.5), (1, 0, 2, "b", 0.4), (1, 1, 1, "b", 0.9), (1, 1, 2, "c", None), (1, 1, 3, None, 1.0)], "query_id long, sub int, rank int, chunk_id string, score double")
    assert [(r["place"], r["chunk_id"], r["score"]) for r in R.merge_subqueries(rows).orderBy("place").collect()] == [(1, "a", 0.5), (2, "b", 0.9), (3, "c", 0.0)]
    lists = spark.createDataFrame([(1, 0, 1, "a", 0.5), (1, 0, 2, "b", 0.4), (1, 1, 1, "m", 0.5), (1, 1, 2, "n", 0.45)], "query_id long, collection int, rank int, chunk_id string, score double")
    assert [r["chunk_id"] for r in R.merge_collections(lists, 3).orderBy("place").collect()] == ["a", "m", "n"]


def test_apply_policy_masks_and_tells(spark):
    from rolesieve import constants as K
    from rolesieve.operators import policy as P

    spans = [("email", "a@b.vn", 0, 6), ("phone", "12345678", 7, 15), ("other", "x", 16, 17)]
    rows = spark.createDataFrame([(u, 7, "a@b.vn 12345678 x", spans, None) for u in (1, 2, 3, 4, None)], "user_id long, chunk_id long, text string, entities array<struct<label:string,text:string,start:int,end:int>>, doc_restricted boolean")
    tiers = spark.createDataFrame([(1, "email", "block", "full", None), (1, "phone", "require", "partial", "tail"), (2, "email", "full", "full", None), (2, "phone", "require", "full", None), (4, "email", "full", "full", None)], "user_id long, entity_key string, tier string, style string, position string")
    rules = spark.createDataFrame([("email",), ("phone",)], "entity_key string")
    got = {r["user_id"]: r for r in P.apply_policy(rows, tiers, rules).collect()}
    assert got[1]["text"] == " 12" + K.MASK_CHAR * 6 + " x" and got[2]["text"] == f"a@b.vn {K.MASK_PLACEHOLDER} x"
    assert got[3]["text"].strip() == "x" and got[4]["text"] == "a@b.vn  x" and got[None]["text"].strip() == "x"  # no tier for a rule: blocked
    assert [(got[u]["decision"], got[u]["blocked"], got[u]["required"], got[u]["doc_restricted"]) for u in (1, 2, 3, 4)] == [("block", ["email"], ["phone"], True), ("require", [], ["phone"], True), ("block", ["email", "phone"], [], False), ("block", ["phone"], [], False)]
    assert [tuple(m) for m in got[1]["contract"]["matched"]] == [("email", "block", ["a@b.vn"]), ("phone", "require", ["12345678"])] and got[1]["contract"]["requires_access_request"]


def test_new_emails_with_an_empty_index(spark):
    from rolesieve.operators import tables as D

    m = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "user_id long, message_id long")
    assert D.new_emails(m, m.where("message_id = 1"), m).count() == 1 and D.new_emails(m, m, m.limit(0)).count() == 3
