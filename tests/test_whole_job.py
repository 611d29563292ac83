"""Jobs that were once done in part: the rest of each."""

import glob
import math
import os
from collections import Counter

import duckdb
import numpy as np

from rolesieve.operators import retrieval as R
from rolesieve.plans import catalog
from rolesieve.plans import policy_queries as P
from rolesieve.plans import retrieval_queries as Q
from rolesieve.plans.views import Tables, with_views

DATA = "/root/testdata/sf0.001"
QUERIES = catalog.queries()


def test_more_questions_than_one_block(spark):
    rng = np.random.default_rng(1)
    c, q = rng.normal(size=(300, 4)), rng.normal(size=(R.QUERY_BLOCK + 50, 4))
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<double>")
    got = {}
    for r in R.semantic_topk(chunks, asked, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    s = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T
    assert got == {i: row[:3].tolist() for i, row in enumerate(np.argsort(-s, axis=1))}
    assert R.semantic_topk(chunks, asked.limit(0), 3).count() == 0


def test_scope_comes_before_the_cut(spark):
    # user 1 sees only scope b, whose chunks are all farther than those of scope a
    chunks = spark.createDataFrame([(i, "a" if i < 50 else "b", [1.0, i / 100]) for i in range(60)], "chunk_id long, scope string, embedding array<double>")
    asked = spark.createDataFrame([(7, 1, [1.0, 0.0]), (8, 2, [1.0, 0.0]), (9, 3, [1.0, 0.0])], "query_id long, user_id long, embedding array<double>")
    members = spark.createDataFrame([("b", 1), ("a", 2), ("b", 2)], "scope string, user_id long")
    got = sorted(map(tuple, R.semantic_topk(chunks, asked, 3, members=members).select("query_id", "rank", "chunk_id").collect()))
    assert got == [(7, 1, 50), (7, 2, 51), (7, 3, 52), (8, 1, 0), (8, 2, 1), (8, 3, 2)]


def bm25(corpus, asked):
    """Okapi scores of one user's corpus {chunk: tokens}."""
    n, avg = len(corpus), sum(map(len, corpus.values())) / len(corpus)
    df = Counter(w for ws in corpus.values() for w in set(ws))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    tf = lambda ws, w: ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / avg))
    return {c: s for c, ws in corpus.items() if (s := sum((raw[w] if raw[w] >= 0 else 0.25 * mean) * tf(ws, w) for w in asked if w in raw)) > 0}


def test_search_scoped_against_brute_force(spark):
    t = Tables(spark, DATA)
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    pairs = f"{Q.GRANTS}, seen AS ({Q.granted('viewer', 'editor')}) SELECT q.query_id, c.vec_id AS chunk_id FROM text_queries q CROSS JOIN embeddings c JOIN documents x ON x.doc_id = c.vec_id JOIN docs d ON d.document_id = c.vec_id % 200 LEFT JOIN seen s ON s.user_id = q.user_id AND s.document_id = d.document_id WHERE s.user_id IS NOT NULL OR d.sensitivity = 1 OR c.vec_id % 5 = 0"
    allowed = {}
    for q, c in con.execute(with_views(pairs)).fetchall():
        allowed.setdefault(q, set()).add(c)
    vectors = {r[0]: np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) for r in con.execute("SELECT vec_id, embedding FROM embeddings").fetchall()}
    words = {r["id"]: list(r["ts"]) for r in t.documents.select(Q.F.col("doc_id").alias("id"), Q.X.tokenize(Q.F.col("text")).alias("ts")).collect()}
    asks = {r["query_id"]: list(r["ts"]) for r in t.text_queries.select("query_id", Q.X.tokenize(Q.F.col("text")).alias("ts")).collect()}
    assert len(asks) == 40 and min(map(len, allowed.values())) < 200  # not all is open to all
    want = {}
    for q, ts in asks.items():
        near = sorted((round(1 - float(vectors[q] @ vectors[c]), 9), c) for c in allowed[q])[:20]
        found = bm25({c: words[c] for c in allowed[q] if words[c]}, ts)
        lex = sorted((-round(s, 9), c) for c, s in found.items())[:20]
        for _, c in near + lex:
            want.setdefault((q, c), [None, None])
        for d, c in near:
            want[q, c][0] = round(1 - d, 5)
        for s, c in lex:
            want[q, c][1] = round(-s, 5)
    near = lambda x: None if x is None else round(x, 5)
    got = {(r["query_id"], r["chunk_id"]): [near(r["semantic"]), near(r["lexical"])] for r in Q.scoped_candidates(t).collect()}
    assert got.keys() == want.keys()
    for k, (a, b) in want.items():
        for x, y in zip(got[k], (a, b)):
            assert (x is None) == (y is None) and (x is None or abs(x - max(0, y)) < 3e-5)
    assert len({r["query_id"] for r in QUERIES["search_scoped"](spark, DATA).collect()}) == 40


def test_policy_of_all_pairs_of_user_and_document(spark):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(with_views(f"{P.RT} SELECT document_id, user_id, string_agg(DISTINCT CASE tier WHEN 'block' THEN label END, ',' ORDER BY CASE tier WHEN 'block' THEN label END), string_agg(DISTINCT CASE tier WHEN 'require' THEN label END, ',' ORDER BY CASE tier WHEN 'require' THEN label END), max(CASE tier WHEN 'block' THEN 2 WHEN 'require' THEN 1 ELSE 0 END) FROM detections JOIN tiers ON entity_key = label GROUP BY ALL")).fetchall()
    groups = QUERIES["tier_groups"](spark, DATA)
    got = QUERIES["apply_policy_groups"](spark, DATA).join(groups, "tiers").select("document_id", "user_id", "blocked", "required", "decision").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((*r[:4], ("full", "require", "block")[r[4]]) for r in want), key=str)
    assert len({r["user_id"] for r in got}) == groups.count() == 150


def test_trim_question_reads_the_whole_text(spark, tmp_path):
    long = "Thời hạn nộp báo cáo tài chính hằng năm của công ty chúng tôi theo quy định hiện hành"
    rows = [(1, 2, "user", long + " là gì?"), (2, 2, "user", long), (3, 0, "user", long), (4, 1, "user", long)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert [r["q"] for r in QUERIES["trim_question"](spark, str(tmp_path)).collect()] == [long] * 4


def test_limits_are_the_references(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "x" * 2000), (2, 0, "user", "x" * 2001)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame([(1, "\n".join(["y" * 9993] * 5))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, QUERIES["reject_oversized"](spark, str(tmp_path)).collect())) == [(1000, False), (2000, True)]
    assert sorted(r["rank"] for r in QUERIES["context_budget"](spark, str(tmp_path)).collect()) == [1, 2, 3, 4]
