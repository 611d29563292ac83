"""Queries of ranking, and the flagship search."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolesieve import constants as K
from rolesieve.functions import text as X
from rolesieve.operators import organisation as O
from rolesieve.operators import policy as P
from rolesieve.operators import retrieval as R
from rolesieve.operators.chunking import verify_content, version_content_hash
from rolesieve.operators.tables import written
from rolesieve.plans.organisation_queries import AS_OF, GRANTS, closure, granted, tuples
from rolesieve.plans.text_queries import TOKENS, tokens_sql
from rolesieve.plans.views import QUERIES, query

SEM = "sem AS (SELECT query_id, chunk_id, document_id, chunk_sensitivity, 1 - list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS distance FROM queries q CROSS JOIN chunk_vectors c), semk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), chunk_id) AS rank FROM sem QUALIFY rank <= 20)"


def bm25_sql(post: str, asked: str) -> str:
    """CTEs bm (query_id, chunk_id, score) from FROM clauses of postings and asked tokens."""
    return f"""post AS (SELECT chunk_id, token, count(*) AS tf FROM ({post}) GROUP BY ALL), len AS (SELECT chunk_id, sum(tf) AS dl FROM post GROUP BY 1), sz AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
rawidf AS (SELECT token, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM post, sz GROUP BY token, n), idf AS (SELECT token, CASE WHEN r < 0 THEN 0.25::DOUBLE * (SELECT avg(r) FROM rawidf) ELSE r END AS idf FROM rawidf),
asked AS (SELECT query_id, token, count(*) AS times FROM ({asked}) GROUP BY ALL),
bm AS (SELECT query_id, chunk_id, sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM asked JOIN post USING (token) JOIN idf USING (token) JOIN len USING (chunk_id), sz GROUP BY ALL HAVING score > 0)"""


LINE_BM = bm25_sql(f"SELECT chunk_id, unnest({tokens_sql('chunk_text')}) AS token FROM line_chunks", f"SELECT query_id, unnest({tokens_sql('text')}) AS token FROM text_queries")


def asked_tokens(queries, text: str = "text"):
    return queries.select("query_id", F.explode(X.tokenize(F.col(text))).alias("token"))


@query("semantic_topk", f"WITH {SEM} SELECT query_id, chunk_id, rank, round(greatest(0, least(1, 1 - distance)), 6) AS similarity FROM semk")
def _(t):
    return R.semantic_topk(t.chunk_vectors, t.queries, 20).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round(R.similarity(F.col("distance")), 6).alias("similarity"))


@query("bm25_topk", f"WITH {LINE_BM}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank, max(score) OVER (PARTITION BY query_id) AS most FROM bm) SELECT query_id, chunk_id, rank, round(score, 6) AS score, round(1 - score / most, 6) AS distance FROM r WHERE rank <= 20")
def _(t):
    best = R.bm25_topk(t.line_chunks, asked_tokens(t.text_queries), 20)
    most = F.max("score").over(R.Window.partitionBy("query_id"))
    return best.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), F.round(1 - F.col("score") / most, 6).alias("distance"))


@query("keyword_f1_topk", f"""
WITH q AS (SELECT query_id, list_distinct({TOKENS.replace('{0}', 'strip_accents(text)')}) AS qs, {tokens_sql('text')} AS told FROM text_queries),
p AS (SELECT query_id, qs, list_filter(told, lambda x: length(x) = list_max(list_transform(told, lambda y: length(y))))[1] AS word FROM q WHERE len(told) > 0),
c AS (SELECT chunk_id, chunk_text, list_distinct({TOKENS.replace('{0}', 'strip_accents(chunk_text)')}) AS cs FROM line_chunks),
near AS (SELECT query_id, qs, chunk_id, cs FROM p JOIN c ON contains(chunk_text, word)),
looked AS (SELECT * FROM near UNION ALL SELECT query_id, qs, chunk_id, cs FROM p CROSS JOIN c WHERE query_id NOT IN (SELECT query_id FROM near)),
f AS (SELECT query_id, chunk_id, round(2.0 * len(list_intersect(qs, cs)) / (len(qs) + len(cs)), 6) AS f1 FROM looked)
SELECT query_id, chunk_id, f1 FROM f WHERE f1 > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY f1 DESC, chunk_id) <= 20""")
def _(t):
    return R.keyword_f1(t.line_chunks, t.text_queries, 20).select("query_id", "chunk_id", "f1")


# One table of chunks with vectors and text, and questions with both.
CHUNKS = "SELECT chunk_id, c.document_id, chunk_sensitivity AS level, embedding, text FROM chunk_vectors c JOIN documents d ON d.doc_id = c.chunk_id"
ASK = "SELECT query_id, user_id, embedding, text FROM text_queries q JOIN embeddings e ON e.vec_id = q.query_id"
BOTH = (
    f"chunks AS ({CHUNKS}), ask AS ({ASK}), sem AS (SELECT query_id, chunk_id, 1 - list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS distance FROM ask q CROSS JOIN chunks c), semk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), chunk_id) AS rank FROM sem QUALIFY rank <= 20), "
    + bm25_sql(f"SELECT chunk_id, unnest({tokens_sql('text')}) AS token FROM chunks", f"SELECT query_id, unnest({tokens_sql('text')}) AS token FROM ask")
    + ", bmk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm QUALIFY rank <= 20)"
    + ", fused AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS rrf, max(s) AS semantic, max(l) AS lexical FROM (SELECT query_id, chunk_id, rank, greatest(0, least(1, 1 - distance)) AS s, NULL::DOUBLE AS l FROM semk UNION ALL SELECT query_id, chunk_id, rank, NULL, score FROM bmk) GROUP BY ALL)"
)
SHOWN = "round(greatest(0, least(1, coalesce(0.6::DOUBLE * semantic + 0.4::DOUBLE / (1 + exp(-lexical / 5)), semantic, 1 / (1 + exp(-lexical / 5))))), 6)"


def both_tables(t):
    d = t.documents.select(F.col("doc_id").alias("chunk_id"), "text")
    chunks = t.chunk_vectors.withColumnRenamed("chunk_sensitivity", "level").join(d, "chunk_id")
    ask = t.text_queries.join(t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")
    return chunks, ask


def fused(t):
    chunks, ask = both_tables(t)
    s = R.semantic_topk(chunks, ask, 20).select("query_id", "chunk_id", F.lit("semantic").alias("source"), "rank", R.similarity(F.col("distance")).alias("distance"))
    lex = R.bm25_topk(chunks, asked_tokens(ask), 20, text="text").select("query_id", "chunk_id", F.lit("lexical").alias("source"), "rank", F.col("score").alias("distance"))
    return R.rrf_fuse(s.unionAll(lex))


@query("rrf_fuse", f"WITH {BOTH} SELECT query_id, chunk_id, rrf, round(semantic, 6) AS semantic, round(lexical, 6) AS lexical FROM fused")
def _(t):
    return fused(t).select("query_id", "chunk_id", "rrf", F.round("semantic", 6).alias("semantic"), F.round("lexical", 6).alias("lexical"))


@query("display_score", f"WITH {BOTH} SELECT query_id, chunk_id, {SHOWN} AS score FROM fused")
def _(t):
    return fused(t).select("query_id", "chunk_id", R.display_score(F.col("semantic"), F.col("lexical")).alias("score"))


@query("rank_single_mode", f"WITH {BOTH} SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS place FROM bmk")
def _(t):
    w = R.Window.partitionBy("query_id").orderBy(F.desc(F.round("lexical", 6)), "chunk_id")
    return fused(t).where("lexical is not null").select("query_id", "chunk_id", F.row_number().over(w).cast("long").alias("place"))


# What each asker may see of each chunk.
FLAGS = f"seen AS ({granted('viewer', 'editor')}), g AS (SELECT DISTINCT user_id, document_id FROM access_requests WHERE status = 'approved' AND (expires_at IS NULL OR expires_at > TIMESTAMP '{AS_OF}')), flagged AS (SELECT a.query_id, a.user_id, c.chunk_id, c.document_id, CASE WHEN d.owner_user_id = a.user_id THEN 1 ELSE c.level END AS level, coalesce(cl.clearance, 1) AS clearance, s.user_id IS NOT NULL OR d.sensitivity = 1 AS visible, g.user_id IS NOT NULL AS granted FROM ask a CROSS JOIN chunks c JOIN docs d ON d.document_id = c.document_id LEFT JOIN clear cl ON cl.user_id = a.user_id LEFT JOIN seen s ON s.user_id = a.user_id AND s.document_id = c.document_id LEFT JOIN g ON g.user_id = a.user_id AND g.document_id = c.document_id)"
SCOPE = f"{GRANTS}, chunks AS ({CHUNKS}), ask AS ({ASK}), {FLAGS}"


def flagged(t, pairs, viewable=None):
    """Access flags of (query_id, user_id, chunk_id, document_id, level) rows, all by equi joins."""
    seen = (viewable or O.viewable_documents(tuples(t), t.assignments, t.positions, closure(t))).withColumn("seen", F.lit(True))
    d = t.docs.select("document_id", "sensitivity", "owner_user_id")
    grants = O.active_grants(t.access_requests, AS_OF).withColumn("g", F.lit(True))
    j = pairs.join(d, "document_id").join(O.user_clearance(t.assignments, t.positions), "user_id", "left").join(seen, ["user_id", "document_id"], "left").join(grants, ["user_id", "document_id"], "left")
    visible = F.col("seen").isNotNull() | (F.col("sensitivity") == 1)
    return j.select(*pairs.columns, F.coalesce("clearance", F.lit(1)).alias("clearance"), visible.alias("visible"), (F.col("owner_user_id") == F.col("user_id")).alias("owned"), F.col("g").isNotNull().alias("granted"))


def candidates(t):
    chunks, ask = both_tables(t)
    f = written(fused(t).join(ask.select("query_id", "user_id"), "query_id").join(chunks.select("chunk_id", "document_id", "level"), "chunk_id"))
    return flagged(t, f, viewable_of(t, f))


def viewable_of(t, f):
    """What the users of ``f`` may view of the documents of ``f``: both go into the access joins first."""
    documents, users = f.select("document_id").distinct(), f.select("user_id").distinct()
    below = written(closure(t))
    few = lambda x: x.join(documents, "document_id", "left_semi")
    grants = O.document_tuples(few(t.docs), few(t.document_oui), t.oui_parents, below, O.org_root(t.oui_parents))
    return O.viewable_documents(grants, t.assignments.join(users, "user_id", "left_semi"), t.positions, below)


@query("retrieval_scope", f"{SCOPE} SELECT DISTINCT user_id, chunk_id FROM flagged WHERE visible UNION SELECT NULL, chunk_id FROM chunks WHERE level = 1")
def _(t):
    """Chunks of visible documents by user; public chunks are one row for all users (null user)."""
    chunks, ask = both_tables(t)
    users = ask.select("user_id").distinct()
    seen = O.viewable_documents(tuples(t), t.assignments, t.positions, closure(t)).join(F.broadcast(users), "user_id", "left_semi")
    public = t.docs.where("sensitivity = 1").select("document_id", F.lit(1).alias("one")).join(F.broadcast(users.withColumn("one", F.lit(1))), "one").select("user_id", "document_id")  # the askers of one block
    scoped = chunks.select("chunk_id", "document_id").join(seen.unionAll(public).distinct(), "document_id").select("user_id", "chunk_id")
    return scoped.unionAll(chunks.where("level = 1").select(F.lit(None).cast("long").alias("user_id"), "chunk_id"))


GATED = f"{GRANTS}, {BOTH}, {FLAGS}, gate AS (SELECT f.*, u.rrf, u.semantic, u.lexical, visible AND f.level > clearance AND NOT granted AS blurred FROM flagged f JOIN fused u ON u.query_id = f.query_id AND u.chunk_id = f.chunk_id), gated AS (SELECT *, max(blurred) OVER (PARTITION BY query_id, document_id) OR (NOT visible AND level <= clearance) AS restricted FROM gate QUALIFY visible OR level <= clearance)"


@query("access_gate", f"{GATED} SELECT query_id, chunk_id, level, blurred, restricted FROM gated")
def _(t):
    return R.access_gate(candidates(t)).select("query_id", "chunk_id", F.col("level").cast("long").alias("level"), "blurred", "restricted")


@query("restrict_flag_spread", f"{GATED} SELECT DISTINCT query_id, document_id FROM gated WHERE visible AND restricted")
def _(t):
    return R.access_gate(candidates(t)).where("visible and restricted").select("query_id", "document_id").distinct()


@query("oui_filter", "SELECT document_id FROM (SELECT document_id, string_agg(oui_id, ',' ORDER BY oui_id) AS ouis FROM document_oui GROUP BY 1) WHERE list_has_any(string_split(ouis, ','), ['n3', 'corp'])")
def _(t):
    listed = t.document_oui.groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set("oui_id")), ",").alias("ouis"))
    return listed.where(F.arrays_overlap(F.split("ouis", ","), F.array(F.lit("n3"), F.lit("corp")))).select("document_id")


CE = "((chunk_id * 7 + query_id) % 11 - 5) / 2.0::DOUBLE"


def ce():
    return ((F.col("chunk_id") * 7 + F.col("query_id")) % 11 - 5) / F.lit(2.0)


@query("rerank_rwss", f"{GATED}, pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) AS p FROM gated QUALIFY p <= 10), s AS (SELECT *, round(0.8::DOUBLE / (1 + exp(-({CE}))) - 0.2::DOUBLE * greatest(0, least(1, (level - clearance) / 4.0::DOUBLE)), 6) AS rwss FROM pool) SELECT query_id, chunk_id, rwss, row_number() OVER (PARTITION BY query_id ORDER BY rwss DESC, rrf DESC, chunk_id) AS rank FROM s QUALIFY rank <= 5")
def _(t):
    rows = R.access_gate(candidates(t)).withColumn("ce", ce())
    return R.rerank_rwss(rows, 5).select("query_id", "chunk_id", "rwss", F.col("rank").cast("long").alias("rank"))


RANKED = f"{BOTH}, ranked AS (SELECT query_id, 0 AS part, rank, chunk_id, round(greatest(0, least(1, 1 - distance)), 6) AS score FROM semk UNION ALL SELECT query_id, 1, rank, chunk_id, round(1 / (1 + exp(-score / 5)), 6) FROM bmk)"


def ranked(t, part: str):
    """Both engines' lists of every question, on one scale, as those of two sub-queries or collections."""
    chunks, ask = both_tables(t)
    s = R.semantic_topk(chunks, ask, 20).select("query_id", F.lit(0).alias(part), "rank", "chunk_id", F.round(R.similarity(F.col("distance")), 6).alias("score"))
    lex = R.bm25_topk(chunks, asked_tokens(ask), 20, text="text")
    return s.unionAll(lex.select("query_id", F.lit(1), "rank", "chunk_id", F.round(1 / (1 + F.exp(-F.col("score") / K.BM25_SIGMOID_SCALE)), 6)))


@query("merge_subqueries", f"WITH {RANKED} SELECT query_id, chunk_id, max(score) AS score, row_number() OVER (PARTITION BY query_id ORDER BY min(1000 * part + rank), chunk_id) AS place FROM ranked GROUP BY query_id, chunk_id")
def _(t):
    return R.merge_subqueries(ranked(t, "sub"))


@query("merge_collections", f"WITH {RANKED} SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, part, rank) AS place FROM ranked WHERE rank <= 5 QUALIFY place <= 5")
def _(t):
    return R.merge_collections(ranked(t, "collection").where("rank <= 5"), 5).select("query_id", "chunk_id", F.col("place").cast("long").alias("place"))


@query("finalize_results", f"WITH {BOTH}, f AS (SELECT query_id, chunk_id, {SHOWN} AS score, text FROM fused JOIN chunks USING (chunk_id)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, chunk_id) AS rank, max(score) OVER (PARTITION BY query_id) AS most FROM f WHERE trim(text) <> '') SELECT query_id, chunk_id, score, rank FROM r WHERE (score >= 0.65 AND rank <= 5) OR (most < 0.65 AND rank = 1)")
def _(t):
    chunks, _ = both_tables(t)
    rows = fused(t).select("query_id", "chunk_id", R.display_score(F.col("semantic"), F.col("lexical")).alias("score")).join(chunks.select("chunk_id", "text"), "chunk_id")
    return R.finalize_results(rows, 0.65, 5).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query("sensitivity_gate", "SELECT DISTINCT c.chunk_id, u.user_id FROM access_requests r JOIN chunk_vectors c USING (document_id) JOIN assignments u USING (user_id) JOIN positions p USING (position_id) WHERE c.chunk_sensitivity <= p.clearance")
def _(t):
    """Chunks of the documents a user asked for that the user's clearance reaches."""
    held = t.assignments.join(t.positions.drop("ou_id"), "position_id").groupBy("user_id").agg(F.max("clearance").alias("clearance"))
    return O.cleared_chunks(t.access_requests, t.chunk_vectors, held)


@query("context_budget", "WITH r AS (SELECT document_id AS query_id, chunk_index + 1 AS rank, chunk_text AS text FROM line_chunks), n AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, text FROM r), s AS (SELECT *, sum(length(text) + 7) OVER (PARTITION BY query_id ORDER BY rank) AS upto FROM n) SELECT query_id, rank, upto FROM s WHERE rank = 1 OR upto <= 40000")
def _(t):
    w = R.Window.partitionBy("document_id").orderBy("chunk_index")
    rows = t.line_chunks.select(F.col("document_id").alias("query_id"), F.row_number().over(w).cast("long").alias("rank"), F.col("chunk_text").alias("text"))
    return R.context_budget(rows).select("query_id", "rank", "upto")


@query("enrich_document_type", "SELECT chunk_id, CASE WHEN chunk_id % 2 = 0 THEN coalesce(d.document_type, 'general') ELSE 'Kept' END AS document_type FROM chunk_vectors c LEFT JOIN docs d USING (document_id)")
def _(t):
    stale = F.when(F.col("chunk_id") % 2 == 0, "general").otherwise("Kept")
    j = t.chunk_vectors.select("chunk_id", "document_id", stale.alias("old")).join(t.docs.select("document_id", "document_type"), "document_id", "left")
    return j.select("chunk_id", F.when(F.col("old") == "general", F.coalesce("document_type", "old")).otherwise(F.col("old")).alias("document_type"))


@query("search", f"{GATED}, s AS (SELECT *, {SHOWN} AS score, round(0.8::DOUBLE / (1 + exp(-({CE}))) - 0.2::DOUBLE * greatest(0, least(1, (level - clearance) / 4.0::DOUBLE)), 6) AS rwss, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) AS p FROM gated QUALIFY p <= 10) SELECT query_id, user_id, chunk_id, document_id, blurred, restricted, score, rwss, row_number() OVER (PARTITION BY query_id ORDER BY rwss DESC, rrf DESC, chunk_id) AS rank FROM s QUALIFY rank <= 5")
def _(t):
    """Hybrid search of every question, gated by what its asker may see, reranked by risk-weighted score."""
    rows = R.access_gate(candidates(t)).withColumn("score", R.display_score(F.col("semantic"), F.col("lexical"))).withColumn("ce", ce())
    return R.rerank_rwss(rows, 5).select("query_id", "user_id", "chunk_id", "document_id", "blurred", "restricted", "score", "rwss", F.col("rank").cast("long").alias("rank"))


def scoped_candidates(t):
    """As ``candidates``, but both lists hold the 20 best of what the asker may be shown, for all questions that have a vector."""
    d = t.documents.select(F.col("doc_id").alias("chunk_id"), "text")
    chunks = t.chunk_vectors.withColumnRenamed("chunk_sensitivity", "level").join(d, "chunk_id")
    ask = written(t.text_queries.join(t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id"))
    below = written(closure(t))
    grants = written(O.document_tuples(t.docs, t.document_oui, t.oui_parents, below, written(O.org_root(t.oui_parents))))
    in_scope, members = map(written, O.search_scopes(chunks, t.docs, grants, t.assignments, t.positions, below, ask))
    s = R.semantic_topk(t.chunk_vectors.join(in_scope, "chunk_id"), ask, 20, members=members).select("query_id", "chunk_id", F.lit("semantic").alias("source"), "rank", R.similarity(F.col("distance")).alias("distance"))
    asked = written(ask.select("query_id", "user_id", F.explode(X.tokenize(F.col("text"))).alias("token")))
    lex = R.scoped_bm25(written(R.postings(chunks, text="text")), asked, in_scope, members)
    lex = R.top(lex, ["query_id"], [F.desc(F.round("score", 9)), "chunk_id"], 20).select("query_id", "chunk_id", F.lit("lexical").alias("source"), "rank", F.col("score").alias("distance"))
    f = written(R.rrf_fuse(s.unionAll(lex)).join(ask.select("query_id", "user_id"), "query_id").join(chunks.select("chunk_id", "document_id", "level"), "chunk_id"))
    # of the documents found, what the askers may view
    found = grants.join(f.select("document_id").distinct(), "document_id", "left_semi")
    return flagged(t, f, O.viewable_documents(found, t.assignments.join(f.select("user_id").distinct(), "user_id", "left_semi"), t.positions, below))


@query("search_scoped")
def _(t):
    """``search`` with the asker's scope before the cuts to 20, for every benchmark question that has a vector.

    Ranked and gated rows, as ``search``: the unit filter a user may pick (G10), the hash check (C13), the
    final threshold (G14) and masking (E12) are queries of their own and not part of either.
    """
    rows = R.access_gate(scoped_candidates(t)).withColumn("score", R.display_score(F.col("semantic"), F.col("lexical"))).withColumn("ce", ce())
    return R.rerank_rwss(rows, 5).select("query_id", "user_id", "chunk_id", "document_id", "blurred", "restricted", "score", "rwss", F.col("rank").cast("long").alias("rank"))


def asker_tiers(t, askers):
    """Tiers and styles of the askers (user_id) alone."""
    users = t.assignments.join(askers.select("user_id").distinct(), "user_id", "left_semi")
    matches = P.scope_match(t.rule_pairs, users, O.expanded_ouis(users, closure(t)))
    return P.resolve_tiers(t.rules, O.user_clearance(users, t.positions), matches).join(t.rules.select("entity_key", F.col("mask_style").alias("style"), F.col("mask_position").alias("position")), "entity_key")


def sound_documents(t, few):
    """Documents of ``few`` whose stored hash holds: of those in review it is an old one, uploaded ones have none yet."""
    chunks = t.chunk_vectors.join(few, "document_id", "left_semi").join(t.documents.select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id").select("document_id", F.sha2("text", 256).alias("chunk_hash"))
    hashes = version_content_hash(chunks, "document_id").join(t.docs.select("document_id", "status"), "document_id")
    stored = hashes.select("document_id", F.when(F.col("status") == "review", "old").when(F.col("status") != "uploaded", F.col("content_hash")).alias("stored_hash"))
    return verify_content(chunks, stored, "document_id").select("document_id").distinct()


@query("search_answers")
def _(t):
    """Search from the question to what the asker reads, in one call: scope, both engines, fusion, access, picked units, hashes, reranking, threshold, masks."""
    found = written(scoped_candidates(t))
    texts = t.documents.select(F.col("doc_id").alias("chunk_id"), "text").join(found.select("chunk_id").distinct(), "chunk_id", "left_semi").withColumn("entities", P.extract_entities(F.col("text")))
    rows = found.join(texts, "chunk_id").withColumn("score", R.display_score(F.col("semantic"), F.col("lexical"))).withColumn("ce", ce())
    picked = t.text_queries.join(t.assignments.where("oui_id like 'r%'"), "user_id").select("query_id", "oui_id")  # who sits at a region looks there
    few = found.select("document_id").distinct()
    shown = R.search_results(rows, t.document_oui, picked, sound_documents(t, few), asker_tiers(t, found), t.rules)
    return shown.select("query_id", "user_id", "chunk_id", "document_id", "score", "rwss", F.col("rank").cast("long").alias("rank"), "blurred", "restricted", "doc_restricted", "text", F.array_join("blocked", ",").alias("blocked"), F.array_join("required", ",").alias("required"), "decision")


@query("apply_policy_search")
def _(t):
    """What ``search`` returns, under the asker's policy: masked text, label sets, contract, doc_restricted."""
    hits = written(QUERIES["search"](t.spark, t.sf_dir).select("query_id", "user_id", "chunk_id", "document_id", F.col("restricted").alias("doc_restricted")))
    texts = t.documents.select(F.col("doc_id").alias("chunk_id"), "text").join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi")
    rows = hits.join(texts.withColumn("entities", P.extract_entities(F.col("text"))), "chunk_id")
    return P.apply_policy(rows, asker_tiers(t, hits), t.rules)
