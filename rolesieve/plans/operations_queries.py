"""Queries of table upkeep, jobs and traces, the knowledge graph and the e-mail collection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rolesieve import constants as K
from rolesieve.functions import text as X
from rolesieve.operators import graph as G
from rolesieve.operators import organisation as O
from rolesieve.operators import tables as D
from rolesieve.plans.organisation_queries import GRANTS, closure, granted, tuples
from rolesieve.plans.text_queries import _html
from rolesieve.plans.views import query
from rolesieve.sources.files import read_text_files


@query("read_text_files")
def _(t):
    """The documents as files of up to 1,000 texts, by source, written and then read as raw files; one row a file."""
    path = D.shared_path(t.spark)
    shelf = F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 1000).cast("string")).alias("shelf")
    t.documents.select("doc_id", "text", shelf).repartition("shelf").sortWithinPartitions("shelf", "doc_id").select("text", "shelf").write.partitionBy("shelf").text(path)
    texts, _ = read_text_files(t.spark, path)
    return texts.select(F.regexp_extract("path", "shelf=([^/]+)/", 1).alias("shelf"), "text", "page")


@query("embed_batches")
def _(t):
    return D.embed_batches(t.documents.select(F.col("doc_id").alias("id"), "text"), D.hashing_embedder())


@query("replace_version_chunks", "SELECT chunk_id, document_id, chunk_text FROM line_chunks WHERE document_id % 5 <> 0 UNION ALL SELECT concat('new-', doc_id), doc_id, lang FROM documents WHERE doc_id % 5 = 0")
def _(t):
    new = t.documents.where("doc_id % 5 = 0").select(F.concat(F.lit("new-"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("lang").alias("chunk_text"))
    old = t.line_chunks.where("document_id % 5 <> 0").select(*new.columns).unionByName(new.withColumn("chunk_text", F.lit("old")))
    return D.replace_version_chunks(old, new, "document_id")


@query("upsert_by_key", "SELECT user_id, event_type, max_by(value, event_id) AS value, max(event_id) AS seq FROM events GROUP BY ALL")
def _(t):
    e = t.events.select("user_id", "event_type", "value", F.col("event_id").alias("seq"))
    return D.upsert_by_key(e.where("seq % 2 = 0"), e.where("seq % 2 = 1"), ["user_id", "event_type"], "seq")


@query("flatten_metadata", "SELECT doc_id, lang, source, CASE WHEN n_chars > 500 THEN CAST(n_chars AS VARCHAR) END AS n_chars, concat('[\"', lang, '\",\"', source, '\"]') AS tags, 3 + (n_chars > 500)::INT AS keys FROM documents")
def _(t):
    m = D.flatten_metadata({"lang": F.col("lang"), "source": F.col("source"), "n_chars": F.when(F.col("n_chars") > 500, F.col("n_chars"))}, {"tags": F.array("lang", "source")})
    d = t.documents.select("doc_id", m.alias("m"))
    return d.select("doc_id", *[F.col("m")[k].alias(k) for k in ("lang", "source", "n_chars", "tags")], F.size("m").alias("keys"))


@query("patch_metadata", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS lang, source, CASE WHEN doc_id % 3 = 0 THEN 'yes' END AS seen FROM documents")
def _(t):
    p = t.documents.where("doc_id % 3 = 0").select("doc_id", F.create_map(F.lit("lang"), F.lit(None).cast("string"), F.lit("seen"), F.lit("yes")).alias("patch"))
    m = t.documents.select("doc_id", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("m")).join(p, "doc_id", "left")
    d = m.select("doc_id", D.patch_metadata(F.col("m"), F.col("patch")).alias("m"))
    return d.select("doc_id", *[F.col("m")[k].alias(k) for k in ("lang", "source", "seen")])


@query("delete_cascade", "SELECT 'versions' AS name, count(*) AS n FROM versions WHERE document_id % 4 <> 0 UNION ALL SELECT 'chunks', count(*) FROM chunk_vectors c JOIN versions v ON v.document_id = c.document_id AND v.version_no = 1 WHERE c.document_id % 4 <> 0")
def _(t):
    chunks = t.chunk_vectors.join(t.versions.where("version_no = 1"), "document_id").select("chunk_id", "version_id")
    kept = D.delete_cascade({"versions": t.versions, "chunks": chunks}, t.docs.where("document_id % 4 = 0").select("document_id"))
    return kept["versions"].agg(F.lit("versions").alias("name"), F.count("*").alias("n")).unionAll(kept["chunks"].agg(F.lit("chunks").alias("name"), F.count("*").alias("n")))


@query("build_vector_rows", "SELECT c.chunk_id, v.version_id, v.version_no, coalesce(CASE WHEN c.chunk_id % 3 > 0 THEN c.chunk_sensitivity END, d.sensitivity) AS chunk_sensitivity, d.title AS document_title, d.document_type, coalesce(o.ouis, '') AS oui_ids, coalesce(x.types, '') AS entity_types, concat('chunk ', c.chunk_id) AS document_text FROM chunk_vectors c JOIN (SELECT document_id, max(version_id) AS version_id, max(version_no) AS version_no FROM versions GROUP BY 1) v USING (document_id) JOIN docs d USING (document_id) LEFT JOIN (SELECT document_id, string_agg(DISTINCT oui_id, ',' ORDER BY oui_id) AS ouis FROM document_oui GROUP BY 1) o USING (document_id) LEFT JOIN (SELECT document_id, string_agg(label, ',' ORDER BY label) AS types FROM detections GROUP BY 1) x USING (document_id)")
def _(t):
    """Each vector under the last version of its document, with what was detected there."""
    v = t.versions.groupBy("document_id").agg(F.max("version_id").alias("version_id"), F.max("version_no").alias("version_no"))
    types = t.detections.groupBy("document_id").agg(F.array_sort(F.collect_list("label")).alias("entity_types"))
    chunks = t.chunk_vectors.join(v.select("document_id", "version_id"), "document_id").join(types, "document_id", "left").drop("document_id")
    level = F.when(F.col("chunk_id") % 3 > 0, F.col("chunk_sensitivity"))
    chunks = chunks.withColumn("chunk_sensitivity", level).withColumn("chunk_text", F.concat(F.lit("chunk "), F.col("chunk_id").cast("string"))).withColumn("embed_text", F.lit(None).cast("string"))
    return D.vector_rows(chunks, t.docs, v, t.document_oui).select("chunk_id", "version_id", "version_no", "chunk_sensitivity", "document_title", "document_type", "oui_ids", "entity_types", "document_text")


# jobs, traces, versions


@query("idempotent_jobs", "SELECT idempotency_key, min(job_id) AS job_id FROM jobs WHERE idempotency_key NOT IN (SELECT idempotency_key FROM jobs WHERE job_id % 97 = 0) GROUP BY 1")
def _(t):
    done = t.jobs.where("job_id % 97 = 0").select("idempotency_key").distinct()
    return t.jobs.join(done, "idempotency_key", "left_anti").groupBy("idempotency_key").agg(F.min("job_id").alias("job_id"))


@query("job_listing", "SELECT j.job_id, j.status, d.title, v.version_no FROM jobs j LEFT JOIN docs d USING (document_id) LEFT JOIN (SELECT document_id, max(version_no) AS version_no FROM versions GROUP BY 1) v USING (document_id) ORDER BY j.created_at DESC, j.job_id DESC LIMIT 200")
def _(t):
    v = t.versions.groupBy("document_id").agg(F.max("version_no").alias("version_no"))
    best = t.jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(200)
    return best.join(t.docs.select("document_id", "title"), "document_id", "left").join(v, "document_id", "left").select("job_id", "status", "title", "version_no")


@query("trace_listing", "SELECT trace_id, user_id, total_ms FROM traces ORDER BY created_at DESC, trace_id DESC LIMIT 200")
def _(t):
    return t.traces.orderBy(F.desc("created_at"), F.desc("trace_id")).limit(200).select("trace_id", "user_id", "total_ms")


@query("trace_breakdown", "SELECT trace_id, k AS step, CAST(json_extract_string(timings_json, '$.' || k) AS BIGINT) AS ms FROM (SELECT trace_id, timings_json, unnest(json_keys(timings_json)) AS k FROM traces)")
def _(t):
    return t.traces.select("trace_id", F.explode(F.from_json("timings_json", "map<string,bigint>")).alias("step", "ms"))


@query("step_durations", "SELECT o_orderpriority AS step, count(*) AS n, avg(d) AS mean_days FROM (SELECT o_orderpriority, date_diff('day', o_orderdate, l_shipdate) AS d FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY 1")
def _(t):
    j = t.orders.join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate"), "o_orderkey").select(F.col("o_orderpriority").alias("step"), F.datediff("l_shipdate", "o_orderdate").alias("d"))
    return j.groupBy("step").agg(F.count("*").alias("n"), F.avg("d").alias("mean_days"))


@query("pending_reviews", "SELECT document_id, status, count(*) OVER (PARTITION BY status) AS n FROM docs WHERE status IN ('review', 'uploaded')")
def _(t):
    p = t.docs.where(F.col("status").isin("review", "uploaded"))
    return p.join(F.broadcast(p.groupBy("status").agg(F.count("*").alias("n"))), "status").select("document_id", "status", "n")


@query("latest_version", "SELECT d.document_id, coalesce(max(v.version_no), 0) + 1 AS next_version_no, max_by(v.version_id, v.version_no) AS latest FROM docs d LEFT JOIN versions v USING (document_id) GROUP BY 1")
def _(t):
    v = t.versions.groupBy("document_id").agg((F.max("version_no") + 1).alias("next"), F.max_by("version_id", "version_no").alias("latest"))
    return t.docs.join(v, "document_id", "left").select("document_id", F.coalesce("next", F.lit(1)).alias("next_version_no"), "latest")


@query("entity_configurations", "SELECT v.version_id, d.title, string_agg(concat(r.entity_key, '=', r.action), ',' ORDER BY r.entity_key) AS actions FROM versions v JOIN docs d USING (document_id) JOIN detections x USING (document_id) JOIN rules r ON r.entity_key = x.label GROUP BY ALL")
def _(t):
    a = t.detections.join(F.broadcast(t.rules.select(F.col("entity_key").alias("label"), "action")), "label").groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("label", F.lit("="), "action"))), ",").alias("actions"))
    return t.versions.join(t.docs.select("document_id", "title"), "document_id").join(a, "document_id").select("version_id", "title", "actions")


_events = "ev AS (SELECT document_id, d.status, owner_user_id, CASE document_id % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'submit' WHEN 2 THEN 'reject' ELSE 'ingested' END AS event, CASE WHEN document_id % 8 < 4 THEN owner_user_id ELSE 100 END AS user_id FROM docs d), corp AS (SELECT DISTINCT user_id FROM assignments WHERE oui_id = 'corp'), wait AS (SELECT document_id, arg_max(job_id, (created_at, job_id)) AS job FROM jobs WHERE status = 'queued' GROUP BY 1)"


@query("review_transitions", f"WITH {_events}, judged AS (SELECT ev.*, c.user_id IS NOT NULL AS corp, CASE WHEN event IN ('approve', 'reject') AND c.user_id IS NULL THEN 'role' WHEN event = 'submit' AND ev.user_id <> owner_user_id THEN 'owner' WHEN event = 'submit' AND status <> 'uploaded' THEN 'status' WHEN event IN ('approve', 'reject') AND status NOT IN ('review', 'uploaded') THEN 'status' END AS problem FROM ev LEFT JOIN corp c ON c.user_id = ev.user_id), done AS (SELECT *, CASE WHEN problem IS NOT NULL THEN status WHEN event = 'reject' THEN 'draft' WHEN event = 'approve' OR corp OR (event = 'ingested' AND status = 'approved') THEN 'approved' ELSE 'review' END AS new FROM judged), moved AS (SELECT *, CASE WHEN problem IS NOT NULL THEN NULL WHEN event = 'reject' THEN 'cancelled' WHEN event IN ('approve', 'submit') AND new = 'approved' THEN 'queued' END AS m FROM done) SELECT document_id, event, user_id, new AS status, problem, CASE WHEN m IS NOT NULL THEN job END AS job_id, CASE WHEN job IS NOT NULL THEN m END AS job_status, CASE WHEN job IS NOT NULL AND m = 'cancelled' THEN 'Rejected by reviewer' END AS job_error FROM moved LEFT JOIN wait USING (document_id)")
def _(t):
    """One event on each document by its owner or by a corporate user; queued jobs are those that wait for approval."""
    k, d = F.col("document_id") % 4, F.col("document_id")
    event = F.when(k == 0, "approve").when(k == 1, "submit").when(k == 2, "reject").otherwise("ingested")
    events = t.docs.select("document_id", event.alias("event"), F.when(d % 8 < 4, F.col("owner_user_id")).otherwise(100).cast("long").alias("user_id"))
    jobs = t.jobs.withColumn("status", F.when(F.col("status") == "queued", "pending_approval").otherwise(F.col("status")))
    return D.review_transitions(t.docs, events, jobs, t.assignments.where("oui_id = 'corp'"))


@query("emit_ingest_events", "SELECT document_id, kind, concat('{\"document_id\":', document_id, ',\"chunk_count\":', n, '}') AS payload FROM (SELECT document_id, count(*) AS n FROM line_chunks GROUP BY 1) CROSS JOIN (SELECT unnest(['outbox', 'audit']) AS kind)")
def _(t):
    n = t.line_chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    return n.select("document_id", F.explode(F.array(F.lit("outbox"), F.lit("audit"))).alias("kind"), F.to_json(F.struct("document_id", "chunk_count")).alias("payload"))


@query("document_listing", f"{GRANTS}, v AS ({granted('viewer', 'editor')}), o AS (SELECT document_id, string_agg(DISTINCT oui_id, ',' ORDER BY oui_id) AS ouis FROM document_oui GROUP BY 1), n AS (SELECT document_id, count(*) AS versions FROM versions GROUP BY 1) SELECT v.user_id, d.document_id, d.title, o.ouis, c.c_name AS owner, n.versions FROM v JOIN docs d USING (document_id) LEFT JOIN o USING (document_id) LEFT JOIN n USING (document_id) LEFT JOIN customer c ON c.c_custkey = d.owner_user_id")
def _(t):
    from rolesieve.operators import organisation as O

    o = t.document_oui.groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set("oui_id")), ",").alias("ouis"))
    n = t.versions.groupBy("document_id").agg(F.count("*").alias("versions"))
    names = t.customer.select(F.col("c_custkey").alias("owner_user_id"), F.col("c_name").alias("owner"))
    d = t.docs.select("document_id", "title", "owner_user_id").join(o, "document_id", "left").join(n, "document_id", "left").join(names, "owner_user_id", "left")
    d = d.select("document_id", "title", "ouis", "owner", "versions")
    return O.viewable_documents(tuples(t), t.assignments, t.positions, closure(t), d)


# the knowledge graph

NODES = "nodes AS (SELECT 'org_unit' AS kind, CAST(ou_id AS VARCHAR) AS id, name AS label FROM oui_type UNION ALL SELECT 'instance', oui_id, name FROM oui UNION ALL SELECT 'position', concat(p.position_id, '@', o.oui_id), concat('p', p.clearance, ' (', o.name, ')') FROM positions p JOIN oui o USING (ou_id) UNION ALL SELECT 'rule', entity_key, entity_key FROM rules)"
EDGES = "edges AS (SELECT DISTINCT 'IS_A' AS type, oui_id AS src, CAST(ou_id AS VARCHAR) AS dst FROM oui UNION SELECT 'BELONGS_TO', oui_id, parent_oui_id FROM oui_parents UNION SELECT 'IS_A_ROLE_OF', concat(p.position_id, '@', o.oui_id), o.oui_id FROM positions p JOIN oui o USING (ou_id))"


def position_instances(t):
    """Each position at every unit of its kind."""
    return t.positions.join(t.oui, "ou_id").select(F.concat(F.col("position_id").cast("string"), F.lit("@"), "oui_id").alias("id"), F.concat(F.lit("p"), F.col("clearance").cast("string"), F.lit(" ("), "name", F.lit(")")).alias("label"), "oui_id", "position_id")


def nodes(t):
    n = lambda df, kind, i, label: df.select(F.lit(kind).alias("kind"), F.col(i).cast("string").alias("id"), F.col(label).alias("label"))
    parts = [n(t.oui_type, "org_unit", "ou_id", "name"), n(t.oui, "instance", "oui_id", "name"), n(position_instances(t), "position", "id", "label"), n(t.rules, "rule", "entity_key", "entity_key")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


def edges(t):
    e = lambda df, kind, a, b: df.select(F.lit(kind).alias("type"), a.cast("string").alias("src"), b.cast("string").alias("dst"))
    made = e(t.oui, "IS_A", F.col("oui_id"), F.col("ou_id")).unionAll(e(t.oui_parents, "BELONGS_TO", F.col("oui_id"), F.col("parent_oui_id"))).unionAll(e(position_instances(t), "IS_A_ROLE_OF", F.col("id"), F.col("oui_id")))
    known = nodes(t).select("id").distinct()
    return made.distinct().join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")


@query("position_instances", "SELECT concat(p.position_id, '@', o.oui_id) AS id, concat('p', p.clearance, ' (', o.name, ')') AS label FROM positions p JOIN oui o USING (ou_id)")
def _(t):
    return position_instances(t).select("id", "label")


@query("graph_nodes", f"WITH {NODES} SELECT * FROM nodes")
def _(t):
    return nodes(t)


@query("graph_edges", f"WITH {EDGES} SELECT type, src, dst FROM edges")
def _(t):
    return edges(t).select("type", "src", "dst")


@query("applies_to_edges", "SELECT DISTINCT entity_key, CASE WHEN oui_id = '__ALL__' THEN 'scope:root' WHEN position_id IS NOT NULL AND oui_id IS NOT NULL THEN concat(position_id, '@', oui_id) ELSE oui_id END AS target FROM rule_pairs WHERE oui_id IS NOT NULL UNION SELECT p.entity_key, concat(p.position_id, '@', o.oui_id) FROM rule_pairs p JOIN positions q USING (position_id) JOIN oui o USING (ou_id) WHERE p.oui_id IS NULL")
def _(t):
    p, u, r = t.rule_pairs, F.col("oui_id"), F.col("position_id")
    everyone = p.where(u == "__ALL__").select("entity_key", F.lit("scope:root").alias("target"))
    rest = p.where(~u.eqNullSafe("__ALL__"))
    both = rest.where(u.isNotNull() & r.isNotNull()).select("entity_key", F.concat(r.cast("string"), F.lit("@"), u).alias("target"))
    unit = rest.where(u.isNotNull() & r.isNull()).select("entity_key", u.alias("target"))
    role = rest.where(u.isNull()).select("entity_key", "position_id").join(position_instances(t).select("position_id", F.col("id").alias("target")), "position_id").select("entity_key", "target")
    return everyone.unionAll(both).unionAll(unit).unionAll(role).distinct()


@query("contains_edges", "SELECT DISTINCT d.document_type, x.label FROM detections x JOIN docs d USING (document_id)")
def _(t):
    return t.detections.select("document_id", "label").join(t.docs.select("document_id", "document_type"), "document_id").select("document_type", "label").distinct()


@query("topo_levels", f"WITH RECURSIVE walk AS (SELECT oui_id AS id, 1 AS d FROM oui_parents UNION SELECT p.oui_id, w.d + 1 FROM walk w JOIN oui_parents p ON p.parent_oui_id = w.id) SELECT o.oui_id, coalesce(max(d), 0) AS level FROM oui o LEFT JOIN walk w ON w.id = o.oui_id GROUP BY 1")
def _(t):
    return O.topo_levels(t.oui, t.oui_parents)


@query("validate_edges", f"WITH {EDGES}, {NODES}, k AS (SELECT e.*, a.kind AS ka, b.kind AS kb FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst) SELECT type, src, dst FROM k WHERE (ka, kb, type) IN (('instance', 'org_unit', 'IS_A'), ('position', 'instance', 'IS_A_ROLE_OF'))")
def _(t):
    allowed = t.spark.createDataFrame([("instance", "org_unit", "IS_A"), ("position", "instance", "IS_A_ROLE_OF")], "ka string, kb string, type string")
    n = nodes(t)
    k = edges(t).join(n.select(F.col("id").alias("src"), F.col("kind").alias("ka")), "src").join(n.select(F.col("id").alias("dst"), F.col("kind").alias("kb")), "dst")
    return k.join(F.broadcast(allowed), ["ka", "kb", "type"], "left_semi").select("type", "src", "dst")


@query("scope_edit_back", "WITH e AS (SELECT event_id, user_id % 20 AS rule, concat('n', event_id % 25) AS target, event_type <> 'click' AS adds FROM events), last AS (SELECT rule, target, max_by(adds, event_id) AS adds FROM e GROUP BY ALL) SELECT rule, string_agg(target, ',' ORDER BY target) AS scope FROM last WHERE adds GROUP BY 1")
def _(t):
    e = t.events.select("event_id", (F.col("user_id") % 20).alias("rule"), F.concat(F.lit("n"), (F.col("event_id") % 25).cast("string")).alias("target"), (F.col("event_type") != "click").alias("adds"))
    last = e.groupBy("rule", "target").agg(F.max_by("adds", "event_id").alias("adds")).where("adds")
    return last.groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("target")), ",").alias("scope"))


@query("taxonomy_seed", f"WITH static(name, category, type) AS (VALUES {', '.join('(' + ', '.join(chr(39) + x + chr(39) for x in r) + ')' for r in K.STATIC_NODES)}), static_edges(src, rel, dst) AS (VALUES {', '.join('(' + ', '.join(chr(39) + x + chr(39) for x in r) + ')' for r in K.STATIC_EDGES)}), e AS (SELECT src, string_agg(concat(rel, ' ', dst), ',' ORDER BY rel, dst) AS edges FROM static_edges GROUP BY 1), n AS (SELECT document_type, count(*) AS documents FROM docs GROUP BY 1) SELECT name, category, static.type, coalesce(edges, '') AS edges, coalesce(documents, 0) AS documents FROM static LEFT JOIN e ON src = name LEFT JOIN n ON document_type = name")
def _(t):
    """Every node and edge of the taxonomy, with the number of documents of each type."""
    nodes, edges = G.taxonomy(t.spark)
    e = edges.groupBy(F.col("src").alias("name")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "type", "dst"))), ",").alias("edges"))
    n = t.docs.groupBy(F.col("document_type").alias("name")).agg(F.count("*").alias("documents"))
    return nodes.join(e, "name", "left").join(n, "name", "left").select("name", "category", "type", F.coalesce("edges", F.lit("")).alias("edges"), F.coalesce("documents", F.lit(0)).alias("documents"))


@query("graph_export", f"WITH {NODES}, {EDGES} SELECT n.id, n.kind, e.type, e.dst FROM nodes n LEFT JOIN edges e ON e.src = n.id")
def _(t):
    return nodes(t).join(edges(t).withColumnRenamed("src", "id"), "id", "left").select("id", "kind", "type", "dst")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + x + "'" for x in r) + ")" for r in rows)


_tier_case = lambda i: " ".join(f"WHEN '{t}' THEN '{n[i]}'" for t, n in K.TIER_NODES.items())
#: The graph was synced once with the mask scopes alone and without the users in debt, then with all tables.
SYNCED = f"""static(name, category, type) AS (VALUES {_values(K.STATIC_NODES)}), static_edges(src, type, dst) AS (VALUES {_values(K.STATIC_EDGES)}),
seats AS (SELECT concat(p.position_id, ':', o.oui_id) AS seat, p.position_id, o.oui_id, concat('p', p.clearance, ' (', o.name, ')') AS name FROM positions p JOIN oui o USING (ou_id)),
every AS (SELECT entity_key, bool_or(tier = 'allow' AND coalesce(oui_id, '') = '__ALL__') AS everyone FROM rule_pairs GROUP BY 1),
tiers AS (SELECT DISTINCT entity_key, tier, concat(entity_key, ':', tier) AS source FROM rule_pairs JOIN every USING (entity_key) WHERE tier = 'allow' OR NOT everyone),
graph_nodes AS (
  SELECT 'static' AS kind, name AS source, name, category, type, true AS old FROM static
  UNION ALL SELECT 'entity_policy_rule', entity_key, entity_key, 'Entity', 'EntityInstance', true FROM rules
  UNION ALL SELECT 'entity_policy_rule_tier', source, CASE tier {_tier_case(0)} END, 'Policy', 'PolicyInstance', tier = 'mask' FROM tiers
  UNION ALL SELECT 'org_unit', CAST(ou_id AS VARCHAR), name, 'Organization', 'OrgUnitType', true FROM oui_type
  UNION ALL SELECT 'org_unit_scope', concat(ou_id, ':scope'), concat(name, 'Scope'), 'Scope', 'ScopeClass', true FROM oui_type
  UNION ALL SELECT 'org_unit_instance', oui_id, name, 'Organization', 'OrgUnitInstance', true FROM oui
  UNION ALL SELECT 'position_instance', seat, name, 'Scope', 'PositionInstance', true FROM seats
  UNION ALL SELECT 'user_assignment', concat(user_id, ':', oui_id), c_name, 'Employee', 'Employee', c_acctbal >= 0 FROM assignments JOIN customer ON c_custkey = user_id),
graph_edges AS (
  SELECT 'static' AS src_kind, src, type, 'static' AS dst_kind, dst FROM static_edges
  UNION SELECT 'entity_policy_rule', entity_key, 'IS_A', 'static', CASE sensitivity {" ".join(f"WHEN {i + 1} THEN '{c}'" for i, c in enumerate(K.ENTITY_CLASSES))} ELSE 'PublicEntity' END FROM rules
  UNION SELECT 'entity_policy_rule', entity_key, 'PROTECTED_BY', 'entity_policy_rule_tier', source FROM tiers
  UNION SELECT 'entity_policy_rule_tier', source, 'IS_A', 'static', CASE tier {_tier_case(1)} END FROM tiers
  UNION SELECT 'entity_policy_rule_tier', source, 'GRANTS', 'static', CASE tier {_tier_case(2)} END FROM tiers
  UNION SELECT 'entity_policy_rule_tier', source, 'APPLIES_TO', 'static', 'Scope' FROM tiers JOIN every USING (entity_key) JOIN rule_pairs p USING (entity_key, tier) WHERE p.oui_id = '__ALL__' OR everyone
  UNION SELECT 'entity_policy_rule_tier', source, 'APPLIES_TO', 'position_instance', seat FROM tiers JOIN every USING (entity_key) JOIN rule_pairs p USING (entity_key, tier) JOIN seats s ON s.position_id = p.position_id AND (p.oui_id IS NULL OR s.oui_id = p.oui_id) WHERE NOT (everyone AND tier = 'allow')
  UNION SELECT 'entity_policy_rule_tier', source, 'APPLIES_TO', 'org_unit_instance', p.oui_id FROM tiers JOIN every USING (entity_key) JOIN rule_pairs p USING (entity_key, tier) JOIN oui o USING (oui_id) WHERE p.position_id IS NULL AND NOT (everyone AND tier = 'allow')
  UNION SELECT 'org_unit', CAST(ou_id AS VARCHAR), 'IS_A', CASE WHEN parent_id IS NULL THEN 'static' ELSE 'org_unit' END, coalesce(CAST(parent_id AS VARCHAR), 'Enterprise') FROM oui_type
  UNION SELECT 'org_unit_scope', concat(ou_id, ':scope'), 'IS_A', 'static', 'Scope' FROM oui_type
  UNION SELECT 'org_unit_instance', oui_id, 'IS_A', 'org_unit', CAST(ou_id AS VARCHAR) FROM oui
  UNION SELECT 'org_unit_instance', oui_id, 'IS_A', 'org_unit_scope', concat(ou_id, ':scope') FROM oui
  UNION SELECT 'org_unit_instance', oui_id, 'BELONGS_TO', 'org_unit_instance', parent_oui_id FROM oui_parents
  UNION SELECT 'position_instance', seat, 'IS_A_ROLE_OF', 'org_unit_instance', oui_id FROM seats
  UNION SELECT 'position_instance', seat, 'IS_A', 'static', 'RoleScope' FROM seats
  UNION SELECT 'user_assignment', concat(user_id, ':', a.oui_id), 'IS_A', 'position_instance', seat FROM assignments a JOIN seats s ON s.position_id = a.position_id AND s.oui_id = a.oui_id
  UNION SELECT 'static', document_type, 'CONTAINS', 'entity_policy_rule', entity_key FROM detections JOIN docs USING (document_id) JOIN rules ON entity_key = label JOIN static ON name = document_type)"""


def wanted_graph(t, pairs, users):
    """The graph that the tables ask for, with the given scope pairs and users (user_id, name)."""
    contained = t.detections.join(t.docs.select("document_id", "document_type"), "document_id").select("document_type", F.col("label").alias("entity_key")).distinct()
    seats = t.positions.select("position_id", "ou_id", F.concat(F.lit("p"), F.col("clearance").cast("string")).alias("name"))
    return G.wanted_graph(t.oui_type, t.oui, t.oui_parents, seats, t.rules.select("entity_key", F.col("entity_key").alias("name"), "sensitivity"), pairs, t.assignments.join(users, "user_id"), contained)


def synced_graph(t):
    """Two syncs, written in between as a job would."""
    users = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), "c_acctbal")
    day = lambda d: F.lit(f"2024-01-0{d} 00:00:00").cast("timestamp_ntz")
    first = G.sync_graph(None, None, wanted_graph(t, t.rule_pairs.where("tier = 'mask'"), users.where("c_acctbal >= 0")), day(1))
    return G.sync_graph(*map(D.written, first), wanted_graph(t, t.rule_pairs, users), day(2))


@query("sync_graph_nodes", f"WITH {SYNCED} SELECT kind, source, name, category, type, CASE WHEN old THEN TIMESTAMP '2024-01-01 00:00:00' ELSE TIMESTAMP '2024-01-02 00:00:00' END AS created_at FROM graph_nodes")
def _(t):
    return synced_graph(t)[0].select("kind", "source", "name", "category", "type", "created_at")


@query("sync_graph_edges", f"WITH {SYNCED} SELECT * FROM graph_edges")
def _(t):
    return synced_graph(t)[1].select(*G.EDGE)


# e-mail


@query("new_emails", "SELECT message_id, user_id FROM emails WHERE NOT synced")
def _(t):
    return D.new_emails(t.emails.select("message_id", "user_id"), t.emails.where("synced"), t.embeddings)


@query("new_emails_reset", "SELECT message_id, user_id FROM emails")
def _(t):
    """With an empty index every message is new."""
    return D.new_emails(t.emails.select("message_id", "user_id"), t.emails.where("synced"), t.embeddings.where("vec_id < 0"))


@query("extract_body", "SELECT message_id, mime, body FROM (SELECT message_id, CASE WHEN message_id % 2 = 0 THEN 'text/plain' ELSE 'text/html' END AS mime, CASE WHEN message_id % 2 = 0 THEN subject ELSE body_html END AS body FROM emails)")
def _(t):
    part = lambda m, d: F.struct(F.lit(m).alias("mime"), F.translate(F.base64(F.encode(d, "UTF-8")), "+/", "-_").alias("data"))
    parts = F.when(F.col("message_id") % 2 == 0, F.array(part("text/html", F.col("body_html")), part("text/plain", F.col("subject")))).otherwise(F.array(part("text/html", F.col("body_html"))))
    e = t.emails.select("message_id", parts.alias("parts"))
    of = lambda m: F.filter("parts", lambda p: p["mime"] == m)
    best = F.coalesce(F.get(of("text/plain"), F.lit(0)), F.get(of("text/html"), F.lit(0)))
    return e.select("message_id", best["mime"].alias("mime"), F.decode(F.unbase64(F.translate(best["data"], "-_", "+/")), "UTF-8").alias("body"))


@query("email_rows", rf"SELECT concat('gmail_', user_id, '_', message_id) AS id, 2 AS sensitivity, substr(concat('Subject: ', subject, chr(10), chr(10), regexp_replace(regexp_replace(regexp_replace({_html}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')), 1, 8000) AS text FROM emails")
def _(t):
    text = F.concat(F.lit("Subject: "), "subject", F.lit("\n\n"), X.strip_html(F.col("body_html")))
    return t.emails.select(F.concat(F.lit("gmail_"), F.col("user_id").cast("string"), F.lit("_"), F.col("message_id").cast("string")).alias("id"), F.lit(2).alias("sensitivity"), F.substring(text, 1, 8000).alias("text"))


@query("purge_user_emails", "SELECT message_id FROM emails WHERE NOT (starts_with(concat('gmail_', user_id, '_', message_id), 'gmail_7_') OR message_id % 10 = 0)")
def _(t):
    known = t.emails.where("message_id % 10 = 0").select("message_id")
    key = F.concat(F.lit("gmail_"), F.col("user_id").cast("string"), F.lit("_"), F.col("message_id").cast("string"))
    return t.emails.join(known, "message_id", "left_anti").where(~key.startswith("gmail_7_")).select("message_id")
