"""Queries of the organisation graph, document access and access requests."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from rolesieve.operators import organisation as O
from rolesieve.plans.views import query

CLOSURE = "closure AS (SELECT oui_id AS descendant, parent_oui_id AS ancestor FROM oui_parents UNION SELECT c.descendant, p.parent_oui_id FROM closure c JOIN oui_parents p ON c.ancestor = p.oui_id)"
RC = f"WITH RECURSIVE {CLOSURE}"
ROOTS = "up AS (SELECT oui_id, min(parent_oui_id) AS parent FROM oui_parents GROUP BY 1), chain AS (SELECT oui_id, parent AS node, 1 AS d FROM up UNION ALL SELECT c.oui_id, u.parent, d + 1 FROM chain c JOIN up u ON u.oui_id = c.node), roots AS (SELECT oui_id, max_by(node, d) AS root FROM chain GROUP BY 1)"
CLEAR = "clear AS (SELECT user_id, greatest(1, max(clearance)) AS clearance FROM assignments a LEFT JOIN positions p USING (position_id) GROUP BY 1)"
TUPLES = """at_unit AS (SELECT o.document_id, o.oui_id, d.sensitivity FROM document_oui o JOIN docs d USING (document_id)),
raw AS (SELECT concat('user:', owner_user_id) AS subject, 'owner' AS relation, document_id, 1 AS required FROM docs
 UNION ALL SELECT concat('oui:', oui_id, '#member'), 'viewer', document_id, least(sensitivity, 5) FROM at_unit
 UNION ALL SELECT concat('oui:', parent_oui_id, '#ancestor_member'), 'viewer', document_id, least(sensitivity, 5) FROM at_unit JOIN oui_parents USING (oui_id)
 UNION ALL SELECT concat('oui:', root, '#member'), 'editor', document_id, least(sensitivity, 5) FROM at_unit JOIN roots USING (oui_id)
 UNION ALL SELECT concat('oui:', descendant, '#member'), 'viewer', document_id, 1 FROM at_unit JOIN closure ON oui_id = ancestor WHERE sensitivity = 1),
tuples AS (SELECT subject, relation, document_id, min(required) AS required FROM raw GROUP BY ALL)"""
SUBJECTS = """subjects AS (SELECT user_id, concat('oui:', oui_id, '#member') AS subject FROM assignments UNION SELECT user_id, concat('oui:', oui_id, '#ancestor_member') FROM assignments
 UNION SELECT user_id, concat('oui:', descendant, '#ancestor_member') FROM assignments JOIN closure ON oui_id = ancestor)"""
GRANTS = f"{RC}, {ROOTS}, {CLEAR}, {TUPLES}, {SUBJECTS}, owned AS (SELECT owner_user_id AS user_id, document_id FROM docs)"


def granted(*relations: str) -> str:
    names = ", ".join(f"'{r}'" for r in relations)
    return f"SELECT user_id, document_id FROM owned UNION SELECT s.user_id, t.document_id FROM tuples t JOIN subjects s USING (subject) JOIN clear c USING (user_id) WHERE t.relation IN ({names}) AND c.clearance >= t.required"


AS_OF = "2024-01-20 00:00:00"
LATEST = "latest AS (SELECT * FROM access_requests QUALIFY row_number() OVER (PARTITION BY user_id, document_id ORDER BY created_at DESC, request_id DESC) = 1)"
MAXSENS = "maxsens AS (SELECT document_id, max(coalesce(chunk_sensitivity, 1)) AS level FROM chunk_vectors GROUP BY 1)"


def closure(t):
    return O.org_closure(t.oui_parents)


def tuples(t):
    return O.document_tuples(t.docs, t.document_oui, t.oui_parents, closure(t), O.org_root(t.oui_parents))


@query("org_closure", f"{RC} SELECT descendant, ancestor FROM closure")
def _(t):
    return closure(t)


@query("org_root", f"WITH RECURSIVE {ROOTS} SELECT oui_id, root FROM roots")
def _(t):
    return O.org_root(t.oui_parents)


@query("assignment_conflicts", f"""{RC}, two AS (SELECT user_id, oui_id, position_id FROM assignments UNION ALL SELECT user_id, concat('r', user_id % 5), position_id FROM assignments WHERE user_id % 3 = 0)
SELECT DISTINCT a.user_id, a.oui_id, b.oui_id AS other_oui_id, 'branch' AS reason FROM two a JOIN two b USING (user_id) JOIN closure c ON c.descendant = a.oui_id AND c.ancestor = b.oui_id
UNION ALL SELECT user_id, oui_id, NULL, 'kind' FROM two JOIN oui USING (oui_id) JOIN positions p USING (position_id) WHERE oui.ou_id <> p.ou_id""")
def _(t):
    more = t.assignments.where("user_id % 3 = 0").select("user_id", F.concat(F.lit("r"), (F.col("user_id") % 5).cast("string")).alias("oui_id"), "position_id")
    return O.assignment_conflicts(t.assignments.unionByName(more), closure(t), t.oui, t.positions)


@query("user_branch_ouis", f"{RC} SELECT user_id, oui_id FROM assignments UNION SELECT user_id, descendant FROM assignments JOIN closure ON oui_id = ancestor UNION SELECT user_id, ancestor FROM assignments JOIN closure ON oui_id = descendant")
def _(t):
    return O.user_branch_ouis(t.assignments, closure(t))


@query("expanded_ouis", f"{RC} SELECT user_id, oui_id FROM assignments UNION SELECT user_id, descendant FROM assignments JOIN closure ON oui_id = ancestor")
def _(t):
    return O.expanded_ouis(t.assignments, closure(t))


@query("documents_in_ouis", "SELECT DISTINCT document_id FROM document_oui WHERE oui_id IN (SELECT oui_id FROM oui WHERE ou_id = 2)")
def _(t):
    return t.document_oui.join(t.oui.where("ou_id = 2"), "oui_id", "left_semi").select("document_id").distinct()


@query("document_tuples", f"{RC}, {ROOTS}, {TUPLES} SELECT * FROM tuples")
def _(t):
    return tuples(t)


@query("membership_tuples", "SELECT DISTINCT concat('user:', user_id) AS subject, 'member' AS relation, concat('oui:', oui_id) AS object FROM assignments")
def _(t):
    return O.membership_tuples(t.assignments)


@query("viewable_documents", f"{GRANTS} {granted('viewer', 'editor')}")
def _(t):
    return O.viewable_documents(tuples(t), t.assignments, t.positions, closure(t))


@query("editable_documents", f"{GRANTS} {granted('editor')}")
def _(t):
    return O.editable_documents(tuples(t), t.assignments, t.positions, closure(t))


@query("visible_documents", f"{GRANTS}, v AS ({granted('viewer', 'editor')}) SELECT v.user_id, v.document_id, d.sensitivity = 1 AS is_public, d.owner_user_id = v.user_id AS is_owner FROM v JOIN docs d USING (document_id) UNION ALL SELECT NULL, document_id, true, false FROM docs WHERE sensitivity = 1")
def _(t):
    """Public documents are one row for all users (null user), never crossed with them."""
    d = t.docs.select("document_id", "sensitivity", "owner_user_id")
    seen = O.viewable_documents(tuples(t), t.assignments, t.positions, closure(t), d).select("user_id", "document_id", (F.col("sensitivity") == 1).alias("is_public"), (F.col("owner_user_id") == F.col("user_id")).alias("is_owner"))
    return seen.unionByName(d.where("sensitivity = 1").select(F.lit(None).cast("long").alias("user_id"), "document_id", F.lit(True).alias("is_public"), F.lit(False).alias("is_owner")))


@query("user_clearance", f"WITH {CLEAR} SELECT user_id, clearance FROM clear")
def _(t):
    return O.user_clearance(t.assignments, t.positions)


@query("user_profile", "SELECT user_id, greatest(1, max(clearance)) AS clearance, bool_or(k.parent_id IS NULL) AS is_corp, string_agg(DISTINCT o.name, ',' ORDER BY o.name) AS units FROM assignments JOIN positions p USING (position_id) JOIN oui o USING (oui_id) JOIN oui_type k ON k.ou_id = o.ou_id GROUP BY user_id")
def _(t):
    return O.user_profile(t.assignments, t.positions, t.oui, t.oui_type)


@query("active_grants", f"SELECT DISTINCT user_id, document_id FROM access_requests WHERE status = 'approved' AND (expires_at IS NULL OR expires_at > TIMESTAMP '{AS_OF}')")
def _(t):
    return O.active_grants(t.access_requests, AS_OF)


@query("expire_grants", f"SELECT request_id, CASE WHEN status = 'approved' AND expires_at <= TIMESTAMP '{AS_OF}' THEN 'revoked' ELSE status END AS status, CASE WHEN status = 'approved' AND expires_at <= TIMESTAMP '{AS_OF}' THEN TIMESTAMP '{AS_OF}' END AS resolved_at FROM access_requests")
def _(t):
    return O.expire_grants(t.access_requests, AS_OF).select("request_id", "status", "resolved_at")


@query("latest_request_status", f"WITH {LATEST} SELECT user_id, document_id, request_id, status FROM latest")
def _(t):
    return O.latest_request_status(t.access_requests).select("user_id", "document_id", "request_id", "status")


_want = "WITH r AS (SELECT event_id AS id, user_id, event_id % 40 AS document_id, event_type AS status, CASE event_id % 3 WHEN 0 THEN ['email'] WHEN 1 THEN ['email', 'phone'] ELSE ['money'] END AS types FROM events)"


def _type_requests(t):
    e = F.col("event_id") % 3
    types = F.when(e == 0, F.array(F.lit("email"))).when(e == 1, F.array(F.lit("email"), F.lit("phone"))).otherwise(F.array(F.lit("money")))
    return t.events.select(F.col("event_id").alias("id"), "user_id", (F.col("event_id") % 40).alias("document_id"), F.col("event_type").alias("status"), types.alias("types"))


@query("pending_overlap", f"{_want} SELECT DISTINCT n.id FROM r n JOIN r p USING (user_id, document_id) WHERE n.status = 'signup' AND p.status = 'click' AND list_has_any(n.types, p.types)")
def _(t):
    r = _type_requests(t)
    p = r.where("status = 'click'").select("user_id", "document_id", F.col("types").alias("pending"))
    return r.where("status = 'signup'").join(p, ["user_id", "document_id"]).where(F.arrays_overlap("types", "pending")).select("id").distinct()


@query("granted_entity_types", f"{_want} SELECT user_id, document_id, array_to_string(list_sort(list_distinct(flatten(list(types)))), ',') AS types FROM r WHERE status = 'purchase' GROUP BY ALL")
def _(t):
    return _type_requests(t).where("status = 'purchase'").groupBy("user_id", "document_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))), ",").alias("types"))


@query("max_chunk_sensitivity", f"WITH {MAXSENS} SELECT * FROM maxsens")
def _(t):
    return max_sens(t)


def max_sens(t):
    return t.chunk_vectors.groupBy("document_id").agg(F.max(F.coalesce("chunk_sensitivity", F.lit(1))).alias("level"))


@query("access_status", f"WITH {LATEST}, {CLEAR}, {MAXSENS} SELECT l.user_id, l.document_id, m.level > coalesce(c.clearance, 1) AND d.owner_user_id <> l.user_id AS above, l.status, CASE WHEN l.status = 'approved' THEN l.expires_at END AS approved_until FROM latest l JOIN docs d USING (document_id) JOIN maxsens m USING (document_id) LEFT JOIN clear c USING (user_id)")
def _(t):
    j = O.latest_request_status(t.access_requests).join(t.docs.select("document_id", "owner_user_id"), "document_id").join(max_sens(t), "document_id").join(O.user_clearance(t.assignments, t.positions), "user_id", "left")
    above = (F.col("level") > F.coalesce("clearance", F.lit(1))) & (F.col("owner_user_id") != F.col("user_id"))
    return j.select("user_id", "document_id", above.alias("above"), "status", F.when(F.col("status") == "approved", F.col("expires_at")).alias("approved_until"))


@query("file_gate", f"""{GRANTS}, {MAXSENS}, v AS ({granted('viewer', 'editor')}), corp AS (SELECT DISTINCT user_id FROM assignments WHERE oui_id = 'corp'),
g AS (SELECT DISTINCT user_id, document_id FROM access_requests WHERE status = 'approved' AND (expires_at IS NULL OR expires_at > TIMESTAMP '{AS_OF}'))
SELECT v.user_id, v.document_id FROM v JOIN docs d USING (document_id) LEFT JOIN maxsens m USING (document_id) LEFT JOIN clear c USING (user_id) LEFT JOIN corp k USING (user_id) LEFT JOIN g ON g.user_id = v.user_id AND g.document_id = v.document_id
WHERE k.user_id IS NOT NULL OR d.owner_user_id = v.user_id OR coalesce(m.level, d.sensitivity) <= coalesce(c.clearance, 1) OR g.user_id IS NOT NULL""")
def _(t):
    return O.file_gate(t.docs, max_sens(t), tuples(t), t.assignments, t.positions, closure(t), O.active_grants(t.access_requests, AS_OF), "corp")


@query("resync_scope", f"{RC} SELECT DISTINCT document_id FROM document_oui WHERE oui_id = 'r1' OR oui_id IN (SELECT descendant FROM closure WHERE ancestor = 'r1')")
def _(t):
    moved = closure(t).where("ancestor = 'r1'").select(F.col("descendant").alias("oui_id")).unionAll(t.spark.sql("SELECT 'r1' AS oui_id"))
    return t.document_oui.join(moved, "oui_id", "left_semi").select("document_id").distinct()


def _before(sql: str) -> str:
    """Common tables as they were before the change: every name gets a 0."""
    for n in ("oui_parents", "closure", "up", "chain", "roots", "at_unit", "raw", "tuples"):
        sql = re.sub(rf"(?<![\w.']){n}\b(?!\.)", n + "0", sql)
    return sql


#: Nations had their first region alone; then the further ones were added.
_old_parents = "oui_parents0 AS (SELECT 'r' || r_regionkey AS oui_id, 'corp' AS parent_oui_id FROM region UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"


def reorganised(t):
    """(tuples before, tuples after, documents touched) when nations join a second region."""
    parents = t.sql("SELECT concat('r', r_regionkey) AS oui_id, 'corp' AS parent_oui_id FROM region UNION SELECT concat('n', n_nationkey), concat('r', n_regionkey) FROM nation")
    before, after = O.org_closure(parents), closure(t)
    old = O.document_tuples(t.docs, t.document_oui, parents, before, O.org_root(parents))
    moved = t.oui_parents.exceptAll(parents).unionByName(parents.exceptAll(t.oui_parents)).select("oui_id")
    return old, tuples(t), O.touched_documents(t.document_oui, moved, before, after)


@query("grant_changes", f"{RC}, {ROOTS}, {TUPLES}, {_old_parents}, {_before(CLOSURE)}, {_before(ROOTS)}, {_before(TUPLES)} SELECT 'delete' AS op, * FROM (SELECT * FROM tuples0 EXCEPT SELECT * FROM tuples) UNION ALL SELECT 'write', * FROM (SELECT * FROM tuples EXCEPT SELECT * FROM tuples0)")
def _(t):
    return O.tuple_changes(*reorganised(t))


@query("request_listing", "SELECT r.request_id, r.status, d.title, d.sensitivity, coalesce(nullif(c.c_name, ''), concat('user', r.user_id)) AS requester FROM access_requests r LEFT JOIN docs d USING (document_id) LEFT JOIN customer c ON c.c_custkey = r.user_id")
def _(t):
    names = t.customer.select(F.col("c_custkey").alias("user_id"), "c_name")
    j = t.access_requests.join(t.docs.select("document_id", "title", "sensitivity"), "document_id", "left").join(names, "user_id", "left")
    return j.select("request_id", "status", "title", "sensitivity", F.coalesce(F.nullif("c_name", F.lit("")), F.concat(F.lit("user"), F.col("user_id").cast("string"))).alias("requester"))


_moves = f"SELECT request_id, CASE request_id % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' ELSE 'revoke' END AS event, status, CASE WHEN request_id % 4 = 0 AND status = 'pending' THEN 'approved' WHEN request_id % 4 = 1 AND status = 'pending' THEN 'rejected' WHEN request_id % 4 > 1 AND status = 'approved' AND (expires_at IS NULL OR expires_at > TIMESTAMP '{AS_OF}') THEN 'revoked' END AS new_status FROM access_requests"


@query("request_transitions", f"SELECT request_id, event, coalesce(new_status, status) AS status, new_status IS NULL AS rejected FROM ({_moves})")
def _(t):
    k = F.col("request_id") % 4
    event = F.when(k == 0, "approve").when(k == 1, "reject").otherwise("revoke")
    live = (F.col("status") == "approved") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(AS_OF).cast("timestamp_ntz")))
    pending = F.col("status") == "pending"
    r = t.access_requests.withColumn("event", event)
    new = F.when((F.col("event") == "approve") & pending, "approved").when((F.col("event") == "reject") & pending, "rejected").when((F.col("event") == "revoke") & live, "revoked")
    return r.select("request_id", "event", F.coalesce(new, "status").alias("status"), new.isNull().alias("rejected"))
