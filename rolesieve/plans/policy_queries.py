"""Queries of entity detection, sensitivity and policy."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from rolesieve import constants as K
from rolesieve.functions import text as X
from rolesieve.operators import detection as D
from rolesieve.operators import migrations as M
from rolesieve.operators import organisation as O
from rolesieve.operators import policy as P
from rolesieve.plans.organisation_queries import CLEAR, CLOSURE, closure
from rolesieve.plans.text_queries import tidied
from rolesieve.plans.views import query, quoted

EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+"
MATCH = f"""{CLOSURE}, {CLEAR}, expanded AS (SELECT user_id, oui_id FROM assignments UNION SELECT user_id, descendant FROM assignments JOIN closure ON oui_id = ancestor),
matches AS (SELECT p.entity_key, p.tier, a.user_id FROM rule_pairs p, (SELECT DISTINCT user_id FROM assignments) a WHERE p.oui_id = '__ALL__'
 UNION SELECT p.entity_key, p.tier, a.user_id FROM rule_pairs p JOIN assignments a ON p.oui_id <> '__ALL__' AND (p.oui_id IS NULL OR p.oui_id = a.oui_id) AND (p.position_id IS NULL OR p.position_id = a.position_id)
 UNION SELECT p.entity_key, p.tier, e.user_id FROM rule_pairs p JOIN expanded e ON p.oui_id = e.oui_id),
tiers AS (SELECT c.user_id, r.entity_key, CASE WHEN c.clearance >= 5 THEN 'full' WHEN NOT r.enabled THEN 'block' WHEN EXISTS (SELECT 1 FROM matches m WHERE m.entity_key = r.entity_key AND m.user_id = c.user_id AND m.tier = 'allow') THEN 'full'
 WHEN EXISTS (SELECT 1 FROM matches m WHERE m.entity_key = r.entity_key AND m.user_id = c.user_id AND m.tier = 'mask') THEN 'require' ELSE 'block' END AS tier FROM clear c CROSS JOIN rules r)"""
RT = f"WITH RECURSIVE {MATCH}"


def matches(t):
    return P.scope_match(t.rule_pairs, t.assignments, O.expanded_ouis(t.assignments, closure(t)))


def tiers(t):
    return P.resolve_tiers(t.rules, O.user_clearance(t.assignments, t.positions), matches(t))


@query("extract_entities_regex", rf"SELECT doc_id, 'email' AS label, count(*) AS hits FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL}')) FROM documents) GROUP BY doc_id")
def _(t):
    e = t.documents.select("doc_id", F.explode(P.extract_entities(F.col("text"), ["email"])).alias("e"))
    return e.groupBy("doc_id", F.col("e.label").alias("label")).agg(F.count("*").alias("hits"))


@query("extract_entity_spans")
def _(t):
    return t.documents.select("doc_id", F.explode(P.extract_entities(F.col("text"))).alias("e")).select("doc_id", "e.*")


@query("extract_addresses")
def _(t):
    text = F.concat("text", F.lit("\nSố 5 đường Láng, Hà Nội."))
    return t.documents.select("doc_id", F.explode(P.extract_entities(text, ["employee_address"])).alias("e")).select("doc_id", "e.*")


def amounts_and_clerks(texts: list[str], labels: list[str]) -> list[list[dict]]:
    """A stand-in for a model: it knows an amount by the hint behind it, and clerks by their name."""
    known = {"paid amount": re.compile(r"[\d.]+ \$"), "clerk name": re.compile(r"Clerk#\d+")}
    one = lambda t, k, m: {"text": m[0], "label": k, "start": m.start(), "end": m.end(), "score": 0.9}
    return [[one(t, k, m) for k in labels if k in known for m in known[k].finditer(t)] for t in texts]


_paid = "paid AS (SELECT o_orderkey AS id, replace(format('{:,}', CAST(round(o_totalprice * 100) AS BIGINT)), ',', '.') AS amount, concat('Clerk#', o_custkey) AS o_clerk, o_orderstatus, o_orderpriority FROM orders), told AS (SELECT *, concat('Đơn ', o_orderpriority, ': ', amount, ' / ', o_clerk, ', ', amount, ' đồng') AS text FROM paid)"
_spans = "money AS (SELECT id, 'paid_amount' AS label, amount AS value, strpos(text, amount) - 1 AS start, o_orderstatus FROM told WHERE length(amount) > 8), clerks AS (SELECT id, 'clerk_name' AS label, o_clerk AS value, strpos(text, o_clerk) - 1 AS start, o_orderstatus FROM told)"


def paid(t):
    """Orders as short texts with an amount without a unit, a clerk, and the amount with its unit."""
    amount = F.replace(F.format_number(F.round(F.col("o_totalprice") * 100).cast("long"), 0), F.lit(","), F.lit("."))
    text = F.concat(F.lit("Đơn "), "o_orderpriority", F.lit(": "), amount, F.lit(" / Clerk#"), F.col("o_custkey").cast("string"), F.lit(", "), amount, F.lit(" đồng"))
    return t.orders.select(F.col("o_orderkey").alias("id"), text.alias("text"), "o_orderstatus", "o_orderpriority")


def shown(found):
    return found.select("id", F.explode("entities").alias("e")).select("id", "e.label", F.col("e.text").alias("value"), F.col("e.start").cast("long").alias("start"), F.col("e.end").cast("long").alias("end"))


@query("detect_entities_model", f"WITH {_paid}, {_spans}, found AS (SELECT * FROM money WHERE o_orderstatus <> 'O' UNION ALL SELECT * FROM clerks WHERE o_orderstatus <> 'F') SELECT id, label, value, start, start + length(value) AS \"end\" FROM found")
def _(t):
    """Three sets of labels, one for each status of an order: each is asked for by itself."""
    both, s = ["paid_amount", "clerk_name"], F.col("o_orderstatus")
    wanted = F.when(s == "F", F.array(F.lit(both[0]))).when(s == "O", F.array(F.lit(both[1]), F.lit("not_allowed"))).otherwise(F.array(*map(F.lit, both)))
    return shown(D.detect_entities(paid(t).withColumn("labels", wanted), both, amounts_and_clerks))


@query("detect_entities_union", f"WITH {_paid}, {_spans}, found AS (SELECT * FROM money UNION ALL SELECT * FROM clerks) SELECT id, label, value, start, start + length(value) AS \"end\" FROM found")
def _(t):
    """Five sets of labels, one for each priority: all are asked for their union."""
    labels = ["paid_amount", "clerk_name", "a_name", "b_name", "c_name"]
    wanted = F.array(F.get(F.array(*map(F.lit, labels)), F.substring("o_orderpriority", 1, 1).cast("int") - 1))
    return shown(D.detect_entities(paid(t).withColumn("labels", wanted), labels, amounts_and_clerks))


@query("locate_verbatim", "SELECT doc_id AS id, lang AS label, split_part(text, ' ', 3) AS value, strpos(text, split_part(text, ' ', 3)) - 1 AS start, strpos(text, split_part(text, ' ', 3)) - 1 + length(split_part(text, ' ', 3)) AS \"end\" FROM documents WHERE split_part(text, ' ', 3) <> ''")
def _(t):
    value = F.split_part("text", F.lit(" "), F.lit(3))
    return P.locate_verbatim(t.documents.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"), value.alias("value")))


_flags = sorted({f for v in K.ENTITY_FLAGS.values() for f in v})
_pairs = [(k, f) for k, v in K.ENTITY_FLAGS.items() for f in v]


@query("boolean_labels", "WITH m(label, flag) AS (VALUES " + ", ".join(f"('{k}', '{f}')" for k, f in _pairs) + "), f AS (SELECT document_id, flag FROM detections JOIN m USING (label)) SELECT doc_id, " + ", ".join(f"EXISTS (SELECT 1 FROM f WHERE f.document_id = doc_id AND flag = '{f}')" + (f" OR regexp_matches(text, '{K.FLAG_PATTERNS[f]}', 'i')" if f in K.FLAG_WORDS else "") + f" AS {f}" for f in _flags) + " FROM documents")
def _(t):
    m = t.spark.createDataFrame(_pairs, "label string, flag string")
    f = t.detections.join(F.broadcast(m), "label").groupBy("document_id").agg(*[F.bool_or(F.col("flag") == x).alias("d_" + x) for x in _flags])
    j = t.documents.join(f, F.col("doc_id") == F.col("document_id"), "left")
    words = lambda x: F.col("text").rlike("(?iu)" + K.FLAG_PATTERNS[x]) if x in K.FLAG_WORDS else F.lit(False)
    return j.select("doc_id", *[(F.coalesce("d_" + x, F.lit(False)) | words(x)).alias(x) for x in _flags])


SNAP = "snap AS (SELECT d.document_id, d.label, r.action, r.sensitivity FROM detections d JOIN rules r ON r.entity_key = d.label AND r.enabled)"


def snapshot(t):
    rules = t.rules.where("enabled").select(F.col("entity_key").alias("label"), "action", "sensitivity")
    return t.detections.join(F.broadcast(rules), "label")


def sensitivity_of(t):
    s = snapshot(t).groupBy("document_id").agg(F.collect_list("action").alias("actions"), F.collect_list("sensitivity").alias("levels"))
    none = F.array().cast("array<string>")
    return t.docs.join(s, "document_id", "left").select("document_id", P.chunk_sensitivity(F.col("sensitivity"), F.coalesce("actions", none), F.col("levels")).cast("int").alias("chunk_sensitivity"))


_sens = "SELECT d.document_id, CASE WHEN count(s.label) = 0 THEN greatest(1, least(5, d.sensitivity) - 1) WHEN bool_and(s.action = 'full') THEN least(5, d.sensitivity) ELSE least(5, greatest(1, max(s.sensitivity))) END AS chunk_sensitivity FROM docs d LEFT JOIN snap s USING (document_id) GROUP BY d.document_id, d.sensitivity"


@query("chunk_sensitivity", f"WITH {SNAP} {_sens}")
def _(t):
    return sensitivity_of(t)


@query("resync_sensitivity", f"WITH {SNAP}, new AS ({_sens}) SELECT c.chunk_id, n.chunk_sensitivity AS new_level, n.chunk_sensitivity <> c.chunk_sensitivity AS changed FROM chunk_vectors c JOIN new n USING (document_id)")
def _(t):
    new = sensitivity_of(t).withColumnRenamed("chunk_sensitivity", "new_level")
    return t.chunk_vectors.join(new, "document_id").select("chunk_id", "new_level", (F.col("new_level") != F.col("chunk_sensitivity")).alias("changed"))


@query("confirm_labels", "SELECT document_id, label, sum(hits) AS detection_count, max(CASE action WHEN 'block' THEN 1 ELSE 0 END) AS block, max(CASE action WHEN 'mask' THEN 1 ELSE 0 END) AS mask FROM detections JOIN rules ON entity_key = label AND enabled GROUP BY ALL")
def _(t):
    c = snapshot(t).groupBy("document_id", "label").agg(F.sum("hits").alias("detection_count"), F.max(F.when(F.col("action") == "block", 1).otherwise(0)).alias("block"), F.max(F.when(F.col("action") == "mask", 1).otherwise(0)).alias("mask"))
    return c


@query("entity_snapshot", f"WITH {SNAP} SELECT document_id, string_agg(concat(label, ':', action, ':', sensitivity), ',' ORDER BY label) AS snapshot FROM snap GROUP BY 1")
def _(t):
    entry = F.struct("label", F.concat_ws(":", "label", "action", F.col("sensitivity").cast("string")).alias("s"))
    return snapshot(t).groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["s"]), ",").alias("snapshot"))


#: Questions about parts; some name what is asked for, some hold a mail address.
_questions = "q AS (SELECT p_partkey AS id, concat('Which ', p_name, ' of ', p_brand, CASE p_size % 6 WHEN 0 THEN ' has the best Price?' WHEN 1 THEN ', and whose phone?' WHEN 2 THEN ' is on the payroll?' WHEN 3 THEN concat(', asks b', p_size, '@mail.vn') WHEN 4 THEN ': legacy?' ELSE '?' END) AS text FROM part)"


def _label_words() -> list[tuple[str, str]]:
    ours = ["email", "phone", "credential", "money", "person_name", "legacy"]  # the keys of the view rules
    return [(x, w) for x in sorted({*ours, *K.LABEL_ALIASES}) for w in sorted({*K.LABEL_ALIASES.get(x, []), *x.split("_")})]


@query("query_entities", f"WITH {_questions}, a(label, word) AS (VALUES " + ", ".join(f"('{k}', '{w}')" for k, w in _label_words()) + f"), found AS (SELECT id, label FROM q JOIN a ON contains(lower(text), word) UNION SELECT id, 'email' FROM q WHERE regexp_matches(text, '{EMAIL}')) SELECT q.id, coalesce(string_agg(label, ',' ORDER BY label), '') AS labels FROM q LEFT JOIN found USING (id) GROUP BY 1")
def _(t):
    q = t.sql("SELECT p_partkey AS id, concat('Which ', p_name, ' of ', p_brand, CASE p_size % 6 WHEN 0 THEN ' has the best Price?' WHEN 1 THEN ', and whose phone?' WHEN 2 THEN ' is on the payroll?' WHEN 3 THEN concat(', asks b', p_size, '@mail.vn') WHEN 4 THEN ': legacy?' ELSE '?' END) AS text FROM part")
    return D.query_entities(q, P.rule_keys(t.rules)).select("id", F.array_join("labels", ",").alias("labels"))


_act = "acts AS (SELECT doc_id AS version_id, k AS pos, CASE k WHEN 0 THEN ' Salary Amount ' WHEN 1 THEN 'salary_amount' WHEN 2 THEN source ELSE '--' END AS entity_type, CASE (doc_id + k) % 4 WHEN 0 THEN 'BLOCK' WHEN 1 THEN 'mask' WHEN 2 THEN 'unknown' END AS action FROM documents, (SELECT unnest([0, 1, 2, 3]) AS k)), plain AS (SELECT version_id, pos, regexp_replace(regexp_replace(lower(trim(entity_type)), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g') AS entity_type, CASE WHEN lower(action) IN ('block', 'full', 'mask') THEN lower(action) ELSE 'full' END AS action FROM acts), first AS (SELECT * FROM plain WHERE entity_type <> '' QUALIFY row_number() OVER (PARTITION BY version_id, entity_type ORDER BY pos) = 1)"


def _actions(t):
    k = (F.col("doc_id") + F.col("pos")) % 4
    d = t.documents.select("doc_id", "source", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos"))
    kind = F.when(F.col("pos") == 0, " Salary Amount ").when(F.col("pos") == 1, "salary_amount").when(F.col("pos") == 2, F.col("source")).otherwise("--")
    return d.select(F.col("doc_id").alias("version_id"), "pos", kind.alias("entity_type"), F.when(k == 0, "BLOCK").when(k == 1, "mask").when(k == 2, "unknown").alias("action"))


@query("normalize_actions", f"WITH {_act} SELECT version_id, pos, entity_type, action FROM first")
def _(t):
    return P.normalize_actions(_actions(t))


@query("replace_actions", f"WITH {_act} SELECT version_id, entity_type, action, CASE WHEN entity_type = 'salary_amount' AND version_id % 2 = 0 THEN 7 ELSE 0 END AS detection_count, row_number() OVER (PARTITION BY version_id ORDER BY pos) - 1 AS sort_order FROM first")
def _(t):
    old = t.documents.where("doc_id % 2 = 0").select(F.col("doc_id").alias("version_id"), F.lit("salary_amount").alias("entity_type"), F.lit(7).alias("detection_count"))
    return P.replace_actions(_actions(t), old)


@query("clean_scope_pairs", "SELECT entity_key, string_agg(pair, ',' ORDER BY pair) AS pairs FROM (SELECT DISTINCT entity_key, concat(coalesce(oui_id, '*'), '/', coalesce(CAST(position_id AS VARCHAR), '*')) AS pair FROM (SELECT * FROM rule_pairs UNION ALL SELECT * FROM rule_pairs UNION ALL SELECT 'email', 'mask', NULL, NULL) WHERE oui_id IS NOT NULL OR position_id IS NOT NULL) GROUP BY 1")
def _(t):
    more = t.sql("SELECT * FROM rule_pairs UNION ALL SELECT * FROM rule_pairs UNION ALL SELECT 'email', 'mask', NULL, NULL")
    pairs = more.groupBy("entity_key").agg(F.collect_list(F.struct("oui_id", "position_id")).alias("p"))
    kept = F.array_distinct(F.filter("p", lambda x: x["oui_id"].isNotNull() | x["position_id"].isNotNull()))
    shown = F.transform(kept, lambda x: F.concat(F.coalesce(x["oui_id"], F.lit("*")), F.lit("/"), F.coalesce(x["position_id"].cast("string"), F.lit("*"))))
    return pairs.select("entity_key", F.array_join(F.array_sort(shown), ",").alias("pairs"))


@query("validate_scopes", "SELECT entity_key, 'half pair' AS problem FROM rule_pairs WHERE oui_id IS DISTINCT FROM '__ALL__' AND (oui_id IS NULL OR position_id IS NULL) UNION ALL SELECT a.entity_key, 'allow all with mask' FROM rule_pairs a WHERE a.tier = 'allow' AND a.oui_id = '__ALL__' AND EXISTS (SELECT 1 FROM rule_pairs m WHERE m.entity_key = a.entity_key AND m.tier = 'mask')")
def _(t):
    p = t.rule_pairs
    half = p.where(~F.col("oui_id").eqNullSafe(K.ALL_SCOPE) & (F.col("oui_id").isNull() | F.col("position_id").isNull())).select("entity_key", F.lit("half pair").alias("problem"))
    both = p.where((F.col("tier") == "allow") & (F.col("oui_id") == K.ALL_SCOPE)).join(p.where("tier = 'mask'").select("entity_key").distinct(), "entity_key", "left_semi")
    return half.unionAll(both.select("entity_key", F.lit("allow all with mask").alias("problem")))


@query("scope_match", f"{RT} SELECT * FROM matches")
def _(t):
    return matches(t)


@query("resolve_tiers", f"{RT} SELECT * FROM tiers")
def _(t):
    return tiers(t)


@query("has_restriction", f"{RT} SELECT DISTINCT user_id FROM tiers JOIN rules USING (entity_key) WHERE enabled AND tier <> 'full'")
def _(t):
    return tiers(t).join(t.rules.where("enabled"), "entity_key", "left_semi").where("tier <> 'full'").select("user_id").distinct()


#: Users and the documents they asked for: the pairs that a decision is wanted for.
REQUESTED = "requested AS (SELECT DISTINCT user_id, document_id FROM access_requests)"


def requested(t):
    return t.access_requests.select("user_id", "document_id").distinct()


@query("action_applies", f"WITH {REQUESTED} SELECT DISTINCT a.user_id, v.version_id FROM requested r JOIN assignments a USING (user_id) JOIN versions v USING (document_id) WHERE (v.document_id % 3 = 0 OR list_contains(['n1', 'n2', 'corp'], a.oui_id)) AND (v.document_id % 2 = 0 OR list_contains([31, 33], a.position_id))")
def _(t):
    units = F.when(F.col("document_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, ("n1", "n2", "corp"))))
    roles = F.when(F.col("document_id") % 2 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.lit(31).cast("long"), F.lit(33).cast("long")))
    rows = requested(t).join(t.versions.withColumn("scope_oui_ids", units).withColumn("scope_position_ids", roles), "document_id")
    return P.action_applies(rows, t.assignments).select("user_id", "version_id").distinct()


@query("mask_spans")
def _(t):
    spec = F.create_map(F.lit("email"), F.struct(F.lit("require").alias("tier"), F.lit("full").alias("style"), F.lit(None).cast("string").alias("position")), F.lit("credential"), F.struct(F.lit("block").alias("tier"), F.lit("full").alias("style"), F.lit(None).cast("string").alias("position")))
    return P.mask_spans(t.documents.select(F.col("doc_id").alias("id"), "text", P.extract_entities(F.col("text")).alias("entities"), spec.alias("tiers")))


@query("scan_pii")
def _(t):
    """Typed personal data of every document, one row a span."""
    found = t.documents.select("doc_id", F.explode(P.scan_pii(F.col("text"))).alias("e"))
    return found.select("doc_id", "e.entity_type", "e.text", "e.start", "e.end", "e.score")


_defaults = ", ".join(f"({i}, '{k}', '{n}', '{g}', '{d}', '{a}', {s}, [{', '.join(chr(39) + x + chr(39) for x in f)}]::VARCHAR[])" for i, (k, n, g, d, a, s, f) in enumerate(K.DEFAULT_RULES))


@query("seed_default_rules", f"WITH defaults(pos, entity_key, display_name, group_name, detection_source, action, sensitivity, flags) AS (VALUES {_defaults}), had AS (SELECT DISTINCT label AS entity_key FROM detections) SELECT entity_key, display_name, group_name, detection_source, action, sensitivity, 10 * pos AS priority, array_to_string(flags, ',') AS flags, CASE WHEN action = 'full' THEN '__ALL__' ELSE '' END AS allowed, CASE WHEN action = 'mask' THEN '__ALL__' ELSE '' END AS masked FROM defaults WHERE entity_key NOT IN (SELECT entity_key FROM had)")
def _(t):
    """The default rules for labels that no detection has yet."""
    new = P.seed_default_rules(t.detections.select(F.col("label").alias("entity_key")))
    shown = lambda c: F.array_join(F.transform(c, lambda x: x["oui_id"]), ",")
    return new.select("entity_key", "display_name", "group_name", "detection_source", "action", "sensitivity", "priority", F.array_join("boolean_labels", ",").alias("flags"), shown("allow_scope_pairs").alias("allowed"), shown("mask_scope_pairs").alias("masked"))


_ask = f"{REQUESTED}, asked AS (SELECT d.document_id, d.label, u.user_id, coalesce(x.tier, 'block') AS tier FROM requested u JOIN detections d USING (document_id) JOIN rules r ON r.entity_key = d.label LEFT JOIN tiers x ON x.user_id = u.user_id AND x.entity_key = d.label)"


def asked(t):
    """Each user and document asked for, with what a detector found in the document as entities."""
    span = F.struct("label", F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    found = t.detections.groupBy("document_id").agg(F.collect_list(span).alias("entities"))
    return requested(t).join(found, "document_id").select("user_id", "document_id", "entities", F.lit("").alias("text"), F.lit(False).alias("doc_restricted"))


def styled(t):
    """Tiers with the style of their rule."""
    return tiers(t).join(t.rules.select("entity_key", F.col("mask_style").alias("style"), F.col("mask_position").alias("position")), "entity_key")


def decided(rows, by: str):
    """Sets of labels and the decision of each document and ``by``; rows: document_id, by, label, tier."""
    names = lambda k: F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(F.col("tier") == k, F.col("label")))), ","), F.lit(""))
    worst = F.max(F.when(F.col("tier") == "block", 2).when(F.col("tier") == "require", 1).otherwise(0))
    return rows.groupBy("document_id", by).agg(names("block").alias("blocked"), names("require").alias("required"), F.when(worst == 2, "block").when(worst == 1, "require").otherwise("full").alias("decision"))


_sets = "string_agg(DISTINCT CASE tier WHEN 'block' THEN label END, ',' ORDER BY CASE tier WHEN 'block' THEN label END) AS blocked, string_agg(DISTINCT CASE tier WHEN 'require' THEN label END, ',' ORDER BY CASE tier WHEN 'require' THEN label END) AS required"


@query("apply_policy", f"{RT}, {_ask} SELECT document_id, user_id, {_sets}, CASE max(CASE tier WHEN 'block' THEN 2 WHEN 'require' THEN 1 ELSE 0 END) WHEN 2 THEN 'block' WHEN 1 THEN 'require' ELSE 'full' END AS decision, bool_or(tier = 'require') AS doc_restricted FROM asked GROUP BY ALL")
def _(t):
    """Decisions for every user and document asked for; users without an assignment are blocked by every rule."""
    told = lambda c: F.nullif(F.array_join(c, ","), F.lit("")).alias(c)
    ruled = t.detections.join(t.rules.select(F.col("entity_key").alias("label")), "label", "left_semi").select("document_id").distinct()
    decided = P.apply_policy(asked(t).join(ruled, "document_id", "left_semi"), styled(t), t.rules)
    return decided.select("document_id", "user_id", told("blocked"), told("required"), "decision", "doc_restricted")


@query("tier_groups")
def tier_groups(t):
    """(user_id, tiers): users whose tiers are the same are answered as one."""
    return tiers(t).groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "entity_key", "tier"))), ",").alias("tiers"))


@query("apply_policy_groups")
def _(t):
    """``apply_policy`` for every document and every group of users of the same tiers: label sets and decision, no masked text.

    With ``tier_groups`` this decides every pair of user and document without making the pairs; groups are
    as many as the rule book's scopes tell apart.
    """
    groups = tier_groups(t).select("tiers").distinct()
    known = groups.select("tiers", F.explode(F.split("tiers", ",")).alias("x")).select("tiers", F.split_part("x", F.lit("="), F.lit(1)).alias("label"), F.split_part("x", F.lit("="), F.lit(2)).alias("tier"))
    return decided(t.detections.select("document_id", "label").join(F.broadcast(known), "label"), "tiers")


_told = "told AS (SELECT doc_id, owner_user_id AS user_id, text, [{'k': 'email', 'v': split_part(text, ' ', 2)}, {'k': 'phone', 'v': concat(split_part(text, ' ', 2), ' ', split_part(text, ' ', 3))}, {'k': 'robot', 'v': split_part(text, ' ', 4)}, {'k': 'credential', 'v': split_part(text, ' ', 3)}] AS told FROM documents JOIN docs ON document_id = doc_id)"
_sound = f"{_told}, trimmed AS (SELECT doc_id, user_id, text, list_transform(told, lambda x: {{'k': x.k, 'v': regexp_replace(x.v, '^\\s+|\\s+$', '', 'g')}}) AS told FROM told), closed AS (SELECT doc_id, list(r.entity_key) AS closed FROM told CROSS JOIN rules r LEFT JOIN tiers x ON x.user_id = told.user_id AND x.entity_key = r.entity_key WHERE coalesce(x.tier, 'block') <> 'full' GROUP BY 1), sound AS (SELECT doc_id, text, list_filter(told, lambda x: x.v <> '' AND coalesce(list_contains(closed, x.k), false)) AS s FROM trimmed LEFT JOIN closed USING (doc_id)), once AS (SELECT doc_id, text, list_filter(s, lambda x, i: len(list_filter(s[1 : i - 1], lambda y: y.v = x.v)) = 0) AS s FROM sound)"


@query("recheck_erase", f"{RT}, {_sound}, done AS (SELECT *, list_reduce(list_concat([text], list_transform(list_sort(list_transform(s, lambda x, i: {{'n': -length(x.v), 'i': i, 'v': x.v}})), lambda x: x.v)), lambda a, x: replace(a, x, '')) AS cut FROM once) SELECT doc_id, CASE WHEN len(s) > 0 THEN {tidied('cut')} ELSE text END AS text, CASE WHEN len(s) > 0 THEN 'block' ELSE 'full' END AS decision, array_to_string(list_sort(list_distinct(list_transform(s, lambda x: x.k))), ',') AS added FROM done")
def _(t):
    """A second look at every document for its owner reports three values under rules and one under none."""
    w = lambda k: F.split_part("text", F.lit(" "), F.lit(k))
    said = lambda k, v: F.struct(F.lit(k).alias("entity_type"), v.alias("value"))
    reports = F.array(said("Email ", w(2)), said("Phone", F.concat(w(2), F.lit(" "), w(3))), said("robot", w(4)), said("credential", w(3)))
    empty = F.struct(F.lit("full").alias("decision"), F.lit(False).alias("requires_access_request"), F.array().cast("array<struct<entity_type:string,tier:string,values:array<string>>>").alias("matched"))
    rows = t.documents.join(t.docs.select(F.col("document_id").alias("doc_id"), F.col("owner_user_id").alias("user_id")), "doc_id").select("doc_id", "user_id", "text", empty.alias("contract"), reports.alias("reports"))
    done = P.recheck_erase(rows, styled(t), t.rules)
    return done.select("doc_id", "text", F.col("contract.decision").alias("decision"), F.array_join(F.transform("contract.matched", lambda m: m["entity_type"]), ",").alias("added"))


@query("blocked_types_by_version", f"{RT}, {_ask} SELECT document_id, user_id, string_agg(DISTINCT label, ',' ORDER BY label) AS blocked FROM asked WHERE tier = 'block' GROUP BY ALL")
def _(t):
    decided = P.apply_policy(asked(t), styled(t), t.rules)
    return decided.where(F.size("blocked") > 0).select("document_id", "user_id", F.array_join("blocked", ",").alias("blocked"))


@query("entity_preview", "SELECT d.doc_id, substr(text, 1, 12000) AS preview, count(r.entity_key) AS labels, coalesce(sum(hits) FILTER (WHERE action = 'block'), 0) AS block, coalesce(sum(hits) FILTER (WHERE action = 'mask'), 0) AS mask FROM documents d LEFT JOIN detections x ON x.document_id = d.doc_id LEFT JOIN rules r ON r.entity_key = x.label AND enabled GROUP BY ALL")
def _(t):
    total = lambda a: F.coalesce(F.sum(F.when(F.col("action") == a, F.col("hits"))), F.lit(0)).alias(a)
    counts = snapshot(t).groupBy("document_id").agg(F.count("*").alias("labels"), total("block"), total("mask"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return t.documents.join(counts, F.col("doc_id") == F.col("document_id"), "left").select("doc_id", F.substring("text", 1, 12000).alias("preview"), zero("labels"), zero("block"), zero("mask"))


@query("entity_access_check", "SELECT event_id, user_id % 100 = 0 OR list_has_all(CASE event_id % 4 WHEN 0 THEN ['email'] WHEN 1 THEN ['email', 'phone'] ELSE ['phone'] END, CASE event_id % 3 WHEN 0 THEN ['email'] ELSE ['phone'] END) AS ok FROM events")
def _(t):
    e = F.col("event_id")
    a = lambda *x: F.array(*map(F.lit, x))
    granted = F.when(e % 4 == 0, a("email")).when(e % 4 == 1, a("email", "phone")).otherwise(a("phone"))
    return t.events.select("event_id", ((F.col("user_id") % 100 == 0) | (F.size(F.array_except(F.when(e % 3 == 0, a("email")).otherwise(a("phone")), granted)) == 0)).alias("ok"))


_part = f"concat(repeat('{K.MASK_CHAR}', CAST(length(amount) - greatest(1, length(amount) // 4) AS BIGINT)), right(amount, CAST(greatest(1, length(amount) // 4) AS BIGINT)))"


@query("reveal_values", f"WITH {_paid} SELECT id AS message_id, o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN concat('Đơn ', amount, ' / {K.MASK_PLACEHOLDER}') ELSE concat('Đơn ', {_part}, ' / ', o_clerk) END AS content FROM told JOIN orders ON o_orderkey = id WHERE orders.o_orderstatus = 'O' OR (orders.o_orderstatus = 'F' AND length(amount) > 8)".replace("CASE o_orderstatus", "CASE orders.o_orderstatus"))
def _(t):
    """An answer about each order hides its amount in part and its clerk; who ordered was granted one of the two, by status."""
    kinds = ["paid_amount", "clerk_name"]
    found = D.detect_entities(paid(t), kinds, amounts_and_clerks).select(F.col("id").alias("chunk_id"), F.explode("entities").alias("e")).select("chunk_id", "e.label", "e.start", "e.text")
    amount = F.replace(F.format_number(F.round(F.col("o_totalprice") * 100).cast("long"), 0), F.lit(","), F.lit("."))
    messages = t.orders.select(F.col("o_orderkey").alias("message_id"), F.concat(F.lit("Đơn "), X.partial_mask(amount, F.lit("head")), F.lit(f" / {K.MASK_PLACEHOLDER}")).alias("content"))
    masks = t.orders.select(F.col("o_orderkey").alias("message_id"), F.col("o_orderkey").alias("chunk_id"), F.explode(F.array(*map(F.lit, kinds))).alias("entity_type"))
    s = F.col("o_orderstatus")
    grants = t.orders.where(s.isin("F", "O")).select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("message_id"), F.when(s == "F", kinds[0]).otherwise(kinds[1]).alias("entity_type"))
    rules = t.spark.createDataFrame([(kinds[0], "partial", "head"), (kinds[1], "full", None)], "entity_key string, style string, position string")
    return P.reveal_values(messages, masks, grants, found, rules)


_con = "con AS (SELECT conv_id, pos, label, tier, cited FROM (SELECT conv_id, turn AS pos, CASE turn % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'phone' ELSE 'money' END AS label, CASE WHEN (conv_id + turn) % 4 = 0 THEN 'block' WHEN (conv_id + turn) % 4 = 1 THEN 'require' ELSE 'full' END AS tier, turn % 2 = 0 AS cited FROM conversations))"


def _contracts(t):
    k, s = F.col("turn") % 3, (F.col("conv_id") + F.col("turn")) % 4
    return t.conversations.select("conv_id", F.col("turn").alias("pos"), F.when(k == 0, "email").when(k == 1, "phone").otherwise("money").alias("label"), F.when(s == 0, "block").when(s == 1, "require").otherwise("full").alias("tier"), (F.col("turn") % 2 == 0).alias("cited"))


@query("applied_rules", f"WITH {_con} SELECT conv_id, label, CASE tier WHEN 'require' THEN 'mask' ELSE tier END AS action FROM con WHERE tier = 'block' OR (cited AND tier <> 'full') QUALIFY row_number() OVER (PARTITION BY conv_id, label ORDER BY pos) = 1")
def _(t):
    first = F.row_number().over(Window.partitionBy("conv_id", "label").orderBy("pos"))
    kept = _contracts(t).where("tier = 'block' or (cited and tier <> 'full')").withColumn("n", first).where("n = 1")
    return kept.select("conv_id", "label", F.when(F.col("tier") == "require", "mask").otherwise(F.col("tier")).alias("action"))


@query("entity_masks", f"WITH {_con} SELECT conv_id, pos, label FROM con WHERE tier = 'require'")
def _(t):
    return _contracts(t).where("tier = 'require'").select("conv_id", "pos", "label")


@query("policy_snapshot", "SELECT version_id, entity_key, action, sensitivity, row_number() OVER (PARTITION BY version_id ORDER BY priority, entity_key) - 1 AS sort_order FROM versions CROSS JOIN rules WHERE enabled")
def _(t):
    """The frozen list is numbered once and then given to every version."""
    order = F.row_number().over(Window.partitionBy("enabled").orderBy("priority", "entity_key")) - 1
    frozen = t.rules.where("enabled").withColumn("sort_order", order.cast("long")).select("entity_key", "action", "sensitivity", "sort_order")
    listed = frozen.agg(F.collect_list(F.struct(*frozen.columns)).alias("rules"))
    return t.versions.select("version_id", F.lit(1).alias("one")).join(F.broadcast(listed.withColumn("one", F.lit(1))), "one").select("version_id", F.explode("rules").alias("r")).select("version_id", "r.*")


#: Parts stand for rules, their type for the profile and their brand for the group; of some groups the scope is written anew.
_scopes = "scopes AS (SELECT DISTINCT p_type AS profile, p_brand AS group_name, concat('n', right(p_brand, 1)) AS unit FROM part WHERE p_size > 45 AND p_type <> 'SMALL')"


@query("apply_group_scope", f"WITH {_scopes}, hit AS (SELECT DISTINCT profile FROM scopes) SELECT p_partkey AS rule_id, concat(coalesce(unit, 'old'), '/*') AS allow, CASE WHEN unit IS NULL THEN '*/31' ELSE '' END AS mask, CASE WHEN h.profile IS NOT NULL THEN concat('v1.', length(p_type) + 1) ELSE concat('v1.', length(p_type)) END AS version FROM part p LEFT JOIN scopes s ON s.profile = p_type AND s.group_name = p_brand LEFT JOIN hit h ON h.profile = p_type")
def _(t):
    pair = lambda o, p: F.array(F.struct(o.cast("string").alias("oui_id"), p.cast("string").alias("position_id")).cast(M.PAIR))
    none = F.lit(None)
    rules = t.part.select(F.col("p_partkey").alias("rule_id"), F.col("p_type").alias("profile"), F.col("p_brand").alias("group_name"), pair(F.lit("old"), none).alias("allow_scope_pairs"), pair(none, F.lit("31")).alias("mask_scope_pairs"), F.concat(F.lit("v1."), F.length("p_type").cast("string")).alias("version"))
    unit = F.concat(F.lit("n"), F.substring("p_brand", -1, 1))
    scopes = t.part.where("p_size > 45 and p_type <> 'SMALL'").select(F.col("p_type").alias("profile"), F.col("p_brand").alias("group_name"), F.concat(pair(unit, none), pair(none, none)).alias("allow"), none.cast(f"array<{M.PAIR}>").alias("mask")).distinct()
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.coalesce(x["oui_id"], F.lit("*")), F.lit("/"), F.coalesce(x["position_id"], F.lit("*")))), ",")
    return M.apply_group_scope(rules, scopes).select("rule_id", shown("allow_scope_pairs").alias("allow"), shown("mask_scope_pairs").alias("mask"), "version")


COMBOS = "combos AS (SELECT oui_id, position_id FROM oui JOIN positions USING (ou_id)), covered AS (SELECT DISTINCT p.entity_key, c.oui_id, c.position_id FROM rule_pairs p JOIN combos c ON p.oui_id = '__ALL__' OR ((p.oui_id IS NULL OR p.oui_id = c.oui_id OR EXISTS (SELECT 1 FROM closure k WHERE k.descendant = p.oui_id AND k.ancestor = c.oui_id)) AND (p.position_id IS NULL OR p.position_id = c.position_id)))"


def coverage(t):
    combos = t.oui.join(t.positions, "ou_id").select("oui_id", "position_id")
    pairs = t.rule_pairs.select("entity_key", F.col("oui_id").alias("u"), F.col("position_id").alias("p"))
    up = closure(t).select(F.col("descendant").alias("u"), F.col("ancestor").alias("oui_id")).unionAll(t.oui.select(F.col("oui_id").alias("u"), "oui_id"))
    by_unit = pairs.join(up, "u").join(combos, "oui_id").where("p is null or p = position_id").select("entity_key", "oui_id", "position_id")
    everyone = combos.crossJoin(F.broadcast(pairs.where(F.col("u") == K.ALL_SCOPE).select("entity_key"))).select("entity_key", "oui_id", "position_id")
    return combos, by_unit.unionAll(everyone).distinct()


@query("scope_coverage", f"WITH RECURSIVE {CLOSURE}, {COMBOS} SELECT r.entity_key, c.oui_id, c.position_id, v.entity_key IS NOT NULL AS covered FROM rules r CROSS JOIN combos c LEFT JOIN covered v ON v.entity_key = r.entity_key AND v.oui_id = c.oui_id AND v.position_id = c.position_id")
def _(t):
    combos, covered = coverage(t)
    grid = combos.crossJoin(F.broadcast(t.rules.select("entity_key")))
    return grid.join(covered.withColumn("hit", F.lit(True)), ["entity_key", "oui_id", "position_id"], "left").select("entity_key", "oui_id", "position_id", F.coalesce("hit", F.lit(False)).alias("covered"))


@query("rule_tiers", f"WITH RECURSIVE {CLOSURE}, {COMBOS}, n AS (SELECT entity_key, count(*) AS n FROM covered GROUP BY 1), s AS (SELECT entity_key, bool_or(tier = 'allow') AS allow, bool_or(tier = 'mask') AS mask, bool_or(tier = 'allow' AND oui_id = '__ALL__') AS everyone FROM rule_pairs GROUP BY 1) SELECT r.entity_key, coalesce(s.allow, false) AS allow, coalesce(s.mask AND NOT s.everyone, false) AS mask, coalesce(NOT s.everyone, true) AND coalesce(n.n, 0) < (SELECT count(*) FROM combos) AS block FROM rules r LEFT JOIN s USING (entity_key) LEFT JOIN n USING (entity_key)")
def _(t):
    combos, covered = coverage(t)
    n = covered.groupBy("entity_key").agg(F.count("*").alias("n"))
    everyone = (F.col("tier") == "allow") & (F.col("oui_id") == K.ALL_SCOPE)
    s = t.rule_pairs.groupBy("entity_key").agg(F.bool_or(F.col("tier") == "allow").alias("a"), F.bool_or(F.col("tier") == "mask").alias("m"), F.bool_or(F.coalesce(everyone, F.lit(False))).alias("e"))
    total = combos.agg(F.count("*").alias("total")).withColumn("one", F.lit(1))
    j = t.rules.select("entity_key", F.lit(1).alias("one")).join(s, "entity_key", "left").join(n, "entity_key", "left").join(total, "one")
    no = lambda c: F.coalesce(c, F.lit(False))
    return j.select("entity_key", no("a").alias("allow"), no(F.col("m") & ~F.col("e")).alias("mask"), (F.coalesce(~F.col("e"), F.lit(True)) & (F.coalesce("n", F.lit(0)) < F.col("total"))).alias("block"))




@query("seed_rules", "SELECT k AS entity_key, pos * 10 AS priority, CASE pos % 3 WHEN 0 THEN 'allow' WHEN 1 THEN 'mask' END AS tier, CASE WHEN pos % 3 < 2 THEN '__ALL__' END AS oui_id FROM (SELECT k, row_number() OVER (ORDER BY k) - 1 AS pos FROM (SELECT DISTINCT c_mktsegment AS k FROM customer UNION SELECT entity_key FROM rules)) WHERE k NOT IN (SELECT entity_key FROM rules)")
def _(t):
    keys = t.customer.select(F.col("c_mktsegment").alias("entity_key")).union(t.rules.select("entity_key")).distinct().agg(F.array_sort(F.collect_set("entity_key")).alias("k")).select(F.posexplode("k").alias("pos", "entity_key"))
    k = F.col("pos") % 3
    return keys.join(t.rules, "entity_key", "left_anti").select("entity_key", (F.col("pos") * 10).cast("long").alias("priority"), F.when(k == 0, "allow").when(k == 1, "mask").alias("tier"), F.when(k < 2, K.ALL_SCOPE).alias("oui_id"))


_old_rules = "old AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'block' WHEN 1 THEN 'mask' ELSE 'full' END AS action, CASE WHEN c_acctbal > 0 THEN [concat('n', c_nationkey), 'corp'] ELSE [] END AS u, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN [CAST(31 + c_custkey % 5 AS VARCHAR)] ELSE [] END AS p FROM customer)"


@query("migrate_rule_scopes", f"WITH {_old_rules} SELECT id, CASE WHEN action = 'full' THEN '__ALL__/*' ELSE '' END AS allow, CASE WHEN action <> 'mask' THEN '' WHEN len(u) = 0 AND len(p) = 0 THEN '__ALL__/*' ELSE array_to_string(flatten(list_transform(CASE WHEN len(u) = 0 THEN ['*'] ELSE u END, lambda x: list_transform(CASE WHEN len(p) = 0 THEN ['*'] ELSE p END, lambda y: concat(x, '/', y)))), ',') END AS mask FROM old")
def _(t):
    """Rules of customers with one action, units by balance and positions by segment, in the form of pairs."""
    k = F.col("c_custkey") % 3
    none = F.array().cast("array<string>")
    old = t.customer.select(
        F.col("c_custkey").alias("id"),
        F.when(k == 0, "block").when(k == 1, "mask").otherwise("full").alias("action"),
        F.when(F.col("c_acctbal") > 0, F.array(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.lit("corp"))).otherwise(none).alias("scope_oui_ids"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.array((31 + F.col("c_custkey") % 5).cast("string"))).otherwise(none).alias("scope_position_ids"),
    )
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.coalesce(x["oui_id"], F.lit("*")), F.lit("/"), F.coalesce(x["position_id"], F.lit("*")))), ",")
    return M.migrate_rule_scopes(old).select("id", shown("allow_scope_pairs").alias("allow"), shown("mask_scope_pairs").alias("mask"))


_keys, _groups = [*K.DEFAULT_LEVELS, "other"], [*K.GROUP_NAMES, "Own", ""]
_old_keys = f"old AS (SELECT p_partkey AS id, ([{quoted(_keys)}])[1 + p_partkey % {len(_keys)}] AS entity_key, ([{quoted(_groups)}])[1 + p_size % {len(_groups)}] AS group_name FROM part), named AS (SELECT id, entity_key, CASE group_name {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in K.GROUP_NAMES.items())} ELSE group_name END AS group_name FROM old)"


def _backfilled(t):
    """Parts stand for rules of every known key and group; brands are groups that exist."""
    pick = lambda xs, k: F.get(F.array(*map(F.lit, xs)), (k % len(xs)).cast("int"))
    rules = t.part.select(F.col("p_partkey").alias("id"), pick(_keys, F.col("p_partkey")).alias("entity_key"), pick(_groups, F.col("p_size")).alias("group_name"))
    return M.backfill_rules(rules, t.part.select(F.col("p_brand").alias("name")).distinct())


@query("backfill_rule_columns", f"WITH {_old_keys} SELECT id, entity_key, group_name, CASE entity_key {' '.join(f"WHEN '{k}' THEN {v}" for k, v in K.DEFAULT_LEVELS.items())} ELSE {K.OTHER_LEVEL} END AS sensitivity FROM named")
def _(t):
    return _backfilled(t)[0]


@query("backfill_groups", f"WITH {_old_keys} SELECT p_brand AS name FROM part UNION SELECT group_name FROM named WHERE group_name <> '' UNION SELECT unnest([{quoted(K.GROUP_NAMES.values())}])")
def _(t):
    return _backfilled(t)[1]


@query("backfill_sort_order", "SELECT l_orderkey AS version_id, l_linenumber AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, l_linenumber) - 1 AS sort_order FROM lineitem")
def _(t):
    """Lines of orders stand for a version's actions, their flag for the type."""
    actions = t.lineitem.select(F.col("l_orderkey").alias("version_id"), F.col("l_returnflag").alias("entity_type"), F.col("l_linenumber").alias("id"))
    return M.backfill_sort_order(actions).select("version_id", "id", "sort_order")
