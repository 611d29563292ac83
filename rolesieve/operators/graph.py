"""The knowledge graph: what the tables say it should be, and merging that into what it is.

A node is named by (kind, source): the table it stands for and the key there; static nodes have
the kind ``static`` and their name.  An edge is named by its ends and its type.  A sync is
a merge: what was seen before keeps its id and the time it was first seen, the rest is
overwritten.  Ids are hashes of the names, so a job that is run twice makes the same graph.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesieve import constants as K

NODE = ["kind", "source", "name", "category", "type", "unit_kind"]
EDGE = ["src_kind", "src", "type", "dst_kind", "dst"]
STATIC = "static"
#: Relations that are written anew whenever their node is synced; the others only grow.
REWRITTEN = {
    "entity_policy_rule": ["IS_A"],
    "entity_policy_rule_tier": ["IS_A", "APPLIES_TO", "GRANTS"],
    "org_unit": ["IS_A"],
    "org_unit_scope": ["IS_A"],
    "org_unit_instance": ["IS_A", "BELONGS_TO"],
    "position_instance": ["IS_A", "IS_A_ROLE_OF"],
    "user_assignment": ["IS_A"],
}


def _named(*parts: Column | str) -> Column:
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")).cast("string") for p in parts])), 256)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _joined(*parts: str) -> Column:
    return F.concat_ws(":", *[F.col(p).cast("string") for p in parts])


def taxonomy(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that stand in every graph: roots, classes, document types, permissions, decisions."""
    nodes = spark.createDataFrame([(STATIC, n, n, c, t, None) for n, c, t in K.STATIC_NODES], ", ".join(f"{c} string" for c in NODE))
    edges = spark.createDataFrame([(STATIC, a, r, STATIC, b) for a, r, b in K.STATIC_EDGES], ", ".join(f"{c} string" for c in EDGE))
    return nodes, edges


def rule_tier_nodes(pairs: DataFrame) -> DataFrame:
    """(entity_key, tier, everyone): the tiers a rule needs, from its scope pairs (entity_key, tier, oui_id, position_id).

    A rule that allows everyone needs no mask tier; a blocked rest has no node.
    """
    everyone = F.coalesce(F.bool_or((F.col("tier") == "allow") & (F.col("oui_id") == K.ALL_SCOPE)), F.lit(False))
    rule = pairs.where(F.col("tier").isin("allow", "mask")).groupBy("entity_key").agg(everyone.alias("everyone"), F.collect_set("tier").alias("tiers"))
    needed = F.filter("tiers", lambda t: (t == "allow") | ~F.col("everyone"))
    return rule.select("entity_key", "everyone", F.explode(needed).alias("tier")).select("entity_key", "tier", (F.col("everyone") & (F.col("tier") == "allow")).alias("everyone"))


def wanted_graph(oui_type: DataFrame, oui: DataFrame, parents: DataFrame, positions: DataFrame, rules: DataFrame, pairs: DataFrame, assignments: DataFrame, contained: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that the tables ask for, besides the taxonomy.

    oui_type: ou_id, name, parent_id; oui: oui_id, name, ou_id; parents: oui_id, parent_oui_id;
    positions: position_id, ou_id, name; rules: entity_key, name, sensitivity; pairs as in
    ``rule_tier_nodes``; assignments: user_id, name, oui_id, position_id; contained: document_type,
    entity_key.  Edges to ends that no node stands for are left out by ``sync_graph``.
    """
    tiers = rule_tier_nodes(pairs)
    seats = positions.select("position_id", "ou_id", F.col("name").alias("position")).join(oui, "ou_id").select("position_id", "oui_id", F.concat("position", F.lit(" ("), "name", F.lit(")")).alias("name"))
    of_tier = lambda i: F.create_map(*[F.lit(x) for t, names in K.TIER_NODES.items() for x in (t, names[i])])[F.col("tier")]

    def node(df, kind, source, name, category, type_, unit_kind=None):
        cast = lambda c: c.cast("string")
        return df.select(F.lit(kind).alias("kind"), cast(source).alias("source"), cast(name).alias("name"), F.lit(category).alias("category"), F.lit(type_).alias("type"), cast(F.lit(None) if unit_kind is None else unit_kind).alias("unit_kind"))

    nodes = [
        node(rules, "entity_policy_rule", F.col("entity_key"), F.col("name"), "Entity", "EntityInstance"),
        node(tiers, "entity_policy_rule_tier", _joined("entity_key", "tier"), of_tier(0), "Policy", "PolicyInstance"),
        node(oui_type, "org_unit", F.col("ou_id"), F.col("name"), "Organization", "OrgUnitType"),
        node(oui_type, "org_unit_scope", F.concat(F.col("ou_id").cast("string"), F.lit(":scope")), F.concat("name", F.lit("Scope")), "Scope", "ScopeClass"),
        node(oui, "org_unit_instance", F.col("oui_id"), F.col("name"), "Organization", "OrgUnitInstance", F.col("ou_id")),
        node(seats, "position_instance", _joined("position_id", "oui_id"), F.col("name"), "Scope", "PositionInstance"),
        node(assignments, "user_assignment", _joined("user_id", "oui_id"), F.coalesce(F.nullif("name", F.lit("")), F.lit("?")), "Employee", "Employee"),
    ]

    def edge(df, src_kind, src, type_, dst_kind, dst):
        return df.select(F.lit(src_kind).alias("src_kind"), src.cast("string").alias("src"), F.lit(type_).alias("type"), F.lit(dst_kind).alias("dst_kind"), dst.cast("string").alias("dst"))

    rule, tier, unit, scope, seat = "entity_policy_rule", "entity_policy_rule_tier", "org_unit_instance", "org_unit_scope", "position_instance"
    level = F.greatest(F.lit(1), F.coalesce("sensitivity", F.lit(1)))
    entity_class = F.coalesce(F.try_element_at(F.array(*map(F.lit, K.ENTITY_CLASSES)), level.cast("int")), F.lit(K.ENTITY_CLASSES[0]))
    of_unit = lambda c: F.concat(F.col(c).cast("string"), F.lit(":scope"))
    this_tier = _joined("entity_key", "tier")
    live = pairs.join(tiers, ["entity_key", "tier"])
    all_of = F.coalesce((F.col("oui_id") == K.ALL_SCOPE) | (F.col("position_id").cast("string") == K.ALL_SCOPE), F.lit(False)) | F.col("everyone")
    some = live.where(~all_of)
    has = lambda c: F.col(c).isNotNull()
    edges = [
        edge(rules, rule, F.col("entity_key"), "IS_A", STATIC, entity_class),
        edge(tiers, rule, F.col("entity_key"), "PROTECTED_BY", tier, this_tier),
        edge(tiers, tier, this_tier, "IS_A", STATIC, of_tier(1)),
        edge(tiers, tier, this_tier, "GRANTS", STATIC, of_tier(2)),
        edge(live.where(all_of), tier, this_tier, "APPLIES_TO", STATIC, F.lit("Scope")),
        edge(some.where(has("oui_id") & has("position_id")), tier, this_tier, "APPLIES_TO", seat, _joined("position_id", "oui_id")),
        edge(some.where(has("oui_id") & ~has("position_id")), tier, this_tier, "APPLIES_TO", unit, F.col("oui_id")),
        edge(some.where(~has("oui_id")).drop("oui_id").join(seats.select("position_id", "oui_id"), "position_id"), tier, this_tier, "APPLIES_TO", seat, _joined("position_id", "oui_id")),
        edge(oui_type.where(has("parent_id")), "org_unit", F.col("ou_id"), "IS_A", "org_unit", F.col("parent_id")),
        edge(oui_type.where(~has("parent_id")), "org_unit", F.col("ou_id"), "IS_A", STATIC, F.lit("Enterprise")),
        edge(oui_type, scope, of_unit("ou_id"), "IS_A", STATIC, F.lit("Scope")),
        edge(oui, unit, F.col("oui_id"), "IS_A", "org_unit", F.col("ou_id")),
        edge(oui, unit, F.col("oui_id"), "IS_A", scope, of_unit("ou_id")),
        edge(parents, unit, F.col("oui_id"), "BELONGS_TO", unit, F.col("parent_oui_id")),
        edge(seats, seat, _joined("position_id", "oui_id"), "IS_A_ROLE_OF", unit, F.col("oui_id")),
        edge(seats, seat, _joined("position_id", "oui_id"), "IS_A", STATIC, F.lit("RoleScope")),
        edge(assignments.where(has("position_id")), "user_assignment", _joined("user_id", "oui_id"), "IS_A", seat, _joined("position_id", "oui_id")),
        edge(contained, STATIC, F.col("document_type"), "CONTAINS", rule, F.col("entity_key")),
    ]
    return _union(nodes).dropDuplicates(["kind", "source"]), _union(edges).distinct()


def merge_nodes(old: DataFrame | None, wanted: DataFrame, gone: DataFrame | None, as_of: Column) -> DataFrame:
    """Nodes (``NODE``, id, created_at) after a sync.

    Known ones keep id and created_at and take the wanted name, category, type and unit_kind; others
    are made as of ``as_of``; those that are not wanted stay as they were, unless ``gone`` (kind, source) has them.
    """
    new = wanted.select(*NODE, _named("kind", "source").alias("id"), as_of.alias("created_at"), F.lit(True).alias("_new"))
    if old is not None:
        if gone is not None:
            old = old.join(gone.select("kind", "source").distinct(), ["kind", "source"], "left_anti")
        new = old.select(*NODE, "id", "created_at", F.lit(False).alias("_new")).unionByName(new)
    last = F.max_by(F.struct("name", "category", "type", "unit_kind"), "_new").alias("n")
    first = F.min_by(F.struct("id", "created_at"), "_new").alias("f")
    merged = new.groupBy("kind", "source").agg(last, first)
    return merged.select("kind", "source", "n.*", "f.*").select(*NODE, "id", "created_at")


def merge_edges(old: DataFrame | None, wanted: DataFrame, nodes: DataFrame, synced: DataFrame) -> DataFrame:
    """Edges (``EDGE``, id) after a sync.

    Of the nodes in ``synced`` (kind, source) the relations in ``REWRITTEN`` are cleared first; then the
    wanted edges come, between nodes that exist.  An edge whose end is gone goes with it.
    """
    made = wanted.select(*EDGE, _named(*EDGE).alias("id"))
    if old is not None:
        spark = old.sparkSession
        kinds = spark.createDataFrame([(k, r) for k, rs in REWRITTEN.items() for r in rs], "src_kind string, type string")
        cleared = synced.select(F.col("kind").alias("src_kind"), F.col("source").alias("src")).distinct().join(kinds, "src_kind")
        kept = old.select(*EDGE, "id").join(cleared, ["src_kind", "src", "type"], "left_anti")
        made = kept.unionByName(made).groupBy(*EDGE).agg(F.min("id").alias("id"))
    for end in ("src", "dst"):
        known = nodes.select(F.col("kind").alias(f"{end}_kind"), F.col("source").alias(end))
        made = made.join(known, [f"{end}_kind", end], "left_semi")
    return made.select(*EDGE, "id")


def sync_graph(old_nodes: DataFrame | None, old_edges: DataFrame | None, wanted: tuple[DataFrame, DataFrame], as_of: Column, gone: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the graph after merging ``wanted`` (``wanted_graph``) and the taxonomy into it.

    The policy tiers of a synced rule that it no longer needs go, with their edges; so does what
    ``gone`` (kind, source) names.  Run again on its own result it changes nothing.
    """
    nodes, edges = wanted
    static_nodes, static_edges = taxonomy(nodes.sparkSession)
    every = nodes.unionByName(static_nodes)
    if old_nodes is not None:
        tier = F.col("kind") == "entity_policy_rule_tier"
        of_rule = F.regexp_extract("source", "^(.*):[a-z]+$", 1)
        stale = old_nodes.where(tier).withColumn("rule", of_rule).join(nodes.where("kind = 'entity_policy_rule'").select(F.col("source").alias("rule")), "rule", "left_semi").join(nodes.where(tier).select("kind", "source"), ["kind", "source"], "left_anti").select("kind", "source")
        gone = stale if gone is None else stale.unionByName(gone.select("kind", "source"))
    merged = merge_nodes(old_nodes, every, gone, as_of)
    return merged, merge_edges(old_edges, edges.unionByName(static_edges), merged, nodes)
