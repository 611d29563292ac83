"""Bringing old rule tables to the present form, and edits of whole groups of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolesieve import constants as K

PAIR = "struct<oui_id:string,position_id:string>"
_NONE = "array<string>"


def _list(c: str) -> Column:
    return F.coalesce(F.col(c).cast(_NONE), F.array().cast(_NONE))


def tiers_of_actions(rules: DataFrame) -> DataFrame:
    """Rules of one action and one scope (action, scope_oui_ids, scope_position_ids) with lists for each tier instead.

    A scope without units and positions meant everyone.  An action of full leaves all lists empty.
    """
    everyone = (F.size(_list("scope_oui_ids")) == 0) & (F.size(_list("scope_position_ids")) == 0)
    units = F.when(everyone, F.array(F.lit(K.ALL_SCOPE))).otherwise(_list("scope_oui_ids"))
    out = rules.withColumns({f"immune_{k}": F.array().cast(_NONE) for k in ("oui_ids", "position_ids")})
    for tier, action in (("block", "block"), ("require", "mask")):
        of = lambda c: F.when(F.col("action").eqNullSafe(action), c).otherwise(F.array().cast(_NONE))
        out = out.withColumn(f"{tier}_oui_ids", of(units)).withColumn(f"{tier}_position_ids", of(_list("scope_position_ids")))
    return out.drop("action", "scope_oui_ids", "scope_position_ids")


def allow_and_mask(rules: DataFrame) -> DataFrame:
    """Immune lists become those of allow, require lists those of mask; a rule without any list allows everyone; block is the rest."""
    lists = [f"{t}_{k}" for t in ("block", "require", "immune") for k in ("oui_ids", "position_ids")]
    free = sum((F.size(_list(c)) for c in lists), F.lit(0)) == 0
    out = rules.withColumn("allow_oui_ids", F.when(free, F.array(F.lit(K.ALL_SCOPE))).otherwise(_list("immune_oui_ids")))
    return out.withColumn("allow_position_ids", _list("immune_position_ids")).withColumn("mask_oui_ids", _list("require_oui_ids")).withColumn("mask_position_ids", _list("require_position_ids")).drop(*lists)


def rectangle(units: Column, positions: Column) -> Column:
    """array<struct<oui_id, position_id>>: every unit with every position; one list alone leaves the other side open; the sentinel in either is everyone."""
    pair = lambda o, p: F.struct(o.cast("string").alias("oui_id"), p.cast("string").alias("position_id")).cast(PAIR)
    none = F.lit(None)
    product = F.flatten(F.transform(units, lambda o: F.transform(positions, lambda p: pair(o, p))))
    everyone = F.array_contains(units, K.ALL_SCOPE) | F.array_contains(positions, K.ALL_SCOPE)
    one_side = F.when(F.size(units) > 0, F.transform(units, lambda o: pair(o, none))).otherwise(F.transform(positions, lambda p: pair(none, p)))
    return F.when(everyone, F.array(pair(F.lit(K.ALL_SCOPE), none))).when((F.size(units) > 0) & (F.size(positions) > 0), product).otherwise(one_side)


def scope_pairs(rules: DataFrame) -> DataFrame:
    """Lists of allow and mask as pairs of unit and position (allow_scope_pairs, mask_scope_pairs)."""
    for tier in ("allow", "mask"):
        rules = rules.withColumn(f"{tier}_scope_pairs", rectangle(_list(f"{tier}_oui_ids"), _list(f"{tier}_position_ids"))).drop(f"{tier}_oui_ids", f"{tier}_position_ids")
    return rules


def migrate_rule_scopes(rules: DataFrame) -> DataFrame:
    """Rules of one action and scope in the present form, by the three steps above; other columns pass."""
    return scope_pairs(allow_and_mask(tiers_of_actions(rules)))


def backfill_sort_order(actions: DataFrame) -> DataFrame:
    """Actions (version_id, entity_type, id, ...) with sort_order 0, 1, ... in each version, by type, then id."""
    order = F.row_number().over(Window.partitionBy("version_id").orderBy("entity_type", "id")) - 1
    return actions.withColumn("sort_order", order.cast("long"))


def _renamed(group: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in K.GROUP_NAMES.items() for x in kv])
    return F.coalesce(names[group], group)


def backfill_rules(rules: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules with sensitivity by key and groups renamed, groups with those added that are missing).

    rules: entity_key, group_name and any others; groups: name.  Groups are the renamed ones and all that rules name;
    those there are stay, and each name stands once.  A rule without a group stays without one.
    """
    levels = F.create_map(*[F.lit(x) for kv in K.DEFAULT_LEVELS.items() for x in kv])
    done = rules.withColumn("sensitivity", F.coalesce(levels[F.col("entity_key")], F.lit(K.OTHER_LEVEL))).withColumn("group_name", _renamed(F.col("group_name")))
    named = done.where("group_name <> ''").select(F.col("group_name").alias("name"))
    known = rules.sparkSession.createDataFrame([(n,) for n in K.GROUP_NAMES.values()], "name string")
    return done, groups.select("name").unionByName(known).unionByName(named).distinct()


def bumped(version: Column) -> Column:
    """A version with the number at its end one greater; one without a number as it was."""
    n = F.regexp_extract(version, r"(\d+)$", 1)
    return F.when(n == "", version).otherwise(F.concat(F.regexp_extract(version, r"^(.*?)(\d+)$", 1), (n.cast("long") + 1).cast("string")))


def apply_group_scope(rules: DataFrame, scopes: DataFrame) -> DataFrame:
    """Rules whose group is in ``scopes`` with that group's pairs in place of their own, and their profile's version bumped.

    rules: profile, group_name, allow_scope_pairs, mask_scope_pairs, version and any others; scopes:
    profile, group_name, allow, mask (arrays of pairs; pairs without either side are left out).  A version counts
    on once for each profile in which any rule was overwritten, for all its rules.
    """
    clean = lambda c: F.array_distinct(F.filter(F.coalesce(c, F.array().cast(f"array<{PAIR}>")), lambda p: p["oui_id"].isNotNull() | p["position_id"].isNotNull()))
    s = scopes.select("profile", "group_name", clean(F.col("allow")).alias("_allow"), clean(F.col("mask")).alias("_mask"), F.lit(True).alias("_hit")).dropDuplicates(["profile", "group_name"])
    changed = rules.select("profile", "group_name").distinct().join(s, ["profile", "group_name"], "left_semi").select("profile", F.lit(True).alias("_bump")).distinct()
    j = rules.join(s, ["profile", "group_name"], "left").join(changed, "profile", "left")
    j = j.withColumn("allow_scope_pairs", F.when(F.col("_hit"), F.col("_allow")).otherwise(F.col("allow_scope_pairs"))).withColumn("mask_scope_pairs", F.when(F.col("_hit"), F.col("_mask")).otherwise(F.col("mask_scope_pairs")))
    return j.withColumn("version", F.when(F.col("_bump"), bumped(F.col("version"))).otherwise(F.col("version"))).select(*rules.columns)
