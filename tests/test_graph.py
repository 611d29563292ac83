"""Syncing the knowledge graph: first sight, reruns, changed scopes, removed units."""

import pytest
from pyspark.sql import functions as F

from rolesieve import constants as K
from rolesieve.operators import graph as G

DAY = lambda d: F.lit(f"2024-01-0{d} 00:00:00").cast("timestamp_ntz")


def tables(spark, pairs, name="Sales", users=((7, "An", "n1", 31), (8, "", "n2", 32))):
    make = spark.createDataFrame
    return G.wanted_graph(
        make([(1, "Corp", None), (3, "Branch", 1)], "ou_id int, name string, parent_id int"),
        make([("corp", "HQ", 1), ("n1", name, 3), ("n2", "Tech", 3)], "oui_id string, name string, ou_id int"),
        make([("n1", "corp"), ("n2", "corp"), ("n2", "nowhere")], "oui_id string, parent_oui_id string"),
        make([(31, 3, "Head"), (32, 3, "Clerk")], "position_id long, ou_id int, name string"),
        make([("salary", "Salary", 4), ("email", "E-mail", None), ("odd", "Odd", 9)], "entity_key string, name string, sensitivity int"),
        make(pairs, "entity_key string, tier string, oui_id string, position_id long"),
        make(list(users), "user_id long, name string, oui_id string, position_id long"),
        make([("Contract", "salary"), ("NoSuchType", "salary")], "document_type string, entity_key string"),
    )


PAIRS = [("salary", "allow", "n1", 31), ("salary", "mask", None, 32), ("email", "mask", "n2", None), ("email", "mask", "__ALL__", None), ("odd", "allow", "__ALL__", None), ("odd", "mask", "n1", None)]


def edges_of(edges):
    return {(r["src"], r["type"], r["dst"]) for r in edges.collect()}


def test_first_sync(spark):
    nodes, edges = G.sync_graph(None, None, tables(spark, PAIRS), DAY(1))
    seen = {(r["kind"], r["source"]): r for r in nodes.collect()}
    assert {k for k, _ in seen} == {"static", *G.REWRITTEN} and len({r["id"] for r in seen.values()}) == len(seen)
    assert seen["position_instance", "31:n1"]["name"] == "Head (Sales)" and seen["user_assignment", "8:n2"]["name"] == "?"
    assert seen["org_unit_scope", "3:scope"]["name"] == "BranchScope" and seen["org_unit_instance", "n1"]["unit_kind"] == "3"
    assert {s for k, s in seen if k == "entity_policy_rule_tier"} == {"salary:allow", "salary:mask", "email:mask", "odd:allow"}
    got = edges_of(edges)
    assert {(a, t, b) for a, t, b in got if a in ("salary:allow", "salary:mask", "email:mask", "odd:allow")} == {
        ("salary:allow", "IS_A", "AllowPolicy"), ("salary:allow", "GRANTS", "AllowEntity"), ("salary:allow", "APPLIES_TO", "31:n1"),
        ("salary:mask", "IS_A", "MaskPolicy"), ("salary:mask", "GRANTS", "MaskEntity"), ("salary:mask", "APPLIES_TO", "32:n1"), ("salary:mask", "APPLIES_TO", "32:n2"),
        ("email:mask", "IS_A", "MaskPolicy"), ("email:mask", "GRANTS", "MaskEntity"), ("email:mask", "APPLIES_TO", "n2"), ("email:mask", "APPLIES_TO", "Scope"),
        ("odd:allow", "IS_A", "AllowPolicy"), ("odd:allow", "GRANTS", "AllowEntity"), ("odd:allow", "APPLIES_TO", "Scope"),
    }
    assert {("salary", "IS_A", "SecretEntity"), ("email", "IS_A", "PublicEntity"), ("odd", "IS_A", "PublicEntity"), ("salary", "PROTECTED_BY", "salary:mask")} <= got
    assert {("1", "IS_A", "Enterprise"), ("3", "IS_A", "1"), ("n1", "IS_A", "3:scope"), ("n2", "BELONGS_TO", "corp"), ("31:n1", "IS_A_ROLE_OF", "n1"), ("7:n1", "IS_A", "31:n1"), ("Contract", "CONTAINS", "salary")} <= got
    assert not {b for _, _, b in got} & {"nowhere"} and not {a for a, _, _ in got} & {"NoSuchType"}
    assert {e for e in got if e[0] in {n for n, _, _ in K.STATIC_NODES} and e[1] != "CONTAINS"} == set(K.STATIC_EDGES)


@pytest.fixture(scope="module")
def before(spark):
    nodes, edges = G.sync_graph(None, None, tables(spark, PAIRS), DAY(1))
    return nodes.cache(), edges.cache()


def test_a_second_run_changes_nothing(spark, before):
    nodes, edges = G.sync_graph(*before, tables(spark, PAIRS), DAY(2))
    assert set(nodes.collect()) == set(before[0].collect()) and set(edges.collect()) == set(before[1].collect())


def test_a_changed_scope_replaces_its_edges(spark, before):
    """salary: another seat for allow, no mask any more; email as it was; a new name, a new assignment."""
    pairs = [("salary", "allow", "n2", 32), *PAIRS[2:]]
    nodes, edges = G.sync_graph(*before, tables(spark, pairs, "Retail", [(7, "An", "n1", 32), (9, "Binh", "n2", 31)]), DAY(2))
    old = {(r["kind"], r["source"]): r for r in before[0].collect()}
    new = {(r["kind"], r["source"]): r for r in nodes.collect()}
    assert set(old) - set(new) == {("entity_policy_rule_tier", "salary:mask")} and set(new) - set(old) == {("user_assignment", "9:n2")}
    assert all(new[k]["id"] == old[k]["id"] and new[k]["created_at"] == old[k]["created_at"] for k in new.keys() & old.keys())
    assert new["org_unit_instance", "n1"]["name"] == "Retail" and str(new["user_assignment", "9:n2"]["created_at"]).startswith("2024-01-02")
    a, b = edges_of(before[1]), edges_of(edges)
    assert b - a == {("salary:allow", "APPLIES_TO", "32:n2"), ("7:n1", "IS_A", "32:n1"), ("9:n2", "IS_A", "31:n2")}
    assert {e for e in a - b if "salary:mask" not in e} == {("salary:allow", "APPLIES_TO", "31:n1"), ("7:n1", "IS_A", "31:n1")}
    assert not [e for e in b if "salary:mask" in e] and ("8:n2", "IS_A", "32:n2") in b  # not synced this time: stays


def test_a_removed_node_takes_its_edges(spark, before):
    gone = spark.createDataFrame([("user_assignment", "8:n2"), ("org_unit_instance", "no such")], "kind string, source string")
    nodes, edges = G.sync_graph(*before, tables(spark, PAIRS, users=[(7, "An", "n1", 31)]), DAY(2), gone)
    assert set(before[0].collect()) - set(nodes.collect()) == set(before[0].where("source = '8:n2'").collect())
    assert edges_of(before[1]) - edges_of(edges) == {("8:n2", "IS_A", "32:n2")}


def test_empty_tables_give_the_taxonomy(spark):
    wanted = tuple(x.limit(0) for x in tables(spark, PAIRS))
    nodes, edges = G.sync_graph(None, None, wanted, DAY(1))
    assert nodes.count() == len(K.STATIC_NODES) == 42 and edges_of(edges) == set(K.STATIC_EDGES)
