"""The difference of grants before and after a change of the organisation."""

from rolesieve.operators import organisation as O

TUPLE = "subject string, relation string, document_id long, required int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_two_sided_difference(spark):
    old = spark.createDataFrame([("a", "viewer", 1, 2), ("b", "viewer", 1, 1), (None, "owner", 2, None), ("c", "editor", 3, 1), ("x", "viewer", 9, 1)], TUPLE)
    new = spark.createDataFrame([("a", "viewer", 1, 3), ("b", "viewer", 1, 1), (None, "owner", 2, None), ("d", "editor", 3, 1), ("y", "viewer", 9, 1)], TUPLE)
    changes = O.tuple_changes(old, new, spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "document_id long"))
    assert rows(changes) == sorted([("delete", "a", "viewer", 1, 2), ("write", "a", "viewer", 1, 3), ("delete", "c", "editor", 3, 1), ("write", "d", "editor", 3, 1)], key=str)
    once = O.apply_tuple_changes(old, changes)
    want = sorted([*map(tuple, new.where("document_id <> 9").collect()), ("x", "viewer", 9, 1)], key=str)  # 9 was not touched
    assert rows(once) == want and rows(O.apply_tuple_changes(once, changes)) == want
    assert rows(O.apply_tuple_changes(old, O.tuple_changes(old, new))) == rows(new)
    assert O.tuple_changes(new, new).count() == 0 and O.tuple_changes(new.limit(0), old.limit(0)).count() == 0


def test_a_moved_unit_touches_documents_above_and_below(spark):
    """b moves from under a to under z: a's and z's public documents, its own and those of c below it are touched, not those of k."""
    make = spark.createDataFrame
    parents = lambda up: make([("b", up), ("c", "b"), ("a", "top"), ("z", "top"), ("k", "z")], "oui_id string, parent_oui_id string")
    docs = make([(i, 7, 1 if i < 5 else 3) for i in range(6)], "document_id long, owner_user_id long, sensitivity int")
    at = make([(0, "a"), (1, "b"), (2, "c"), (3, "k"), (4, "z"), (5, "b")], "document_id long, oui_id string")
    old_up, new_up = parents("a"), parents("z")
    before, after = O.org_closure(old_up), O.org_closure(new_up)
    old = O.document_tuples(docs, at, old_up, before, O.org_root(old_up))
    new = O.document_tuples(docs, at, new_up, after, O.org_root(new_up))
    touched = O.touched_documents(at, make([("b",), (None,)], "oui_id string"), before, after)
    assert sorted(r[0] for r in touched.collect()) == [0, 1, 2, 4, 5]
    changes = O.tuple_changes(old, new, touched)
    assert {(r["op"], r["subject"], r["document_id"]) for r in changes.collect()} == {
        ("delete", "oui:b#member", 0), ("delete", "oui:c#member", 0), ("write", "oui:b#member", 4), ("write", "oui:c#member", 4),
        ("delete", "oui:a#ancestor_member", 1), ("write", "oui:z#ancestor_member", 1), ("delete", "oui:a#ancestor_member", 5), ("write", "oui:z#ancestor_member", 5),
    }
    assert rows(O.apply_tuple_changes(old, changes)) == rows(new)
