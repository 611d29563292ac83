"""The organisation graph and who may see which document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolesieve.operators.tables import written


def org_closure(parents: DataFrame) -> DataFrame:
    """(descendant, ancestor) pairs of a multi-parent graph, each once, a node never with itself.

    Pairs are lengthened by one edge a round until no new ones appear, so a diamond's two paths are one
    pair from the round they meet in; rounds are as many as the graph is deep.
    """
    edges = written(parents.select(F.col("oui_id").alias("descendant"), F.col("parent_oui_id").alias("ancestor")).where("descendant <> ancestor").distinct())
    known, new = [edges], edges
    step = edges.select(F.col("descendant").alias("ancestor"), F.col("ancestor").alias("up"))
    while True:
        longer = new.join(step, "ancestor").select("descendant", F.col("up").alias("ancestor")).where("descendant <> ancestor").distinct()
        new = written(longer.join(reduce(DataFrame.unionAll, known), ["descendant", "ancestor"], "left_anti"))
        if new.isEmpty():
            return reduce(DataFrame.unionAll, known)
        known.append(new)


def org_root(parents: DataFrame) -> DataFrame:
    """(oui_id, root): follow each node's smallest parent to the top; null where that path runs into a cycle.

    The steps double each round, so a chain of n nodes takes log2(n) rounds; what has not
    arrived after more rounds than the nodes can need stands on a cycle.
    """
    up = written(parents.where("oui_id is not null and parent_oui_id is not null").groupBy("oui_id").agg(F.min("parent_oui_id").alias("root")))
    n, at = up.count(), up.withColumn("moved", F.lit(True))
    for _ in range(n.bit_length() + 1):
        over = at.select(F.col("oui_id").alias("root"), F.col("root").alias("further"))
        at = written(at.select("oui_id", "root").join(over, "root", "left").select("oui_id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            break
    return at.select("oui_id", F.when(~F.col("moved"), F.col("root")).alias("root"))


def topo_levels(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """(oui_id, level): the longest path from a root, parents before children; nodes on or below a cycle come last, all at one level.

    Each round places the nodes whose parents are all placed.
    """
    edges = written(parents.join(nodes.select(F.col("oui_id").alias("parent_oui_id")), "parent_oui_id", "left_semi").select("oui_id", "parent_oui_id").distinct())
    left = written(nodes.select("oui_id").distinct())
    done, level = [], 0
    while True:
        waits = edges.join(left.select(F.col("oui_id").alias("parent_oui_id")), "parent_oui_id", "left_semi").select("oui_id").distinct()
        ready = written(left.join(waits, "oui_id", "left_anti"))
        if ready.isEmpty():
            done.append(left.withColumn("level", F.lit(level)))
            return reduce(DataFrame.unionAll, done)
        done.append(ready.withColumn("level", F.lit(level)))
        left = written(left.join(ready, "oui_id", "left_anti"))
        level += 1


def expanded_ouis(assignments: DataFrame, closure: DataFrame) -> DataFrame:
    """(user_id, oui_id): own units and everything below."""
    own = assignments.select("user_id", "oui_id")
    below = own.join(closure, F.col("oui_id") == F.col("ancestor")).select("user_id", F.col("descendant").alias("oui_id"))
    return own.unionAll(below).distinct()


def user_branch_ouis(assignments: DataFrame, closure: DataFrame) -> DataFrame:
    """(user_id, oui_id): own units, everything above and everything below."""
    above = assignments.join(closure, F.col("oui_id") == F.col("descendant")).select("user_id", F.col("ancestor").alias("oui_id"))
    return expanded_ouis(assignments, closure).unionAll(above).distinct()


def user_clearance(assignments: DataFrame, positions: DataFrame) -> DataFrame:
    return assignments.join(positions, "position_id", "left").groupBy("user_id").agg(F.greatest(F.lit(1), F.max("clearance")).alias("clearance"))


def assignment_conflicts(assignments: DataFrame, closure: DataFrame, oui: DataFrame, positions: DataFrame) -> DataFrame:
    """(user_id, oui_id, other_oui_id, reason): two assignments on one branch, or a position of another kind of unit."""
    a = assignments.select("user_id", "oui_id").distinct()
    b = a.select("user_id", F.col("oui_id").alias("other_oui_id"))
    pairs = a.join(b, "user_id").where("oui_id <> other_oui_id")
    line = closure.select(F.col("descendant").alias("oui_id"), F.col("ancestor").alias("other_oui_id"))
    branch = pairs.join(line, ["oui_id", "other_oui_id"], "left_semi").withColumn("reason", F.lit("branch"))
    kind = assignments.join(oui.select("oui_id", F.col("ou_id").alias("of_unit")), "oui_id").join(positions.select("position_id", F.col("ou_id").alias("of_position")), "position_id").where("of_unit <> of_position")
    return branch.unionByName(kind.select("user_id", "oui_id", F.lit(None).cast("string").alias("other_oui_id"), F.lit("kind").alias("reason")))


def document_tuples(docs: DataFrame, document_oui: DataFrame, parents: DataFrame, closure: DataFrame, roots: DataFrame) -> DataFrame:
    """(subject, relation, document_id, required): grants at the level of units, never expanded to users."""
    at = document_oui.join(docs.select("document_id", "sensitivity"), "document_id")
    needed = F.least("sensitivity", F.lit(5)).cast("int")
    made = lambda df, subject, relation, required: df.select(subject.alias("subject"), F.lit(relation).alias("relation"), "document_id", required.alias("required"))
    member = lambda c: F.concat(F.lit("oui:"), c, F.lit("#member"))
    owner = made(docs, F.concat(F.lit("user:"), F.col("owner_user_id").cast("string")), "owner", F.lit(1))
    viewer = made(at, member(F.col("oui_id")), "viewer", needed)
    above = made(at.join(parents, "oui_id"), F.concat(F.lit("oui:"), F.col("parent_oui_id"), F.lit("#ancestor_member")), "viewer", needed)
    editor = made(at.join(roots, "oui_id"), member(F.col("root")), "editor", needed)
    public = made(at.where("sensitivity = 1").join(closure, F.col("oui_id") == F.col("ancestor")), member(F.col("descendant")), "viewer", F.lit(1))
    return owner.unionAll(viewer).unionAll(above).unionAll(editor).unionAll(public).groupBy("subject", "relation", "document_id").agg(F.min("required").alias("required"))


def membership_tuples(assignments: DataFrame) -> DataFrame:
    return assignments.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("subject"), F.lit("member").alias("relation"), F.concat(F.lit("oui:"), F.col("oui_id")).alias("object")).distinct()


def subjects_of_users(assignments: DataFrame, closure: DataFrame) -> DataFrame:
    """(user_id, subject): the sets a user is in; ancestor members are members of the unit or of one above it."""
    own = assignments.select("user_id", "oui_id").distinct()
    member = own.select("user_id", F.concat(F.lit("oui:"), F.col("oui_id"), F.lit("#member")).alias("subject"))
    over = own.join(closure, F.col("oui_id") == F.col("ancestor")).select("user_id", F.col("descendant").alias("oui_id")).unionAll(own)
    return member.unionAll(over.select("user_id", F.concat(F.lit("oui:"), F.col("oui_id"), F.lit("#ancestor_member")).alias("subject"))).distinct()


def access_classes(tuples: DataFrame, assignments: DataFrame, positions: DataFrame, closure: DataFrame, relations: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, users, matches): who holds what, by classes of documents of one set of grants and of users of one set of units.

    documents: document_id, owners (array of struct<user_id>), doc_class (null without a grant); users: user_id, clearance,
    units, user_class; matches: doc_class, user_class of which a grant reaches a set of the user's and the clearance suffices.
    All three are as long as what they come from; pairs of users and documents are in none.
    """
    grant, owner = F.struct("subject", "required"), F.struct(F.expr("TRY_CAST(substring(subject, 6) AS BIGINT)").alias("user_id"))
    held = tuples.groupBy("document_id").agg(F.sort_array(F.collect_set(F.when(F.col("relation").isin(relations), grant))).alias("grants"), F.collect_set(F.when(F.col("relation") == "owner", owner)).alias("owners"))
    held = written(held.withColumn("doc_class", F.when(F.size("grants") > 0, F.sha2(F.to_json("grants"), 256))))
    units = assignments.where("user_id is not null").groupBy("user_id").agg(F.sort_array(F.collect_set("oui_id")).alias("units"))
    users = units.join(user_clearance(assignments, positions), "user_id")
    users = written(users.withColumn("user_class", F.sha2(F.to_json(F.struct("units", "clearance")), 256)))
    classes = users.groupBy("user_class").agg(F.first("units").alias("units"), F.first("clearance").alias("clearance"))
    sets = subjects_of_users(classes.select(F.col("user_class").alias("user_id"), F.explode("units").alias("oui_id")), closure).withColumnRenamed("user_id", "user_class")
    needs = held.where("doc_class is not null").groupBy("doc_class").agg(F.first("grants").alias("grants")).select("doc_class", F.explode("grants").alias("g")).select("doc_class", "g.*")
    matches = needs.join(sets.join(classes.select("user_class", "clearance"), "user_class"), "subject").where("clearance >= required").select("doc_class", "user_class").distinct()
    return held.drop("grants"), users, written(matches)


#: Documents that meet a block of users at once.
SLICE = 4


def _blocks(rows: DataFrame, key: str, by: str, block: int, held: Column) -> DataFrame:
    """(key, held): ``held`` of each key's rows as arrays of about ``block``."""
    size = rows.groupBy(key).agg(F.ceil(F.count("*") / block).alias("_n"))
    dealt = rows.where(F.col(key).isNotNull()).join(size, key)
    return dealt.groupBy(key, F.pmod(F.xxhash64(by), "_n").alias("_block")).agg(F.collect_list(held).alias("_held")).drop("_block")


def class_pairs(documents: DataFrame, users: DataFrame, matches: DataFrame, block: int = 4096) -> DataFrame:
    """(user_id and the columns of ``documents`` but doc_class): each row of a class with each user of the classes it matches.

    documents: doc_class and any others, an id first; users: user_id (not null), user_class.  Pairs of blocks move, never
    pairs of rows: these are made in the last step, each once, so that nothing of their size is shuffled or written.
    There a task keeps all rows that generated code makes of one row of its input, so it is given slices of 4 documents
    by a function that is not compiled into that code: 16,384 rows at once instead of 16 million.
    """
    kept = [c for c in documents.columns if c != "doc_class"]
    d = _blocks(documents, "doc_class", kept[0], block, F.struct(*kept)).withColumnRenamed("_held", "_documents")
    u = _blocks(users.select("user_class", "user_id"), "user_class", "user_id", block, F.col("user_id")).withColumnRenamed("_held", "_users")
    pairs = matches.join(d, "doc_class").join(u, "user_class").select("_documents", "_users")
    pairs = pairs.repartition(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # by number, so that few bytes stay many tasks
    slices = F.transform(F.sequence(F.lit(1), F.size("_documents"), F.lit(SLICE)), lambda i: F.slice("_documents", i, F.lit(SLICE)))
    pairs = pairs.select("_users", F.explode(slices).alias("_documents"))
    return pairs.select("_users", F.inline("_documents")).select(F.explode("_users").alias("user_id"), *kept)


def granted_documents(tuples: DataFrame, assignments: DataFrame, positions: DataFrame, closure: DataFrame, relations: list[str], documents: DataFrame | None = None) -> DataFrame:
    """(user_id, document_id) by ownership, or by a grant to a set of the user's whose clearance suffices.

    With ``documents`` (document_id and any others) its columns stand in place of document_id, for each of its rows.
    """
    held, users, matches = access_classes(tuples, assignments, positions, closure, relations)
    owned = held.select("document_id", "doc_class", F.explode("owners").alias("o")).select("document_id", "doc_class", "o.user_id")
    owned = owned.join(users.select("user_id", "user_class"), "user_id", "left").join(matches, ["doc_class", "user_class"], "left_anti").select("user_id", "document_id")
    rows = held.select("document_id", "doc_class")
    if documents is not None:
        owned, rows = owned.join(documents, "document_id").select("user_id", *documents.columns), documents.join(rows, "document_id")
    return class_pairs(rows, users, matches).unionByName(owned)


def viewable_documents(tuples, assignments, positions, closure, documents=None) -> DataFrame:
    return granted_documents(tuples, assignments, positions, closure, ["viewer", "editor"], documents)


def editable_documents(tuples, assignments, positions, closure) -> DataFrame:
    return granted_documents(tuples, assignments, positions, closure, ["editor"])


def file_gate(docs: DataFrame, levels: DataFrame, tuples: DataFrame, assignments: DataFrame, positions: DataFrame, closure: DataFrame, granted: DataFrame, top: str) -> DataFrame:
    """(user_id, document_id): viewable documents that their user may also open.

    Open are those of a member of the unit ``top``, the user's own, those whose level (by ``levels``: document_id, level;
    else the document's sensitivity) the clearance reaches, and those in ``granted`` (user_id, document_id; distinct).
    The first and third hold for whole classes; owned and granted documents are looked at one by one.
    """
    held, users, matches = access_classes(tuples, assignments, positions, closure, ["viewer", "editor"])
    users = users.withColumn("top", F.array_contains("units", top)).drop("units")
    rows = docs.select("document_id", "owner_user_id", "sensitivity").join(levels, "document_id", "left").withColumn("level", F.coalesce("level", "sensitivity")).drop("sensitivity").join(held, "document_id")
    gated = F.concat("doc_class", F.lit(":"), F.coalesce(F.col("level").cast("string"), F.lit("")))
    rows = rows.withColumn("gate_class", gated)
    kinds = users.select("user_class", "clearance", "top").distinct()
    by_class = F.col("top") | F.coalesce(F.col("level") <= F.col("clearance"), F.lit(False))
    opened = written(rows.select("doc_class", "level", "gate_class").distinct().join(matches, "doc_class").join(kinds, "user_class").where(by_class).select("gate_class", "user_class"))
    of_class = class_pairs(rows.select("document_id", F.col("gate_class").alias("doc_class")), users, opened.withColumnRenamed("gate_class", "doc_class"))
    owned = rows.select("*", F.explode("owners").alias("o")).select("document_id", "owner_user_id", "level", "gate_class", "o.user_id")
    owned = owned.join(users, "user_id", "left").join(opened, ["gate_class", "user_class"], "left_anti").join(granted.withColumn("granted", F.lit(True)), ["user_id", "document_id"], "left")
    own = (F.col("owner_user_id") == F.col("user_id")) | F.col("top") | (F.col("level") <= F.coalesce("clearance", F.lit(1))) | F.col("granted")
    asked = rows.join(granted, "document_id").where(~F.exists("owners", lambda o: o["user_id"].eqNullSafe(F.col("user_id"))))
    asked = asked.join(users.select("user_id", "user_class"), "user_id").join(matches, ["doc_class", "user_class"], "left_semi").join(opened, ["gate_class", "user_class"], "left_anti")
    return of_class.unionByName(owned.where(own).select("user_id", "document_id")).unionByName(asked.select("user_id", "document_id"))


def cleared_chunks(requests: DataFrame, chunks: DataFrame, clearance: DataFrame) -> DataFrame:
    """(chunk_id, user_id): chunks of the documents a user asked for that the user's clearance reaches, each once.

    requests: user_id, document_id; chunks: chunk_id (of one document and level), document_id, chunk_sensitivity;
    clearance: user_id, clearance.  A document's chunks of one level meet its users of one clearance as classes.
    """
    of = lambda level: F.concat(F.col("document_id").cast("string"), F.lit(":"), F.col(level).cast("string"))
    asked = requests.where("user_id is not null").select("user_id", "document_id").distinct().join(clearance.where("clearance is not null"), "user_id")
    asked = written(asked.withColumn("user_class", of("clearance")))
    rows = written(chunks.select("chunk_id", "document_id", "chunk_sensitivity").distinct().withColumn("doc_class", of("chunk_sensitivity")))
    left = rows.where("doc_class is not null").select("document_id", "chunk_sensitivity", "doc_class").distinct()
    matches = left.join(asked.select("document_id", "clearance", "user_class").distinct(), "document_id").where("chunk_sensitivity <= clearance")
    return class_pairs(rows.select("chunk_id", "doc_class"), asked, matches.select("doc_class", "user_class")).select("chunk_id", "user_id")


def search_scopes(chunks, docs, tuples, assignments, positions, closure, askers) -> tuple[DataFrame, DataFrame]:
    """(chunk_id, scope) and (scope, user_id): what each asker may be shown, never expanded to users and chunks.

    Public chunks and all of public documents are in the scope of everyone.  Others are in that of the unit
    grants of their document, and in that of its owner where the grants do not reach the owner, so that
    no user is in two scopes of a chunk.  askers: user_id; chunks: chunk_id, document_id, level.
    """
    askers = askers.select("user_id").where("user_id is not null").distinct()
    grants = tuples.where(F.col("relation").isin("viewer", "editor")).groupBy("document_id").agg(F.sort_array(F.collect_set(F.struct("subject", "required"))).alias("grants"))
    grants = grants.withColumn("scope", F.sha2(F.to_json("grants"), 256))
    subjects = subjects_of_users(assignments, closure).join(askers, "user_id", "left_semi").join(user_clearance(assignments, positions), "user_id")
    needs = grants.groupBy("scope").agg(F.first("grants").alias("grants")).select("scope", F.explode("grants").alias("g")).select("scope", "g.*")
    by_unit = needs.join(subjects, "subject").where("clearance >= required").select("scope", "user_id").distinct()
    one = F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    members = by_unit.unionAll(askers.select(F.lit("everyone").alias("scope"), "user_id")).unionAll(askers.select(one.alias("scope"), "user_id"))
    at = chunks.select("chunk_id", "document_id", "level").join(docs.select("document_id", "sensitivity", F.col("owner_user_id").alias("user_id")), "document_id").join(grants.select("document_id", "scope"), "document_id", "left")
    public = F.coalesce(F.col("level") == 1, F.lit(False)) | F.coalesce(F.col("sensitivity") == 1, F.lit(False))
    closed = at.where(~public)
    owned = closed.join(askers, "user_id", "left_semi").join(by_unit, ["scope", "user_id"], "left_anti")
    in_scope = at.where(public).select("chunk_id", F.lit("everyone").alias("scope")).unionAll(closed.where("scope is not null").select("chunk_id", "scope")).unionAll(owned.select("chunk_id", one.alias("scope")))
    return in_scope, members


def active_grants(requests: DataFrame, as_of: str) -> DataFrame:
    """(user_id, document_id) of approved requests that have not expired."""
    return requests.where(F.col("status").eqNullSafe("approved") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of).cast("timestamp_ntz")))).select("user_id", "document_id").distinct()


def expire_grants(requests: DataFrame, as_of: str) -> DataFrame:
    """Requests with those past their time revoked as of ``as_of``."""
    now = F.lit(as_of).cast("timestamp_ntz")
    over = (F.col("status") == "approved") & (F.col("expires_at") <= now)
    return requests.withColumn("resolved_at", F.when(over, now)).withColumn("status", F.when(over, "revoked").otherwise(F.col("status")))


def latest_request_status(requests: DataFrame) -> DataFrame:
    """Newest request of each user and document; of equal times the larger id."""
    newest = F.max_by(F.struct("request_id", "status", "expires_at"), F.struct("created_at", "request_id"))
    return requests.groupBy("user_id", "document_id").agg(newest.alias("r")).select("user_id", "document_id", "r.*")


def user_profile(assignments: DataFrame, positions: DataFrame, oui: DataFrame, kinds: DataFrame) -> DataFrame:
    """user_id, clearance, is_corp, units (sorted names)."""
    rows = assignments.join(positions.drop("ou_id"), "position_id").join(oui, "oui_id").join(kinds.select("ou_id", F.col("parent_id").isNull().alias("top")), "ou_id")
    return rows.groupBy("user_id").agg(F.greatest(F.lit(1), F.max("clearance")).alias("clearance"), F.bool_or("top").alias("is_corp"), F.array_join(F.array_sort(F.collect_set(oui["name"])), ",").alias("units"))


def touched_documents(document_oui: DataFrame, moved: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(document_id): documents whose grants a change of the units in ``moved`` (oui_id) can alter.

    These stand at such a unit, at one below it (their grants go up), or at one above it (public
    ones are granted to all below), by the closure ``before`` or ``after`` the change.  The result is a
    written table: Catalyst pushes a semi join with it below the unions that make the tuples, to each of them.
    """
    units = moved.select("oui_id").where("oui_id is not null").distinct()
    lines = before.unionByName(after).distinct()
    below = lines.join(units.withColumnRenamed("oui_id", "ancestor"), "ancestor", "left_semi").select(F.col("descendant").alias("oui_id"))
    above = lines.join(units.withColumnRenamed("oui_id", "descendant"), "descendant", "left_semi").select(F.col("ancestor").alias("oui_id"))
    return written(document_oui.join(units.unionByName(below).unionByName(above).distinct(), "oui_id", "left_semi").select("document_id").distinct())


TUPLE = ["subject", "relation", "document_id", "required"]


def tuple_changes(old: DataFrame, new: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(op, subject, relation, document_id, required): what to delete and to write so that ``old`` becomes ``new``.

    Both sides are sets of tuples; nulls count as equal.  A changed requirement is a delete and a write.
    With ``documents`` (document_id) only these are compared, and only their tuples change.  One
    shuffle by the whole tuple, so a subject or document that has very many costs no task more than others.
    """
    sides = old.select(*TUPLE, F.lit(1).alias("_side")).unionByName(new.select(*TUPLE, F.lit(2).alias("_side")))
    if documents is not None:
        sides = sides.join(documents.select("document_id").distinct(), "document_id", "left_semi")
    one = sides.groupBy(*TUPLE).agg(F.min("_side").alias("_a"), F.max("_side").alias("_b")).where("_a = _b")
    return one.select(F.when(F.col("_a") == 1, "delete").otherwise("write").alias("op"), *TUPLE)


def apply_tuple_changes(old: DataFrame, changes: DataFrame) -> DataFrame:
    """``old`` without the deletes and with the writes; applied twice it gives the same."""
    step = F.when(F.col("op") == "delete", 1).otherwise(2)
    every = old.select(*TUPLE, F.lit(0).alias("_step")).unionByName(changes.select(*TUPLE, step.alias("_step")))
    return every.groupBy(*TUPLE).agg(F.max("_step").alias("_step")).where("_step <> 1").select(*TUPLE)
