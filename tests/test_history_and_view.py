"""Pairs by status, what a prompt is told, and a conversation as its reader sees it."""

from rolesieve import constants as K
from rolesieve.operators import conversations as C

MESSAGE = "conv_id long, turn long, message_id long, role string, content string, parent_message_id long, status string"


def talk(conv, *turns):
    """Messages from (role, content, parent's turn, status)."""
    return [(conv, i, conv * 1000 + i, role, content, None if parent is None else conv * 1000 + parent, status) for i, (role, content, parent, status) in enumerate(turns)]


def q(text):
    return ("user", text, None, None)


def test_pairs_follow_the_last_answer_and_its_status(spark):
    rows = talk(
        1,
        q("done"), ("assistant", "yes", 0, "success"),
        q("short stream"), ("assistant", "  under ten ", 2, "streaming"),
        q("long stream"), ("assistant", "this is long enough", 4, "streaming"),
        q("failed last"), ("assistant", "first", 6, "success"), ("assistant", "second", 6, "error"),
        q("late"), q("between"), ("assistant", "to between", 10, "blocked"), ("assistant", "to late", 9, "no_answer"),
        q("no answer"), ("assistant", "an orphan", None, "success"), q("null answer"), ("assistant", None, 15, "fallback"),
    )
    df = spark.createDataFrame(rows, MESSAGE)
    got = {r["question"]: (r["answer"], r["answer_id"]) for r in C.qa_pairs(df).collect()}
    assert got == {"done": ("yes", 1001), "long stream": ("this is long enough", 1005), "between": ("to between", 1011), "late": ("to late", 1012), "null answer": (None, 1016)}
    assert {r["question"]: r["back"] for r in C.placed_pairs(df).collect()} == {"null answer": 1, "between": 2, "late": 3, "long stream": 4, "done": 5}
    assert C.first_messages(df, 3).count() == 3 and C.qa_pairs(df.limit(0)).count() == 0


def test_history(spark):
    rows = talk(1, *[m for i, t in enumerate(["tax law", "cat food", "tax rate law", "blue sky", "old tax", "new car"]) for m in (q(t), ("assistant", f"a{i}", 2 * i, "success"))])
    rows += talk(2, q("only"), ("assistant", "one", 0, "success")) + talk(3, q("unanswered"))
    asked = spark.createDataFrame([(1, "which tax law", None), (2, "", None), (3, "x", None)], "conv_id long, question string, vector array<double>")
    summaries = spark.createDataFrame([(1, " So far. "), (2, "  "), (3, "never told"), (4, "no such")], "conv_id long, summary string")
    df = spark.createDataFrame(rows, MESSAGE)
    got: dict[int, list] = {}
    for r in C.build_history(df, asked, summaries).orderBy("conv_id", "place").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["content"]))
    two = lambda text, answer: [("user", text), ("assistant", answer)]
    assert got[1] == [("system", K.SUMMARY_HEAD + "So far."), *two("tax law", "a0"), *two("tax rate law", "a2"), *two("blue sky", "a3"), *two("old tax", "a4"), *two("new car", "a5")]
    assert got[2] == two("only", "one") and 3 not in got
    vectors = spark.createDataFrame([(1000, [1.0, 0.0]), (1002, [0.0, 1.0]), (1004, [0.5, 0.5])], "question_id long, vector array<double>")
    now = spark.createDataFrame([(1, "anything", [0.0, 1.0])], "conv_id long, question string, vector array<double>")
    told = [r["content"] for r in C.build_history(df, now, summaries.limit(0), vectors).where("conv_id = 1 and role = 'user'").orderBy("place").collect()]
    assert told == ["cat food", "tax rate law", "tax law", "blue sky", "old tax", "new car"]


def test_view(spark):
    make = spark.createDataFrame
    rows = talk(1, q("a"), ("assistant", "masked ••", 0, "success"), ("assistant", "", 0, "success"), ("assistant", "x", 0, "streaming"), q("b"), q("c"), ("assistant", "plain", 5, "fallback"))
    messages = make(rows, MESSAGE)
    viewers = make([(1, 7), (1, 8)], "conv_id long, user_id long")
    sources = make([(1001, 2, 20, "T2", "e2"), (1001, 1, 10, "T1", "e1"), (999, 1, 1, "no", "no")], "message_id long, pos int, document_id long, title string, excerpt string")
    masks = make([(1001, "phone"), (1001, "email"), (1001, "email"), (1001, None), (1001, "")], "message_id long, entity_type string")
    grants = make([(7, 1001, "email"), (8, 1006, "email"), (9, 1001, "phone")], "user_id long, message_id long, entity_type string")
    revealed = make([(1001, 7, "masked a@b.vn")], "message_id long, user_id long, content string")
    got = {(r["user_id"], r["message_id"]): r for r in C.conversation_view(messages, viewers, sources, masks, grants, revealed).collect()}
    assert sorted(got) == [(u, m) for u in (7, 8) for m in (1000, 1004, 1005)]
    a, b = got[7, 1000], got[8, 1000]
    assert tuple(a["answer"]) == (1001, "masked a@b.vn", "success", ["phone"]) and tuple(b["answer"]) == (1001, "masked ••", "success", ["email", "phone"])
    assert [tuple(s) for s in a["sources"]] == [(1, 10, "T1", "e1"), (2, 20, "T2", "e2")] == [tuple(s) for s in b["sources"]]
    assert got[7, 1004]["answer"] is None and got[7, 1004]["sources"] == []
    assert tuple(got[8, 1005]["answer"]) == (1006, "plain", "fallback", []) and got[8, 1005]["content"] == "c"
    assert C.conversation_view(messages, viewers, sources, masks, grants, most=1).count() == 2
    assert C.conversation_view(messages.limit(0), viewers, sources, masks, grants).count() == 0


def test_all_shown_fields_lose_hidden_lines(spark):
    hidden = "Lương: " + K.MASKED_VALUE_TEXT
    source = "struct<document_title:string,section_path:string,excerpt:string,surrounding_context:string,restricted:boolean>"
    rows = [(1, "See [2] and [7] and [2].", [("t", "s", "e", "c", False), (f"T\n{hidden}", hidden, f"keep\n{hidden}\nkeep too", None, True)], None)]
    df = spark.createDataFrame(rows, f"message_id long, answer string, sources array<{source}>, allowed array<int>")
    (r,) = C.cite_by_appearance(df).collect()
    assert r["answer"] == "See [1] and and [1]." and [tuple(s) for s in r["sources"]] == [("T", "", "keep\nkeep too", "", True)]
