"""Citations and relevant pairs on rows worked out by hand."""

from rolesieve.operators import conversations as C

ROWS = "id long, answer string, sources array<struct<source_id:long,excerpt:string,restricted:boolean>>, allowed array<int>"
SOURCES = [(10, "one", False), (20, "two\n[SALARY_AMOUNT] x", True), (30, "three", None)]


def test_citations_by_appearance(spark):
    rows = [
        (1, "First [3], then [nguồn: 1, 3]  and [9].\n\n\n\nEnd [2]", SOURCES, None),
        (2, "See [2] and [1]", SOURCES, [1]),
        (3, "Nothing cited", SOURCES, None),
        (4, None, SOURCES, None),
        (5, "[1] [2]", None, None),
        (6, "[12] [2] [1]", [(i, "e", False) for i in range(12)], None),
        (7, "[9]", SOURCES, None),
    ]
    got = {r["id"]: (r["answer"], [s["source_id"] for s in r["sources"] or []]) for r in C.cite_by_appearance(spark.createDataFrame(rows, ROWS)).collect()}
    assert got[1] == ("First [1], then [2][1] and .\n\nEnd [3]", [30, 10, 20])
    assert got[2] == ("See and [1]", [10]) and got[3] == ("Nothing cited", [20]) and got[4] == ("", [20]) and got[5] == ("", [])
    assert got[6] == ("[1] [2] [3]", [11, 1, 0]) and got[7] == ("", [])
    excerpt = C.cite_by_appearance(spark.createDataFrame(rows[:1], ROWS)).first()["sources"][2]["excerpt"]
    assert excerpt == "two"


def test_citations_sorted(spark):
    rows = [(1, "a [3] b [citation: 1] c [9]", SOURCES, None), (2, "none", SOURCES, None), (3, None, SOURCES, None)]
    got = {r["id"]: (r["answer"], [s["source_id"] for s in r["sources"]]) for r in C.cite_sorted(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == {1: ("a [2] b [1] c [3]", [10, 30]), 2: ("none", []), 3: (None, [])}


def test_relevant_pairs_by_vector_or_words(spark):
    pairs = spark.createDataFrame(
        [(1, 11, 1, "red car", [1.0, 0.0]), (1, 12, 2, "blue", [0.6, 0.8]), (1, 13, 3, "x", [0.0, 1.0]), (2, 21, 1, "The red car", None), (2, 22, 2, "a car", [1.0, 0.0]), (2, 23, 3, "sky", None), (3, 31, 1, "car", None)],
        "conv_id long, question_id long, turn long, question string, vector array<double>",
    )
    asked = spark.createDataFrame([(1, "sky", [0.0, 2.0]), (2, "Red CAR,", None), (3, "  ", None)], "conv_id long, question string, vector array<double>")
    got = [(r["conv_id"], r["question_id"], round(r["relevance"], 6)) for r in C.relevant_pairs(pairs, asked, 2).orderBy("conv_id", "rank").collect()]
    assert got == [(1, 13, 1.0), (1, 12, 0.8), (2, 21, 1.0)]  # "CAR," is another word than "car" at white space alone
