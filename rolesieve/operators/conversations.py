"""Citations of answers and the questions of a conversation that matter to the present one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolesieve import constants as K
from rolesieve.functions import text as X

CITED = r"\[(\d+)\]"


def cited_numbers(answer: Column) -> Column:
    """Cited numbers, each once, in order of first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(CITED), 1), lambda x: x.cast("int")))


def renumbered(answer: Column, order: Column, drop_rest: bool) -> Column:
    """[n] becomes the place of n in ``order``; other citations go or stay.

    The new numbers stand between control characters until all old ones are gone, so that none is replaced twice.
    """
    plain = F.regexp_replace(answer, r"\[0*(\d+)\]", "[$1]")
    marked = F.aggregate(F.transform(order, lambda n, i: F.struct(n.alias("old"), (i + 1).alias("new"))), plain, lambda text, x: F.replace(text, F.concat(F.lit("["), x["old"].cast("string"), F.lit("]")), F.concat(F.lit("\u0002"), x["new"].cast("string"), F.lit("\u0003"))))
    rest = F.regexp_replace(marked, r"\[\d+\]", "") if drop_rest else marked
    return F.regexp_replace(rest, "\u0002(\\d+)\u0003", "[$1]")


def sources_at(sources: Column, order: Column) -> Column:
    """The sources (from 1) that ``order`` names, in its order; numbers out of range name none."""
    return F.transform(F.filter(order, lambda n: (n >= 1) & (n <= F.size(sources))), lambda n: F.element_at(sources, n))


def cite_sorted(rows: DataFrame) -> DataFrame:
    """Citations numbered anew from 1 in sorted order, with one source each; rows: answer, sources and any others.

    An answer without citations stays and has no sources; so has a null or empty one.
    """
    text = X.normalize_citation_labels(F.col("answer"))
    j = rows.withColumn("answer", F.when(F.length("answer") > 0, text).otherwise(F.col("answer")))
    j = j.withColumn("_cited", F.coalesce(F.array_sort(cited_numbers(F.col("answer"))), F.array().cast("array<int>")))
    j = j.withColumn("sources", sources_at(F.coalesce("sources", F.slice("sources", 1, 0)), F.col("_cited")))
    return j.withColumn("answer", F.when(F.size("_cited") > 0, renumbered(F.col("answer"), F.col("_cited"), False)).otherwise(F.col("answer"))).drop("_cited")


#: Fields of a source that a reader sees.
SHOWN_FIELDS = ["document_title", "section_path", "excerpt", "surrounding_context"]


def cleaned(source: Column, fields: list[str]) -> Column:
    for f in fields:
        source = source.withField(f, X.drop_hidden_lines(F.coalesce(source[f], F.lit(""))))
    return source


def cite_by_appearance(rows: DataFrame) -> DataFrame:
    """Citations numbered anew by first appearance, hidden lines gone; rows: answer, sources, allowed and any others.

    ``sources`` is array<struct<..., restricted>>, ``allowed`` the numbers that may be cited (null: all).
    Citations out of range or not allowed go, and with them their sources; hidden lines go from the
    ``SHOWN_FIELDS`` that the sources have, a null one becomes empty.
    An answer that cites nothing keeps its restricted sources, so that access can be asked for.
    """
    j = rows.withColumn("answer", X.normalize_citation_labels(X.drop_hidden_lines(F.coalesce("answer", F.lit("")))))
    in_range = F.filter(cited_numbers(F.col("answer")), lambda n: (n >= 1) & (n <= F.coalesce(F.size("sources"), F.lit(0))))
    j = j.withColumn("_any", F.size(cited_numbers(F.col("answer"))) > 0)
    j = j.withColumn("_order", F.filter(in_range, lambda n: F.col("allowed").isNull() | F.array_contains("allowed", n)))
    told = [f for f in SHOWN_FIELDS if f in rows.schema["sources"].dataType.elementType.names]
    kept = F.transform(sources_at(F.col("sources"), F.col("_order")), lambda s: cleaned(s, told))
    closed = F.filter("sources", lambda s: F.coalesce(s["restricted"], F.lit(False)))
    j = j.withColumn("sources", F.when(F.col("_any"), kept).otherwise(closed))
    tidy = F.regexp_replace(F.regexp_replace(renumbered(F.col("answer"), F.col("_order"), True), r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")
    return j.withColumn("answer", F.when(F.col("_any"), F.regexp_replace(tidy, r"^\s+|\s+$", "")).otherwise(F.col("answer"))).drop("_any", "_order")


def word_set(text: Column) -> Column:
    """Distinct lower-case words, split at white space alone."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of one length; null where either is null or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, dot(a, b) / length)


def relevant_pairs(pairs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k earlier pairs of a conversation nearest to its present question: conv_id, question_id, relevance, rank.

    pairs: conv_id, question_id, turn, question, vector; asked: conv_id, question, vector.  By cosine
    where the conversation's present question and all its pairs have a vector, else by the number of
    words in common, where pairs without any go.  Ties go to the earlier turn; a blank question finds nothing.
    """
    now = asked.where(F.trim("question") != "").select("conv_id", F.col("question").alias("_asked"), F.col("vector").alias("_vector"))
    j = pairs.join(now, "conv_id").withColumn("_near", cosine(F.col("vector").cast("array<double>"), F.col("_vector").cast("array<double>")))
    whole = F.min((F.col("vector").isNotNull() & F.col("_vector").isNotNull()).cast("int")).over(Window.partitionBy("conv_id")) == 1
    j = j.withColumn("_embedded", whole)
    common = F.size(F.array_intersect(word_set(F.col("question")), word_set(F.col("_asked")))).cast("double")
    j = j.withColumn("relevance", F.when(F.col("_embedded"), F.coalesce("_near", F.lit(0.0))).otherwise(common)).where(F.col("_embedded") | (F.col("relevance") > 0))
    order = Window.partitionBy("conv_id").orderBy(F.desc("relevance"), "turn")
    return j.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("conv_id", "question_id", "relevance", "rank")


PARTS = {"source": "struct<pos:int,document_id:bigint,title:string,excerpt:string>", "mask": "string", "granted": "struct<user_id:bigint,entity_type:string>", "shown": "struct<user_id:bigint,content:string>"}


def qa_pairs(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, question_id, question, answer_id, answer): each question with its answer.

    messages: conv_id, turn, message_id, role, content, parent_message_id, status.  The last answer that names a
    question as its parent is its answer, if it is finished (``DONE_STATUSES``) or is still streaming with more than
    10 characters; else the question has none and makes no pair, even where an earlier answer was finished.
    """
    a = messages.where("role = 'assistant' and parent_message_id is not null").groupBy(F.col("parent_message_id").alias("question_id")).agg(F.max_by(F.struct("message_id", "content", "status"), "turn").alias("a"))
    long = F.length(F.regexp_replace(F.coalesce("a.content", F.lit("")), r"(?U)^\s+|\s+$", "")) > 10
    a = a.where(F.col("a.status").isin(K.DONE_STATUSES) | ((F.col("a.status") == "streaming") & long))
    q = messages.where("role = 'user'").select("conv_id", "turn", F.col("message_id").alias("question_id"), F.col("content").alias("question"))
    return q.join(a, "question_id").select("conv_id", "turn", "question_id", "question", F.col("a.message_id").alias("answer_id"), F.col("a.content").alias("answer"))


def first_messages(messages: DataFrame, most: int = K.HISTORY_MESSAGES) -> DataFrame:
    """The first ``most`` messages of each conversation: what its memory is made from."""
    return messages.withColumn("_n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where(F.col("_n") <= most).drop("_n")


def placed_pairs(messages: DataFrame) -> DataFrame:
    """``qa_pairs`` of the first messages with back: 1 for a conversation's last pair, 2 for the one before it, ..."""
    return qa_pairs(first_messages(messages)).withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))).cast("long"))


def build_history(messages: DataFrame, asked: DataFrame, summaries: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """(conv_id, place, role, content): what a prompt is told of each conversation, in order from 1.

    First the summary (conv_id, summary) unless blank, then the pairs before the last three that are nearest to the
    question now asked (conv_id, question, vector), nearest first, then the last three, oldest first; a
    question and its answer are a row each.  ``vectors`` (question_id, vector) gives those of past questions; without
    them nearness counts words.  A conversation without pairs has no history.
    """
    p = placed_pairs(messages)
    older = p.where(F.col("back") > K.RECENT_PAIRS)
    older = older.join(vectors, "question_id", "left") if vectors is not None else older.withColumn("vector", F.lit(None).cast("array<double>"))
    near = relevant_pairs(older, asked, K.RELEVANT_PAIRS).select("conv_id", "question_id", "rank")
    both = lambda df, part, place: df.select("conv_id", F.lit(part).alias("part"), place.alias("at"), F.posexplode(F.array(F.struct(F.lit("user").alias("role"), F.coalesce("question", F.lit("")).alias("content")), F.struct(F.lit("assistant").alias("role"), F.coalesce("answer", F.lit("")).alias("content")))).alias("k", "m"))
    blank = F.regexp_replace(F.coalesce("summary", F.lit("")), r"(?U)^\s+|\s+$", "")
    summary = summaries.select("conv_id", blank.alias("summary")).where("summary <> ''").join(p.select("conv_id").distinct(), "conv_id", "left_semi")
    told = summary.select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"), F.lit(0).alias("k"), F.struct(F.lit("system").alias("role"), F.concat(F.lit(K.SUMMARY_HEAD), "summary").alias("content")).alias("m"))
    rows = told.unionByName(both(near.join(p, ["conv_id", "question_id"]), 1, F.col("rank"))).unionByName(both(p.where(F.col("back") <= K.RECENT_PAIRS), 2, -F.col("back")))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("part", "at", "k"))
    return rows.select("conv_id", place.cast("long").alias("place"), "m.role", "m.content")


def conversation_view(messages: DataFrame, viewers: DataFrame, sources: DataFrame, masks: DataFrame, grants: DataFrame, revealed: DataFrame | None = None, most: int = K.LISTED_MESSAGES) -> DataFrame:
    """(conv_id, user_id, message_id, content, answer, sources): each question as its reader sees it, with its answer.

    messages as in ``qa_pairs``; viewers: conv_id, user_id; sources: message_id, pos, document_id, title,
    excerpt; masks: message_id, entity_type; grants: user_id, message_id, entity_type; revealed (``reveal_values``):
    message_id, user_id, content; the message of all these is the answer.  ``answer`` is a struct of id,
    content (with what this reader was granted), status and pending (masked types not granted to the reader,
    sorted), null where no finished answer with content is there; of several the last.  ``sources``
    are in order.  The first ``most`` questions of a conversation are listed.

    What belongs to an answer is gathered in one grouping by message, and meets its question once.
    """
    done = (F.col("role") == "assistant") & F.col("status").isin(K.DONE_STATUSES) & F.coalesce(F.col("content") != "", F.lit(False)) & F.col("parent_message_id").isNotNull()
    last = messages.where(done).groupBy("parent_message_id").agg(F.max_by(F.struct("message_id", "content", "status"), "turn").alias("a"))

    def part(df, kind, value):
        return df.select("message_id", *[(value if k == kind else F.lit(None)).cast(t).alias(k) for k, t in PARTS.items()])

    parts = part(sources, "source", F.struct("pos", "document_id", "title", "excerpt")).unionByName(part(masks.where("entity_type <> ''"), "mask", F.col("entity_type"))).unionByName(part(grants, "granted", F.struct("user_id", "entity_type")))
    if revealed is not None:
        parts = parts.unionByName(part(revealed, "shown", F.struct("user_id", "content")))
    held = parts.groupBy("message_id").agg(F.array_sort(F.collect_list("source")).alias("sources"), *[F.collect_set(k).alias(k) for k in ("mask", "granted", "shown")])
    answers = last.select("parent_message_id", "a.*").join(held, "message_id", "left").withColumnRenamed("message_id", "answer_id").withColumnRenamed("parent_message_id", "message_id").withColumnRenamed("content", "said")
    asked = messages.where("role = 'user'").withColumn("_n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where(F.col("_n") <= most)
    j = asked.select("conv_id", "message_id", "content").join(viewers.select("conv_id", "user_id"), "conv_id").join(answers, "message_id", "left")
    own = lambda c, f: F.transform(F.filter(F.col(c), lambda g: g["user_id"].eqNullSafe(F.col("user_id"))), lambda g: g[f])
    pending = F.coalesce(F.array_sort(F.array_except("mask", own("granted", "entity_type"))), F.array().cast("array<string>"))
    content = F.coalesce(F.get(own("shown", "content"), F.lit(0)), F.col("said"))
    answer = F.when(F.col("answer_id").isNotNull(), F.struct(F.col("answer_id").alias("id"), content.alias("content"), "status", pending.alias("pending")))
    return j.select("conv_id", "user_id", "message_id", "content", answer.alias("answer"), F.coalesce("sources", F.array().cast(f"array<{PARTS['source']}>")).alias("sources"))
