"""Queries of conversations, citations and memory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rolesieve import constants as K
from rolesieve.functions import text as X
from rolesieve.operators import conversations as C
from rolesieve.plans.text_queries import tokens_sql
from rolesieve.plans.views import query

_done = ", ".join(f"'{x}'" for x in K.DONE_STATUSES)
PAIRS = f"first AS (SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= {K.HISTORY_MESSAGES}), last AS (SELECT parent_message_id, max_by(message_id, turn) AS message_id FROM first WHERE role = 'assistant' GROUP BY 1), pairs AS (SELECT q.conv_id, q.turn, q.message_id AS question_id, q.content AS question, a.message_id AS answer_id, a.content AS answer FROM first q JOIN last l ON l.parent_message_id = q.message_id JOIN messages a ON a.message_id = l.message_id WHERE q.role = 'user' AND (a.status IN ({_done}) OR (a.status = 'streaming' AND length(trim(a.content)) > 10))), placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM pairs)"


def placed(t):
    return C.placed_pairs(t.messages)


@query("qa_pairs", f"WITH {PAIRS} SELECT conv_id, turn, question_id, question, answer_id, answer FROM pairs")
def _(t):
    return C.qa_pairs(C.first_messages(t.messages))


@query("recent_older_split", f"WITH {PAIRS} SELECT conv_id, question_id, CASE WHEN back <= 3 THEN 'recent' ELSE 'older' END AS part FROM placed")
def _(t):
    return placed(t).select("conv_id", "question_id", F.when(F.col("back") <= 3, "recent").otherwise("older").alias("part"))


def words_sql(x: str) -> str:
    return rf"list_distinct(list_filter(regexp_split_to_array(lower({x}), '\s+'), lambda w: w <> ''))"


_rel = f"rel AS (SELECT o.conv_id, o.question_id, o.turn, len(list_intersect({words_sql('o.question')}, {words_sql('n.question')})) AS overlap FROM placed o JOIN placed n ON n.conv_id = o.conv_id AND n.back = 1 WHERE o.back > 3), best AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY overlap DESC, turn) AS rank FROM rel WHERE overlap > 0 QUALIFY rank <= 3)"


def relevant(t):
    """Pairs before the last three that share words with the last question; these tables have no vectors of questions."""
    p = placed(t).withColumn("vector", F.lit(None).cast("array<double>"))
    found = C.relevant_pairs(p.where("back > 3"), p.where("back = 1"), 3).withColumn("overlap", F.col("relevance").cast("long"))
    return found.join(p.select("conv_id", "question_id", "question"), ["conv_id", "question_id"])


@query("relevant_pairs", f"WITH {PAIRS}, {_rel} SELECT conv_id, question_id, overlap, rank FROM best")
def _(t):
    return relevant(t).select("conv_id", "question_id", "overlap", "rank")


#: A conversation's summary is its first message, cut; every third has none.
_summary = "summaries AS (SELECT conv_id, CASE WHEN conv_id % 3 > 0 THEN substr(min_by(text, turn), 1, 200) END AS summary FROM conversations GROUP BY 1)"


@query("build_history", f"WITH {PAIRS}, {_rel}, {_summary}, both_ AS (SELECT conv_id, 1 AS part, rank AS place, question, answer FROM best JOIN pairs USING (conv_id, question_id) UNION ALL SELECT conv_id, 2, -back, question, answer FROM placed WHERE back <= 3), told AS (SELECT conv_id, 0 AS part, 0 AS place, 0 AS k, 'system' AS role, concat('{K.SUMMARY_HEAD.strip()}', chr(10), trim(summary, ' \n\t\r')) AS content FROM summaries WHERE trim(summary, ' \n\t\r') <> '' AND conv_id IN (SELECT conv_id FROM pairs) UNION ALL SELECT conv_id, part, place, 0, 'user', question FROM both_ UNION ALL SELECT conv_id, part, place, 1, 'assistant', answer FROM both_) SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place, k) AS place, role, content FROM told")
def _(t):
    last = placed(t).where("back = 1").select("conv_id", "question", F.lit(None).cast("array<double>").alias("vector"))
    first = t.conversations.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    summaries = first.select("conv_id", F.when(F.col("conv_id") % 3 > 0, F.substring("text", 1, 200)).alias("summary"))
    return C.build_history(t.messages, last, summaries)


@query("question_history", "SELECT conv_id, turn, substr(content, 1, 300) AS question FROM messages WHERE role = 'user' AND trim(content) <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6")
def _(t):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return t.messages.where("role = 'user' and trim(content) <> ''").withColumn("n", F.row_number().over(w)).where("n <= 6").select("conv_id", "turn", F.substring("content", 1, 300).alias("question"))


@query("recent_turns", f"WITH {PAIRS} SELECT conv_id, 4 - back AS place, question, answer FROM placed WHERE back <= 3")
def _(t):
    return placed(t).where("back <= 3").select("conv_id", (4 - F.col("back")).alias("place"), "question", "answer")


#: An answer rests on the first lines of the document that has its conversation's number, and masks what was detected there.
@query("conversation_view", f"""WITH last AS (SELECT parent_message_id, max_by(message_id, turn) AS answer_id FROM messages WHERE role = 'assistant' AND status IN ({_done}) AND content <> '' GROUP BY 1),
src AS (SELECT document_id, count(*) AS n, string_agg(chunk_text, chr(10) ORDER BY chunk_index) AS shown FROM line_chunks WHERE chunk_index < 3 GROUP BY 1),
granted AS (SELECT DISTINCT user_id, document_id, CASE WHEN user_id % 2 = 0 THEN 'money' ELSE 'unknown' END AS label FROM access_requests WHERE status = 'approved'),
masked AS (SELECT DISTINCT document_id, label FROM detections),
pend AS (SELECT m.document_id, string_agg(m.label, ',' ORDER BY m.label) AS pending FROM masked m LEFT JOIN granted g ON g.document_id = m.document_id AND g.label = m.label AND g.user_id = m.document_id % 150 WHERE g.label IS NULL GROUP BY 1)
SELECT q.conv_id, q.conv_id % 150 AS user_id, q.message_id, a.message_id AS answer_id, a.content AS answer, a.status, CASE WHEN a.message_id IS NOT NULL THEN coalesce(p.pending, '') END AS pending, CASE WHEN a.message_id IS NULL THEN 0 ELSE coalesce(s.n, 0) END AS sources, CASE WHEN a.message_id IS NULL THEN '' ELSE coalesce(s.shown, '') END AS shown
FROM (SELECT * FROM messages WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= {K.LISTED_MESSAGES}) q LEFT JOIN last l ON l.parent_message_id = q.message_id LEFT JOIN messages a ON a.message_id = l.answer_id LEFT JOIN src s ON s.document_id = q.conv_id LEFT JOIN pend p ON p.document_id = q.conv_id""")
def _(t):
    answers = t.messages.where("role = 'assistant'").select("message_id", F.col("conv_id").alias("document_id"))
    titles = t.docs.select("document_id", "title")
    lines = t.line_chunks.where("chunk_index < 3").select("document_id", F.col("chunk_index").cast("int").alias("pos"), F.col("chunk_text").alias("excerpt"))
    sources = answers.join(lines, "document_id").join(titles, "document_id")
    masks = answers.join(t.detections.select("document_id", F.col("label").alias("entity_type")), "document_id")
    kind = F.when(F.col("user_id") % 2 == 0, "money").otherwise("unknown")
    grants = t.access_requests.where("status = 'approved'").select("user_id", "document_id", kind.alias("entity_type")).distinct().join(answers, "document_id")
    viewers = t.conversations.select("conv_id", (F.col("conv_id") % 150).alias("user_id")).distinct()
    v = C.conversation_view(t.messages, viewers, sources, masks, grants)
    excerpts = F.array_join(F.transform("sources", lambda s: s["excerpt"]), "\n")
    return v.select("conv_id", "user_id", "message_id", F.col("answer.id").alias("answer_id"), F.col("answer.content").alias("answer"), "answer.status", F.array_join("answer.pending", ",").alias("pending"), F.size("sources").cast("long").alias("sources"), excerpts.alias("shown"))


def _cited(t):
    tail = F.concat(F.lit(" [Nguồn: "), (1 + F.col("turn") % 4).cast("string"), F.lit("] and [2][9]"))
    return t.messages.where("role = 'assistant'").select("message_id", F.concat("content", tail).alias("answer"))


@query("normalize_citation_labels")
def _(t):
    return _cited(t).select("message_id", X.normalize_citation_labels(F.col("answer")).alias("answer"))


#: Each answer may cite the questions of its conversation, the latest first.
_cit = "listed AS (SELECT conv_id, list(message_id ORDER BY turn DESC) AS ids FROM messages WHERE role = 'user' GROUP BY 1), cit AS (SELECT message_id, ids, list_sort(list_distinct(list_transform(regexp_extract_all(concat(content, ' [', 1 + turn % 4, '] and [2][9]'), '\\[(\\d+)\\]', 1), lambda x: CAST(x AS INT)))) AS idx FROM messages LEFT JOIN listed USING (conv_id) WHERE role = 'assistant')"


def sources_of(t):
    """Answers with citations and, as their sources, the questions of the conversation, the latest first."""
    asked = t.messages.where("role = 'user'")
    source = F.struct(F.col("message_id").alias("source_id"), F.concat(F.lit("Q"), F.col("turn").cast("string")).alias("document_title"), F.lit(None).cast("string").alias("section_path"), F.col("content").alias("excerpt"), F.substring("content", 1, 40).alias("surrounding_context"), F.lit(False).alias("restricted"))
    listed = asked.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("turn")).alias("n"), source.alias("s")))), lambda x: x["s"]).alias("sources"))
    text = F.concat("content", F.lit(" ["), (1 + F.col("turn") % 4).cast("string"), F.lit("] and [2][9]"))
    return t.messages.where("role = 'assistant'").select("message_id", "conv_id", text.alias("answer")).join(listed, "conv_id", "left")


@query("cited_sources", f"WITH {_cit} SELECT message_id, CAST(i AS BIGINT) AS new, ids[idx[i]] AS source_id FROM (SELECT message_id, ids, list_filter(idx, lambda x: x BETWEEN 1 AND len(ids)) AS idx, unnest(range(1, len(list_filter(idx, lambda x: x BETWEEN 1 AND len(ids))) + 1)) AS i FROM cit)")
def _(t):
    """Every cited source of every answer, however many, by its new place."""
    rows = C.cite_sorted(sources_of(t)).select("message_id", F.posexplode("sources").alias("pos", "s"))
    return rows.select("message_id", (F.col("pos") + 1).cast("long").alias("new"), F.col("s.source_id").alias("source_id"))


@query("renumber_by_appearance")
def _(t):
    """Answers with citations by first appearance, and the four shown fields of their sources without hidden lines."""
    done = C.cite_by_appearance(sources_of(t).withColumn("allowed", F.lit(None).cast("array<int>")))
    return done.select("message_id", "answer", F.to_json("sources").alias("sources"))


@query("fallback_answer", "SELECT document_id, string_agg(substr(chunk_text, 1, 200), chr(10) || chr(10) ORDER BY chunk_index) AS answer FROM (SELECT * FROM line_chunks QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) <= 5) GROUP BY 1")
def _(t):
    w = Window.partitionBy("document_id").orderBy("chunk_index")
    best = t.line_chunks.withColumn("n", F.row_number().over(w)).where("n <= 5")
    return best.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", F.substring("chunk_text", 1, 200).alias("x")))), lambda s: s["x"]), "\n\n").alias("answer"))


@query("dedupe_client_messages", "SELECT message_id FROM messages QUALIFY row_number() OVER (PARTITION BY conv_id, turn // 2 ORDER BY turn) = 1")
def _(t):
    w = Window.partitionBy("conv_id", F.floor(F.col("turn") / 2)).orderBy("turn")
    return t.messages.withColumn("n", F.row_number().over(w)).where("n = 1").select("message_id")


@query("reject_oversized", "SELECT message_id, length(content) > 2000 AS blocked FROM messages WHERE role = 'user'")
def _(t):
    return t.messages.where("role = 'user'").select("message_id", (F.length("content") > 2000).alias("blocked"))


@query("open_conversations", "SELECT conv_id % 150 AS user_id, conv_id, max(turn) AS last_turn, row_number() OVER (PARTITION BY conv_id % 150 ORDER BY conv_id DESC) AS place FROM conversations WHERE conv_id % 4 <> 0 GROUP BY conv_id")
def _(t):
    u = F.col("conv_id") % 150
    c = t.conversations.where("conv_id % 4 <> 0").groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    return c.select(u.alias("user_id"), "conv_id", "last_turn", F.row_number().over(Window.partitionBy(u).orderBy(F.desc("conv_id"))).cast("long").alias("place"))
