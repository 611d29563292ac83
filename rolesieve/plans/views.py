"""Input views over the base tables, in a form both Spark and DuckDB run, and the query registry."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rolesieve.operators.tables import bound_batches

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS = {
    "oui_type": "SELECT 1 AS ou_id, 'corp' AS name, CAST(NULL AS INT) AS parent_id UNION ALL SELECT 2, 'region', 1 UNION ALL SELECT 3, 'nation', 2",
    "oui": "SELECT 'corp' AS oui_id, 'corp' AS name, 1 AS ou_id UNION ALL SELECT concat('r', r_regionkey), r_name, 2 FROM region UNION ALL SELECT concat('n', n_nationkey), n_name, 3 FROM nation",
    "oui_parents": "SELECT concat('r', r_regionkey) AS oui_id, 'corp' AS parent_oui_id FROM region UNION SELECT concat('n', n_nationkey), concat('r', n_regionkey) FROM nation UNION SELECT concat('n', n_nationkey), concat('r', (n_regionkey + 1) % 5) FROM nation WHERE n_nationkey % 6 = 0",
    "positions": "SELECT ou_id * 10 + k AS position_id, ou_id, k AS clearance FROM (SELECT 1 AS ou_id UNION ALL SELECT 2 UNION ALL SELECT 3) t CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) c",
    "assignments": "SELECT c_custkey AS user_id, CASE WHEN c_custkey % 100 = 0 THEN 'corp' WHEN c_custkey % 20 = 0 THEN concat('r', c_nationkey % 5) ELSE concat('n', c_nationkey) END AS oui_id, CASE WHEN c_custkey % 100 = 0 THEN 10 WHEN c_custkey % 20 = 0 THEN 20 ELSE 30 END + 1 + (c_custkey * 7 + CAST(floor(c_custkey / 7.0) AS BIGINT)) % 5 AS position_id FROM customer",
    "docs": "SELECT doc_id AS document_id, concat(source, '-', doc_id) AS title, doc_id % 150 AS owner_user_id, 1 + CAST(floor(doc_id / 25.0) AS BIGINT) % 5 AS sensitivity, CASE doc_id % 4 WHEN 0 THEN 'Contract' WHEN 1 THEN 'Policy' WHEN 2 THEN 'Memo' ELSE 'general' END AS document_type, CASE doc_id % 6 WHEN 0 THEN 'review' WHEN 1 THEN 'uploaded' ELSE 'approved' END AS status FROM documents",
    "document_oui": "SELECT doc_id AS document_id, concat('n', doc_id % 25) AS oui_id FROM documents UNION SELECT doc_id, concat('r', doc_id % 5) FROM documents WHERE doc_id % 7 = 0 UNION SELECT doc_id, 'corp' FROM documents WHERE doc_id % 50 = 0",
    "access_requests": "SELECT event_id AS request_id, user_id, event_id % 200 AS document_id, CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'signup' THEN 'approved' WHEN 'click' THEN 'pending' WHEN 'view' THEN 'rejected' ELSE 'revoked' END AS status, ts AS created_at, CASE WHEN event_type = 'purchase' THEN ts + INTERVAL 10 DAY END AS expires_at FROM events",
    "messages": "SELECT conv_id * 1000 + turn AS message_id, conv_id, turn, role, text AS content, CASE WHEN role = 'assistant' THEN max(CASE WHEN role = 'user' THEN conv_id * 1000 + turn END) OVER (PARTITION BY conv_id ORDER BY turn) END AS parent_message_id, CASE WHEN role = 'assistant' THEN CASE (conv_id + turn) % 7 WHEN 0 THEN 'streaming' WHEN 1 THEN 'error' WHEN 2 THEN 'no_answer' ELSE 'success' END END AS status FROM conversations",
    "jobs": "SELECT o_orderkey AS job_id, concat('ingest:', o_orderkey % 400) AS idempotency_key, o_orderkey % 200 AS document_id, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'queued' ELSE 'failed' END AS status, o_orderdate AS created_at FROM orders",
    "traces": "SELECT event_id AS trace_id, user_id, ts AS created_at, value AS total_ms, props AS timings_json FROM events",
    "queries": "SELECT vec_id AS query_id, vec_id % 150 AS user_id, embedding FROM embeddings WHERE vec_id % 20 = 0",
    "text_queries": "SELECT item_id AS query_id, item_id % 150 AS user_id, text FROM benchmark",
    "emails": "SELECT page_id AS message_id, page_id % 150 AS user_id, url AS subject, html AS body_html, page_id % 3 = 0 AS synced FROM pages",
    "chunk_vectors": "SELECT vec_id AS chunk_id, vec_id % 200 AS document_id, 1 + vec_id % 5 AS chunk_sensitivity, embedding FROM embeddings",
    # versions: two a document where its id is even
    "versions": "SELECT doc_id * 10 + 1 AS version_id, doc_id AS document_id, 1 AS version_no FROM documents UNION ALL SELECT doc_id * 10 + 2, doc_id, 2 FROM documents WHERE doc_id % 2 = 0",
    # rules: (profile order) key, action, sensitivity, enabled, style and position of masks
    "rules": "SELECT 0 AS pos, 'email' AS entity_key, 'identity' AS group_name, 'mask' AS action, 3 AS sensitivity, true AS enabled, 10 AS priority, 'full' AS mask_style, CAST(NULL AS VARCHAR(9)) AS mask_position UNION ALL SELECT 1, 'phone', 'identity', 'mask', 3, true, 20, 'partial', 'tail' UNION ALL SELECT 2, 'credential', 'secrets', 'block', 5, true, 30, 'full', CAST(NULL AS VARCHAR(9)) UNION ALL SELECT 3, 'money', 'finance', 'mask', 4, true, 40, 'partial', 'head' UNION ALL SELECT 4, 'person_name', 'identity', 'full', 2, true, 50, 'full', CAST(NULL AS VARCHAR(9)) UNION ALL SELECT 5, 'legacy', 'old', 'mask', 2, false, 60, 'full', CAST(NULL AS VARCHAR(9))",
    # scope pairs of the rules: an id that is null stands for any
    "rule_pairs": "SELECT 'email' AS entity_key, 'mask' AS tier, '__ALL__' AS oui_id, CAST(NULL AS BIGINT) AS position_id UNION ALL SELECT 'phone', 'mask', 'n3', CAST(NULL AS BIGINT) UNION ALL SELECT 'money', 'allow', 'r1', CAST(NULL AS BIGINT) UNION ALL SELECT 'money', 'mask', '__ALL__', CAST(NULL AS BIGINT) UNION ALL SELECT 'person_name', 'allow', '__ALL__', CAST(NULL AS BIGINT) UNION ALL SELECT 'legacy', 'mask', 'n5', 35 UNION ALL SELECT 'phone', 'allow', 'n4', 32 UNION ALL SELECT CASE n_nationkey % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'phone' ELSE 'money' END, CASE WHEN n_nationkey % 2 = 0 THEN 'mask' ELSE 'allow' END, concat('n', n_nationkey), CASE WHEN n_nationkey % 4 < 2 THEN CAST(31 + n_nationkey % 5 AS BIGINT) END FROM nation WHERE n_nationkey > 9",
    # detections: what a detector found, one row each
    "detections": "SELECT doc_id AS document_id, 'email' AS label, n_chars % 7 AS hits FROM documents WHERE text LIKE '%@%' UNION ALL SELECT doc_id, 'credential', 1 FROM documents WHERE text LIKE '%token =%' UNION ALL SELECT doc_id, 'money', doc_id % 3 FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'unknown', 2 FROM documents WHERE doc_id % 11 = 0",
}
#: Views whose text differs: (Spark, DuckDB).
DIALECT = {
    "line_chunks": (
        "SELECT concat(doc_id, ':', pos) AS chunk_id, doc_id AS document_id, CAST(pos AS BIGINT) AS chunk_index, line AS chunk_text FROM (SELECT doc_id, posexplode(split(text, '\\n')) AS (pos, line) FROM documents) t WHERE trim(line) <> ''",
        "SELECT concat(doc_id, ':', pos) AS chunk_id, doc_id AS document_id, pos AS chunk_index, line AS chunk_text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) t WHERE trim(line) <> ''",
    )
}
NAMES = [*VIEWS, *DIALECT]


class Tables:
    """The tables and views of one directory as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        bound_batches(spark)
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in (*BASE, *NAMES):
            raise AttributeError(name)
        if name not in self._made:
            if name in BASE:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                self._made[name] = self.sql(DIALECT[name][0] if name in DIALECT else VIEWS[name])
        return self._made[name]

    def sql(self, text: str, **more: DataFrame) -> DataFrame:
        used = set(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text))
        frames = {n: getattr(self, n) for n in used if n in BASE or n in NAMES} | more
        for n in frames:
            text = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", text)
        return self.spark.sql(text, **frames)


def with_views(sql: str) -> str:
    """DuckDB SQL with the definitions of the views it names put first."""
    need: list[str] = []

    def add(text: str) -> None:
        for n in NAMES:
            if n not in need and re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", text):
                body = DIALECT[n][1] if n in DIALECT else VIEWS[n]
                add(body)
                need.append(n)

    add(sql)
    if not need:
        return sql.strip()
    views = ",\n".join(f"{n} AS ({DIALECT[n][1] if n in DIALECT else VIEWS[n]})" for n in need)
    sql = sql.strip()
    if m := re.match(r"WITH\s+(RECURSIVE\s+)?", sql):
        return f"WITH {m[1] or ''}{views},\n{sql[m.end():]}"
    return f"WITH {views}\n{sql}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query of (Tables) under ``name`` with the DuckDB statement of the same rows."""

    def take(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = with_views(sql)
        return f

    return take


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)
