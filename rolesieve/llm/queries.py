"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesieve.llm.base import read


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rolesieve.llm.piece_codec import encode_documents

    return encode_documents(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))


def _fold(n: int, k: int):
    """Whether crc32(doc_id as text) mod n is k."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == k


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rolesieve.llm.pivot_index import near_vectors

    return near_vectors(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op2_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rolesieve.llm.cross_entropy import cross_entropy_difference

    target = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    scored = cross_entropy_difference(read(spark, sf_dir, "documents", "doc_id", "text"), target)
    return scored.select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "difference")))


OP2_SQL = """
WITH words AS (
  SELECT doc_id, list_concat(list_concat(['<s>'], list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')), ['</s>']) AS w FROM documents),
marked AS (
  SELECT doc_id, unnest(w[:-2]) AS h, unnest(w[2:]) AS w, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS t FROM words),
own AS (SELECT doc_id, t, h, w, count(*) AS c FROM marked GROUP BY ALL),
own_h AS (SELECT doc_id, h, sum(c) AS c FROM own GROUP BY ALL), own_w AS (SELECT doc_id, w, sum(c) AS c FROM own GROUP BY ALL), own_n AS (SELECT doc_id, sum(c) AS c FROM own GROUP BY ALL),
pairs AS (SELECT h, w, coalesce(sum(c) FILTER (WHERE NOT t), 0) AS b, coalesce(sum(c) FILTER (WHERE t), 0) AS t FROM own GROUP BY ALL),
contexts AS (SELECT h, sum(b) AS b, sum(t) AS t FROM pairs GROUP BY h),
singles AS (SELECT w, sum(b) AS b, sum(t) AS t FROM pairs GROUP BY w),
sums AS (SELECT count(*) AS v, sum(b)::DOUBLE AS b, sum(t)::DOUBLE AS t, CASE WHEN least(sum(b), sum(t)) > 0 THEN least(sum(b), sum(t))::DOUBLE / sum(b) ELSE 1 END AS rb, CASE WHEN least(sum(b), sum(t)) > 0 THEN least(sum(b), sum(t))::DOUBLE / sum(t) ELSE 1 END AS rt FROM singles),
rest AS (
  SELECT o.doc_id, o.c AS times, n.v, n.rt, n.rb,
    (p.t - CASE WHEN o.t THEN o.c ELSE 0 END)::DOUBLE AS pt, (c.t - CASE WHEN o.t THEN oh.c ELSE 0 END)::DOUBLE AS ct, (s.t - CASE WHEN o.t THEN ow.c ELSE 0 END)::DOUBLE AS st, n.t - CASE WHEN o.t THEN q.c ELSE 0 END AS nt,
    (p.b - CASE WHEN o.t THEN 0 ELSE o.c END)::DOUBLE AS pb, (c.b - CASE WHEN o.t THEN 0 ELSE oh.c END)::DOUBLE AS cb, (s.b - CASE WHEN o.t THEN 0 ELSE ow.c END)::DOUBLE AS sb, n.b - CASE WHEN o.t THEN 0 ELSE q.c END AS nb
  FROM own o JOIN own_h oh USING (doc_id, h) JOIN own_w ow USING (doc_id, w) JOIN own_n q USING (doc_id) JOIN pairs p USING (h, w) JOIN contexts c USING (h) JOIN singles s USING (w), sums n),
losses AS (
  SELECT doc_id, times,
    -ln(CASE WHEN ct > 0 THEN 0.7::DOUBLE * pt / ct + (1 - 0.7::DOUBLE) * (rt * st + 0.1::DOUBLE) / (rt * nt + 0.1::DOUBLE * v) ELSE (rt * st + 0.1::DOUBLE) / (rt * nt + 0.1::DOUBLE * v) END) AS lt,
    -ln(CASE WHEN cb > 0 THEN 0.7::DOUBLE * pb / cb + (1 - 0.7::DOUBLE) * (rb * sb + 0.1::DOUBLE) / (rb * nb + 0.1::DOUBLE * v) ELSE (rb * sb + 0.1::DOUBLE) / (rb * nb + 0.1::DOUBLE * v) END) AS lb
  FROM rest)
SELECT doc_id, sum(times)::BIGINT AS n_tokens, round(sum(times * lt) / sum(times), 6) AS target_loss, round(sum(times * lb) / sum(times), 6) AS background_loss, round(sum(times * (lt - lb)) / sum(times), 6) AS difference
FROM losses GROUP BY doc_id
"""


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS n, vec_id AS m FROM embeddings UNION SELECT r.n, l.b FROM reach r JOIN links l ON r.m = l.a),
parts AS (SELECT n, min(m) AS c FROM reach GROUP BY n), degree AS (SELECT a, count(*) AS k FROM links GROUP BY a)
SELECT vec_id, coalesce(k, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings JOIN parts ON n = vec_id LEFT JOIN degree ON a = vec_id
"""

OP3_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, unnest(range(0, octet_length(raw) - 49)) AS i, h FROM d WHERE octet_length(raw) >= 50),
windows AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS w FROM starts),
least_doc AS (SELECT w, min(doc_id) AS m FROM windows GROUP BY w),
hits AS (SELECT doc_id, i FROM windows JOIN least_doc USING (w) WHERE m < doc_id),
marks AS (SELECT doc_id, i AS pos, 1 AS s FROM hits UNION ALL SELECT doc_id, i + 50, -1 FROM hits),
steps AS (SELECT doc_id, pos, sum(s) AS s FROM marks GROUP BY ALL),
depth AS (SELECT doc_id, pos, sum(s) OVER (PARTITION BY doc_id ORDER BY pos) AS n, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS till FROM steps),
runs AS (SELECT doc_id, pos, till, coalesce(lag(n) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS before, n FROM depth),
gone AS (SELECT doc_id, sum(till - pos) FILTER (WHERE n > 0) AS removed, count(*) FILTER (WHERE n > 0 AND before = 0) AS spans FROM runs GROUP BY doc_id),
cuts AS (
  SELECT doc_id, pos AS a, till AS b FROM runs WHERE n = 0 AND till IS NOT NULL
  UNION ALL SELECT doc_id, max(pos), NULL FROM runs GROUP BY doc_id
  UNION ALL SELECT doc_id, 0, min(pos) FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, CASE WHEN b IS NULL THEN length(h) ELSE 2 * (b - a) END), '' ORDER BY a, b NULLS LAST) AS h FROM cuts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(raw) AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(CASE WHEN kept.doc_id IS NULL THEN raw ELSE unhex(coalesce(kept.h, '')) END) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP5_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM documents),
runs AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i : i + 4], ' '))) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY 1),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM runs a JOIN runs b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * k >= 8 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS n, doc_id AS m FROM documents UNION SELECT r.n, l.b FROM reach r JOIN links l ON r.m = l.a),
parts AS (SELECT n, min(m) AS c FROM reach GROUP BY n), degree AS (SELECT a, count(*) AS k FROM links GROUP BY a)
SELECT doc_id, coalesce(k, 0) AS n_links, c AS class_id, doc_id = c AS kept FROM documents JOIN parts ON n = doc_id LEFT JOIN degree ON a = doc_id
"""


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rolesieve.llm.suffix_dedup import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rolesieve.llm.html_text import extract_pages

    return extract_pages(read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op5_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rolesieve.llm.jaccard_forest import near_copies

    return near_copies(read(spark, sf_dir, "documents", "doc_id", "text"))


def op6_routed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rolesieve.llm.routed_search import search

    return search(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rolesieve.llm.packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("word_bpe_49k.json"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rolesieve.llm import quality_pu

    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    model = quality_pu.train(docs, read(spark, sf_dir, "labels"))
    return quality_pu.score_documents(docs, model).select("doc_id", _fold(3, 1).alias("held_out"), "score", "predicted")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rolesieve.llm import toxic_crf

    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    model = toxic_crf.train(docs, read(spark, sf_dir, "labels"))
    return toxic_crf.score_documents(docs, model).select("doc_id", _fold(4, 2).alias("held_out"), "score", "predicted", "n_spans", "spans")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rolesieve.llm.periodic_runs import periodic_runs, planted

    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    found = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    best = lambda c: F.col(f"best.{c}")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(best(c).alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * best("length") / best("period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Five-word stretches that come back q words later lie side by side wherever a run has period q.
OP11_SQL = """
WITH raw AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
hashed AS (
  SELECT *, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) AS h FROM raw),
moved AS (SELECT *, len(ws) AS n, h // 10 AS g FROM hashed),
steps AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM moved WHERE h % 10 = 0 AND n > 0),
d AS (
  SELECT k, list_transform(range(0, n), lambda i: ws[CASE WHEN i < a THEN i + 1 ELSE a + (i - a) % p + 1 END]) AS w FROM steps
  UNION ALL SELECT k, ws FROM moved WHERE h IS NULL OR h % 10 <> 0 OR n = 0),
fives AS (SELECT k, i, md5(array_to_string(w[i + 1 : i + 5], ' ')) AS f FROM (SELECT k, w, unnest(range(0, greatest(len(w) - 4, 0))) AS i FROM d)),
same AS (SELECT a.k, a.i, b.i - a.i AS q FROM fives a JOIN fives b ON a.k = b.k AND a.f = b.f AND b.i > a.i),
lined AS (SELECT *, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS line FROM same),
stretches AS (SELECT k, q, min(i) AS s, count(*) + 4 + q AS l FROM lined GROUP BY k, q, line),
runs AS (SELECT k, s, l, min(q) AS q FROM stretches WHERE l >= greatest(6, 4 * q) GROUP BY k, s, l),
best AS (SELECT k, s, l, q FROM runs QUALIFY row_number() OVER (PARTITION BY k ORDER BY l::DOUBLE / q DESC, s, q) = 1),
sums AS (SELECT k, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM runs GROUP BY k),
gone AS (SELECT k, list(DISTINCT i) AS gone FROM (SELECT k, unnest(range(s + q, s + l)) AS i FROM runs) GROUP BY k),
left_ AS (
  SELECT d.k, array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i - 1)) END, ' ') AS t
  FROM d LEFT JOIN gone USING (k))
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period, 1000 * l // q AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(t) AS collapsed_sha256
FROM raw JOIN left_ USING (k) LEFT JOIN sums USING (k) LEFT JOIN best USING (k)
"""


def op12_shared_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rolesieve.llm.shared_search import ranked_search

    return ranked_search(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))


OP12_SQL = """
WITH words AS (
  SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
sizes AS (SELECT doc_id, k, len(ws) AS n FROM words),
total AS (SELECT count(*) AS nn, sum(n)::BIGINT AS l FROM sizes WHERE n > 0),
asked AS (
  SELECT r, item_id, t, count(*) AS reps
  FROM (SELECT row_number() OVER () AS r, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark)
  GROUP BY ALL),
posts AS (SELECT k, t, count(*) AS tf FROM (SELECT k, unnest(ws) AS t FROM words) WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
weights AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM posts, total GROUP BY t, nn),
parts AS (SELECT k, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // l))) AS c FROM posts JOIN weights USING (t) JOIN sizes USING (k), total),
scored AS (SELECT r, item_id, k, sum(reps * c)::BIGINT AS score FROM asked JOIN parts USING (t) GROUP BY r, item_id, k)
SELECT item_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored JOIN sizes USING (k) WHERE score > 0 QUALIFY rank <= 20
"""


def op13_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rolesieve.llm import language_mixture

    model = language_mixture.train(read(spark, sf_dir, "documents", "doc_id", "text", "lang").where(~_fold(4, 2)))
    scored = language_mixture.predict_languages(read(spark, sf_dir, "documents", "doc_id", "text"), model)
    return scored.select("doc_id", _fold(4, 2).alias("held_out"), "lang_pred", "score", "languages")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_near_vectors": OP1_SQL, "op2_cross_entropy": OP2_SQL, "op3_suffix_dedup": OP3_SQL, "op5_near_copies": OP5_SQL, "op11_periodic_runs": OP11_SQL, "op12_shared_search": OP12_SQL}
