"""Table upkeep: idempotent writes, upserts, cascades and metadata."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Have Arrow batches hold 4 MB rather than 10,000 rows of whatever length, where the session says nothing."""
    if spark.conf.get(_BATCH, None) in (None, str((1 << 31) - 1), f"{(1 << 31) - 1}b"):
        spark.conf.set(_BATCH, "4m")


def upsert_by_key(old: DataFrame, new: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Rows of both, for each key the one of greatest ``seq``; of equal ones the new."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.desc(seq), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def replace_version_chunks(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows of the versions that come anew go, the new ones take their place."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def write_version_chunks(new: DataFrame, path: str, key: str) -> None:
    """The same on files: only the partitions of the versions at hand are overwritten, so a rerun changes nothing."""
    new.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def flatten_metadata(scalars: dict[str, Column], nested: dict[str, Column]) -> Column:
    """map<string,string> of what is not null, nested values as JSON."""
    entries = [F.struct(F.lit(k).alias("key"), c.cast("string").alias("value")) for k, c in scalars.items()]
    entries += [F.struct(F.lit(k).alias("key"), F.to_json(c).alias("value")) for k, c in nested.items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def patch_metadata(meta: Column, patch: Column) -> Column:
    """Keys of the patch replace those of the map; a null value becomes empty."""
    patch = F.transform_values(F.coalesce(patch, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: F.coalesce(v, F.lit("")))
    return F.map_concat(F.map_filter(meta, lambda k, v: ~F.array_contains(F.map_keys(patch), k)), patch)


def delete_cascade(tables: dict[str, DataFrame], documents: DataFrame, versions: str = "versions") -> dict[str, DataFrame]:
    """Every table without the rows of the given documents, or of their versions where it has only those."""
    gone = tables[versions].join(documents, "document_id", "left_semi").select("version_id")
    return {n: t.join(documents, "document_id", "left_anti") if "document_id" in t.columns else t.join(gone, "version_id", "left_anti") for n, t in tables.items()}


def parse_bytes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, rejects) of path, content and maybe error: UTF-8 without what cannot be decoded, one page.

    Rejected are files that could not be read (their error is the reason), have no bytes, or no text.
    """
    from rolesieve.functions.text import normalize_text_of

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "text": ["" if c is None else normalize_text_of(bytes(c).decode("utf-8", "ignore")) for c in pdf["content"]], "reason": pdf["reason"]})

    error = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    reason = F.coalesce(error, F.when(F.coalesce(F.octet_length("content"), F.lit(0)) == 0, "no bytes"))
    parsed = files.select("path", "content", reason.alias("reason")).mapInPandas(run, "path string, text string, reason string")
    return parsed.where("text <> ''").select("path", "text", F.lit(1).alias("page")), parsed.where("text = ''").select("path", F.coalesce("reason", F.lit("empty text")).alias("reason"))


def hashing_embedder(dims: int = 32):
    """A deterministic stand-in for an embedding service."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dims)
            for w in t.lower().split():
                h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                v[h[0] % dims] += 1 if h[1] % 2 else -1
            out.append((v / (np.linalg.norm(v) or 1)).tolist())
        return out

    return embed


def embed_batches(rows: DataFrame, embed, batch: int = 64) -> DataFrame:
    """id, embedding: texts go to ``embed`` in batches, an empty text keeps its place with an empty vector."""

    def run(batches):
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            full = [i for i, t in enumerate(texts) if t.strip()]
            out: list[list[float]] = [[] for _ in texts]
            for lo in range(0, len(full), batch):
                for i, v in zip(full[lo : lo + batch], embed([texts[i] for i in full[lo : lo + batch]])):
                    out[i] = v
            yield pd.DataFrame({"id": pdf["id"], "embedding": out})

    return rows.select("id", "text").mapInPandas(run, "id long, embedding array<double>")


def shared_path(spark: SparkSession) -> str:
    """A new path in ``spark.checkpoint.dir``, which all executors share; tests on a local master get a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(named or 'file://' + tempfile.mkdtemp(prefix='rolesieve-')).rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in ``spark.checkpoint.dir``, read back, so that its plan is made and run once."""
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_emails(messages: DataFrame, synced: DataFrame, indexed: DataFrame) -> DataFrame:
    """Messages (user_id, message_id, ...) not synced yet; with an empty index the history counts for nothing."""
    if indexed.isEmpty():
        return messages
    return messages.join(synced.select("user_id", "message_id").distinct(), ["user_id", "message_id"], "left_anti").select(*messages.columns)


def review_transitions(docs: DataFrame, events: DataFrame, jobs: DataFrame, corporate: DataFrame) -> DataFrame:
    """(document_id, event, user_id, status, problem, job_id, job_status, job_error): one event on each document, and its ingest job.

    docs: document_id, status, owner_user_id; events: document_id, event, user_id; jobs: job_id, document_id, status,
    created_at; corporate: user_id of the members of the top unit.  The owner submits an uploaded document, which is then
    in review, or approved where the owner is corporate; corporate users approve or reject what is uploaded or in
    review.  ``ingested`` is the outcome of a job for the user who made it: approved stays, else approved for corporate
    users and review for others.  Approval queues the document's newest job that waits for it, rejection makes the
    document a draft and cancels that job.  A move that is not allowed changes nothing and has its problem: role, owner or status.
    """
    top = corporate.select("user_id").distinct().withColumn("_corp", F.lit(True))
    j = docs.select("document_id", F.col("status").alias("_was"), "owner_user_id").join(events.select("document_id", "event", "user_id"), "document_id").join(top, "user_id", "left")
    corp, event, was = F.coalesce("_corp", F.lit(False)), F.col("event"), F.col("_was")
    judged = event.isin("approve", "reject")
    problem = (
        F.when(judged & ~corp, "role")
        .when((event == "submit") & ~F.col("user_id").eqNullSafe(F.col("owner_user_id")), "owner")
        .when(((event == "submit") & ~was.eqNullSafe("uploaded")) | (judged & ~F.coalesce(was.isin("review", "uploaded"), F.lit(False))), "status")
        .when(~event.isin("submit", "approve", "reject", "ingested"), "event")
    )
    done = F.when(event == "reject", "draft").when((event == "approve") | corp | ((event == "ingested") & (was == "approved")), "approved").otherwise("review")
    j = j.withColumn("problem", problem).withColumn("status", F.when(F.col("problem").isNull(), done).otherwise(was))
    waiting = jobs.where("status = 'pending_approval'").groupBy("document_id").agg(F.max_by("job_id", F.struct("created_at", "job_id")).alias("_job"))
    moved = F.when(F.col("problem").isNull() & (event == "reject"), "cancelled").when(F.col("problem").isNull() & event.isin("approve", "submit") & (F.col("status") == "approved"), "queued")
    j = j.withColumn("_moved", moved).join(waiting, "document_id", "left")
    job = F.when(F.col("_job").isNotNull(), F.col("_moved"))
    return j.select("document_id", "event", "user_id", "status", "problem", F.when(job.isNotNull(), F.col("_job")).alias("job_id"), job.alias("job_status"), F.when(job == "cancelled", "Rejected by reviewer").alias("job_error"))


def vector_rows(chunks: DataFrame, docs: DataFrame, versions: DataFrame, document_oui: DataFrame) -> DataFrame:
    """Rows of the vector collection: each chunk with what its document and version say, lists joined by commas.

    chunks: chunk_id, version_id, chunk_text, embed_text, embedding, chunk_sensitivity, entity_types (array) and any others;
    versions: version_id, document_id and any others; docs: document_id, title, document_type, sensitivity; document_oui:
    document_id, oui_id.  The text is the one to embed, else the chunk's; the level is the chunk's, else the
    document's; the units are sorted, entity types stay in order.
    """
    units = document_oui.where("oui_id is not null").groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set("oui_id")), ",").alias("oui_ids"))
    d = docs.select("document_id", F.col("title").alias("document_title"), "document_type", F.col("sensitivity").alias("sensitivity")).join(units, "document_id", "left")
    j = chunks.join(versions, "version_id").join(d, "document_id")
    return (
        j.withColumn("document_text", F.coalesce(F.nullif("embed_text", F.lit("")), "chunk_text"))
        .withColumn("chunk_sensitivity", F.coalesce("chunk_sensitivity", "sensitivity"))
        .withColumn("entity_types", F.coalesce(F.array_join("entity_types", ","), F.lit("")))
        .withColumn("oui_ids", F.coalesce("oui_ids", F.lit("")))
        .drop("chunk_text", "embed_text")
    )
