"""Incremental forms of the keyed de-duplications and upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from rolesieve.operators.tables import upsert_by_key


def dedupe_stream(stream: DataFrame, key: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """First row of each key; keys older than the watermark are forgotten."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


class BucketedTable:
    """The newest row of each key under ``path``, in ``buckets`` by hash of the key.

    A merge reads and writes only the buckets that its rows fall in, as a new version of
    these, and then notes the version of each bucket in a table of commits; a reader takes each bucket at its
    last noted version.  What a lost job has written without a note does not count and is written over.  Merging the
    same rows again changes nothing, so a batch may run twice, and a stream with a new checkpoint goes on from what is
    there.  Older versions stay until ``compact``.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], seq: str, buckets: int = 64):
        self.spark, self.path, self.key, self.seq, self.buckets = spark, path.rstrip("/"), key, seq, buckets

    def _noted(self) -> dict[int, int]:
        """Bucket: its last version; at most one entry a bucket."""
        try:
            commits = self.spark.read.schema("bucket int, version long").parquet(f"{self.path}/commits")
        except AnalysisException:  # there is no commit yet
            return {}
        return {r["bucket"]: r["version"] for r in commits.groupBy("bucket").agg(F.max("version").alias("version")).collect()}

    def _files(self, noted: dict[int, int]) -> list[str]:
        return [f"{self.path}/v={v}/_bucket={b}" for b, v in sorted(noted.items())]

    def read(self) -> DataFrame | None:
        """All rows; None while nothing has been merged."""
        noted = self._noted()
        return self.spark.read.parquet(*self._files(noted)) if noted else None

    def merge(self, rows: DataFrame) -> None:
        """Take in ``rows``; of a key the one of greatest ``seq`` stays, of equal ones the new."""
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        rows = rows.persist()
        try:
            touched = [r[0] for r in rows.select(bucket.alias("b")).distinct().collect()]
            if not touched:
                return
            noted = self._noted()
            old = self._files({b: v for b, v in noted.items() if b in touched})
            both = upsert_by_key(self.spark.read.schema(rows.schema).parquet(*old) if old else rows.limit(0), rows, self.key, self.seq)
            version = max(noted.values(), default=-1) + 1
            both.withColumn("_bucket", bucket).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/v={version}")
            note = self.spark.createDataFrame([(b, version) for b in touched], "bucket int, version long")
            note.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        finally:
            rows.unpersist()

    def compact(self, to: str) -> BucketedTable:
        """The table as one version under a new path; the old path may then be deleted."""
        out = BucketedTable(self.spark, to, self.key, self.seq, self.buckets)
        rows = self.read()
        if rows is not None:
            out.merge(rows)
        return out


def upsert_stream(stream: DataFrame, path: str, key: list[str], seq: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keep a ``BucketedTable`` of the newest row of each key; a batch costs the buckets that it touches."""

    def merge(batch: DataFrame, number: int) -> None:
        BucketedTable(batch.sparkSession, path, key, seq, buckets).merge(batch)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Synced(StatefulProcessor):
    """What each user has synced, an entry a message; a row without message says that the user's collection was found empty."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "message_id long", "synced boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        ids: list[int] = []
        for pdf in rows:
            if pdf["message_id"].isna().any() and self.seen.exists():
                self.seen.clear()
            ids += pdf["message_id"].dropna().astype("int64").tolist()
        new = []
        for i in dict.fromkeys(ids):
            if not self.seen.containsKey((i,)):
                self.seen.updateValue((i,), (True,))
                new.append(i)
        if new:
            yield pd.DataFrame({"user_id": [key[0]] * len(new), "message_id": new})

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def new_email_stream(messages: DataFrame) -> DataFrame:
    """(user_id, message_id) of a stream's messages that their user has not synced yet, each once.

    ``messages`` is a stream with user_id and message_id.  A row with a null message_id is the word that
    the user's collection is empty: their history then counts for nothing, for the messages of the
    same batch too, and they sync from the start.  History is kept in state, an entry a message, so
    neither a rerun nor a restart from the checkpoint gives a message twice, and a user of very many messages costs a
    batch what comes in.  The session's state store must be RocksDB (``ROCKS``).
    """
    rows = messages.where("user_id is not null").select(F.col("user_id").cast("long").alias("user_id"), F.col("message_id").cast("long").alias("message_id"))
    return rows.groupBy("user_id").transformWithStateInPandas(Synced(), "user_id long, message_id long", "Append", "None")
