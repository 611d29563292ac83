"""Streams that run again, go on from old tables, and start over."""

import pytest
from pyspark.sql import functions as F

from rolesieve.operators import tables as D
from rolesieve.plans.views import Tables
from rolesieve.streaming.incremental import ROCKS, BucketedTable, new_email_stream, upsert_stream

ROW = "k long, seq long, v string"


def rows(df):
    return sorted(map(tuple, df.collect()))


def add(spark, data, path):
    spark.createDataFrame(data, ROW).coalesce(1).write.mode("append").parquet(str(path))


def run(spark, tmp_path, checkpoint):
    stream = spark.readStream.schema(ROW).parquet(str(tmp_path / "in"))
    upsert_stream(stream, str(tmp_path / "t"), ["k"], "seq", str(tmp_path / checkpoint), buckets=4).awaitTermination(120)
    return BucketedTable(spark, str(tmp_path / "t"), ["k"], "seq", 4)


def test_upserts_touch_their_buckets_and_survive_reruns(spark, tmp_path):
    add(spark, [(i, 1, "a") for i in range(40)], tmp_path / "in")
    t = run(spark, tmp_path, "one")
    assert rows(t.read()) == [(i, 1, "a") for i in range(40)] and set(t._noted().values()) == {0}
    add(spark, [(3, 2, "b"), (3, 1, "late")], tmp_path / "in")
    t = run(spark, tmp_path, "one")
    want = [(i, 2, "b") if i == 3 else (i, 1, "a") for i in range(40)]
    assert rows(t.read()) == want and sorted(t._noted().values()) == [0, 0, 0, 1]  # one bucket was written
    t = run(spark, tmp_path, "two")  # a new checkpoint: everything comes again, nothing changes or is lost
    assert rows(t.read()) == want
    spark.createDataFrame([(99, 1, "lost")], ROW).withColumn("_bucket", F.lit(0)).write.partitionBy("_bucket").parquet(str(tmp_path / f"t/v={max(t._noted().values()) + 1}"))
    assert rows(t.read()) == want  # a version without a note does not count
    add(spark, [(50, 1, "n")], tmp_path / "in")
    t = run(spark, tmp_path, "two")
    assert rows(t.read()) == [*want, (50, 1, "n")] and rows(t.compact(str(tmp_path / "c")).read()) == [*want, (50, 1, "n")]
    t.merge(spark.createDataFrame([], ROW))
    assert rows(t.read()) == [*want, (50, 1, "n")]
    assert BucketedTable(spark, str(tmp_path / "none"), ["k"], "seq").read() is None


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    yield
    spark.conf.set(name, before)


def test_new_emails_by_state(spark, rocks, tmp_path):
    got = tmp_path / "got"

    def send(*pairs):
        spark.createDataFrame(pairs, "user_id long, message_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        seen = rows(spark.read.parquet(str(got))) if got.exists() else []
        stream = spark.readStream.schema("user_id long, message_id long").parquet(str(tmp_path / "in"))
        q = new_email_stream(stream).writeStream.format("parquet").option("path", str(got)).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(180)
        after = rows(spark.read.parquet(str(got)))
        for r in seen:
            after.remove(r)
        return after

    assert send((1, 10), (1, 11), (2, 10), (1, 10)) == [(1, 10), (1, 11), (2, 10)]
    assert send((1, 10), (1, 12), (2, 10), (3, 1), (None, 5)) == [(1, 12), (3, 1)]  # restarted from its checkpoint
    assert send((1, None), (1, 10), (1, 12), (2, 10)) == [(1, 10), (1, 12)]  # user 1's collection was empty
    assert send((1, 10), (1, 11), (2, None)) == [(1, 11)]
    assert send((2, 10)) == [(2, 10)]


def test_state_and_batch_agree(spark, rocks, tmp_path):
    """The tables' mails as a stream after what was synced: what comes out of the rest is what ``new_emails`` gives."""
    mails = Tables(spark, "/root/testdata/sf0.001").emails.select("user_id", "message_id", "synced")
    out = []
    for synced in (True, False):
        mails.where(F.lit(True) if not synced else F.col("synced")).select("user_id", "message_id").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("user_id long, message_id long").parquet(str(tmp_path / "in"))
        new_email_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "got")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(180)
        out.append(rows(spark.read.parquet(str(tmp_path / "got"))))
    for r in out[0]:
        out[1].remove(r)
    m = mails.select("user_id", "message_id")
    assert out[1] == rows(D.new_emails(m, mails.where("synced"), m).distinct()) and len(out[1]) > 0
