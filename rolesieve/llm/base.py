"""Reading tables and cutting lineage, shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bound_batches(spark: SparkSession) -> None:
    """Have Arrow batches hold 16 MB rather than 10,000 rows of whatever length, where the session says nothing."""
    if spark.conf.get(_BATCH, None) in (None, str((1 << 31) - 1), f"{(1 << 31) - 1}b"):
        spark.conf.set(_BATCH, "16m")


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """One input table; only the named columns are scanned."""
    bound_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).

    Where the session names none, a local master (tests) gets a temporary folder; a
    cluster gets an error, since its executors would each write to a disk of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="rolesieve-"))
    return _own[0]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs only tasks of the stage at hand, since
    the table outlives every executor.  The shuffle files of the write go with its end,
    by Spark's own setting.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of ``materialise`` on which nothing rests any more."""
    for t in tables:
        path = getattr(t, "written_to", None)
        if path:
            jvm = t.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, with underscores put before those that ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name in taken:
            name = "_" + name
        out.append(name)
    return out


def numbered(df: DataFrame, row: str, name: str = "rows") -> DataFrame:
    """``df`` written with a key of its own for each row, so that repeated ids stay apart in every join."""
    from pyspark.sql import functions as F

    return materialise(df.withColumn(row, F.monotonically_increasing_id()), name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_groups(batches, key: str, rows: int = 20_000):
    """From pandas batches sorted by ``key``, frames of at least ``rows`` rows (but the last) that hold whole groups.

    Memory is bounded by ``rows`` and the largest group; callers cut groups to blocks first.
    """
    import pandas as pd

    held, n = [], 0
    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        n += len(pdf)
        if n < rows:
            continue
        pdf = pd.concat(held, ignore_index=True) if len(held) > 1 else pdf.reset_index(drop=True)
        k = pdf[key].to_numpy()
        cut = len(k) - 1
        while cut > 0 and k[cut - 1] == k[-1]:
            cut -= 1
        if cut:
            yield pdf.iloc[:cut].reset_index(drop=True)
        held, n = [pdf.iloc[cut:]], len(k) - cut
    if held:
        yield pd.concat(held, ignore_index=True)


def forest(linked):
    """Edges (i, j) of a spanning forest of a symmetric boolean matrix: each node to its group's first."""
    import numpy as np

    n, out = len(linked), []
    new = np.ones(n, bool)
    for i in range(n):
        if not new[i]:
            continue
        new[i] = False
        front = np.array([i])
        while len(front):
            front = np.flatnonzero(linked[front].any(0) & new)
            new[front] = False
            out += [(i, int(j)) for j in front]
    return out


def block_pairs(rows: DataFrame, key: list[str], sized: str, member: str, block: int) -> DataFrame:
    """Deal groups out as pairs of blocks, so that no task holds more than two blocks of a group.

    ``sized`` is the group's number of rows.  Adds ``task`` (one long a pair of blocks) and
    ``side`` (0 for all rows where the two blocks are the same, else 1 and 2).
    """
    from pyspark.sql import functions as F

    g = F.ceil(F.col(sized) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(member), g.cast("long")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), g - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    return rows.withColumn("task", F.xxhash64(*key, lo, hi)).withColumn("side", F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)).drop("own", "other")


def two_sides(side):
    """Places of the two blocks of a task of ``block_pairs``: twice the same for a block with itself."""
    import numpy as np

    if not side[0]:
        return np.arange(len(side)), np.arange(len(side))
    return np.flatnonzero(side == 1), np.flatnonzero(side == 2)


#: Bytes of text whose entries one bucket holds.
BUCKET = 32_000_000


def buckets_of(spark: SparkSession, times: int, batches: int, size: int, each: int = BUCKET) -> int:
    """Buckets for the entries of ``batches`` batches of about ``size`` bytes: ``times`` the partitions, or as many as keep each bounded."""
    return min(1 << 24, max(times * partitions(spark), -(-batches * size // each)))


def batched(rows: DataFrame, text: str, size: int, hashed) -> tuple[DataFrame, int, int]:
    """Adds ``batch``: rows dealt by a hash column to batches of about ``size`` bytes of ``text``; also the numbers of rows and batches."""
    from pyspark.sql import functions as F

    n, total = rows.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    batches = max(1, -(-(total or 0) // size), -(-n // 20_000))
    return rows.withColumn("batch", F.pmod(hashed, F.lit(batches)).cast("long")), n, batches
