"""From raw documents to packed sequences: toxicity, quality, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and its
result is written as Parquet and read again for the next.  The first four return the
columns of ``documents``; the last one row for each piece of a packed sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesieve.llm import quality_pu, toxic_crf
from rolesieve.llm.base import free_name, materialise, numbered, read
from rolesieve.llm.jaccard_forest import near_copies
from rolesieve.llm.packing import pack_documents
from rolesieve.llm.queries import tokenizer_path
from rolesieve.llm.suffix_dedup import remove_repeats


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field rejects go; rows and columns of the others pass unchanged, null and empty texts too."""
    return toxic_crf.drop_toxic(docs, toxic_crf.train(docs, read(spark, sf_dir, "labels")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go (null and empty texts are scored as such); the others pass unchanged."""
    return quality_pu.drop_poor(docs, quality_pu.train(docs, read(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, the first by doc_id.

    Rows count, not doc_ids: of two texts under one doc_id only those go that copy a row
    which stays.  Rows without words or doc_id stay; an empty table gives an empty one;
    further columns pass unchanged.
    """
    (row,) = free_name(docs, "row")
    rows = numbered(docs, row, "documents")
    gone = near_copies(rows, row=row, links=False).where(~F.col("kept")).select(row)
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that a document of smaller doc_id holds go from the texts; a character cut in two goes whole.

    ``text`` and ``n_chars`` change, every other column passes; null texts become empty; rows
    with one doc_id stay rows each; an empty table gives an empty one.
    """
    (row,) = free_name(docs, "row")
    rows = numbered(docs, row, "documents")
    kept = remove_repeats(rows, row=row).select(row, "kept_text")
    (text,) = free_name(docs, "kept_text")
    out = rows.drop("text", "n_chars").join(kept.withColumnRenamed("kept_text", text), row)
    return out.withColumns({"text": F.col(text), "n_chars": F.length(text).cast("long")}).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a sequence; null and empty texts are their end id alone, further columns are left out."""
    return pack_documents(docs.select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("quality", quality), ("near copies", one_of_each_group), ("repeated passages", repeated_passages), ("packing", packing)]

#: Learned scores and packing have no SQL form; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
