"""Queries outside the corpus operators bound their Arrow batches by bytes."""

from rolesieve.operators import tables as D
from rolesieve.plans.views import Tables

DATA = "/root/testdata/sf0.001"


def test_batches_are_bounded_by_bytes(spark):
    before = spark.conf.get(D._BATCH)
    try:
        spark.conf.unset(D._BATCH)
        Tables(spark, DATA)
        assert spark.conf.get(D._BATCH) == "4m"
        spark.conf.set(D._BATCH, "1m")
        Tables(spark, DATA)
        assert spark.conf.get(D._BATCH) == "1m"
    finally:
        spark.conf.set(D._BATCH, before)
