"""Tables that are empty, and tables with nulls in any column, from the smallest test data."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

SOURCE = Path("/root/testdata/sf0.001")


def make(spark, folder, kind):
    if not SOURCE.exists():
        pytest.skip("no test data")
    for p in SOURCE.glob("*.parquet"):
        t = spark.read.parquet(str(p))
        if kind == "empty":
            t = t.limit(0)
        else:
            bare = t.limit(6).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in t.schema.fields])
            half = t.limit(12).select(*[F.when(F.xxhash64(F.lit(i), F.rand(7)) % 2 == 0, F.col(f.name)).alias(f.name) for i, f in enumerate(t.schema.fields)])
            t = t.limit(30).unionByName(bare).unionByName(half).withColumn("value", F.lit("clash"))
        t.write.parquet(str(folder / p.name))
    return str(folder)
