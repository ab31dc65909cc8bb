"""Tables that several results read: computed once, in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table below ``spark.checkpoint.dir`` or, where that is unset, below the warehouse; it survives lost executors."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/ruleframe-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
