"""Tables written into the shared folder of a session, which end a plan's lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in a local session without one, a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="checkpoints-")
        named = _own[app]
    return named.rstrip("/")


def keep_table(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder of the session (spark.checkpoint.dir) and read it back, which ends its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
