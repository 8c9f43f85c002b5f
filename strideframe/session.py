"""A session with the settings the operators are written for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "strideframe", **conf: str) -> SparkSession:
    """Give master, memory and shuffle partitions through ``conf`` or the submit command."""
    return SparkSession.builder.appName(app).config(map=CONF | conf).getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without it gets a temporary folder, a cluster is refused."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="strideframe-")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to ``work_dir`` and read back: computed once, and the same to all that read it, also when executors are lost."""
    path = f"{work_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """A broadcast of a table that is stored already, if its counted rows are within the bound; beyond it the join shuffles."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
