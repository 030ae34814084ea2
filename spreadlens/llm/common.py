"""Small helpers that several operators share."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..core.session import scratch_folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a table in the shared folder, which survives lost executors; ``discard`` deletes it."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete checkpointed tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column begins with it (Spark's names ignore case)."""
    while any(c.lower().startswith(name.lower()) for c in columns):
        name = f"_{name}"
    return name


def documents(spark: SparkSession, root: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def whole_text(c: str | Column = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def shares(spark: SparkSession, rows: int, per_share: int) -> int:
    """Partitions for ``rows`` rows, at most about ``per_share`` in each; never fewer than the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_share))
