"""What the operators share: the shared folder, written intermediate tables, small column helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that splits words in every operator: space and \t \n \v \f \r.
SPACE = " \t\n\x0b\x0c\r"

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (unset, in local mode) one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/llm/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _remove_all() -> None:
    while _made:
        spark, path = _made.pop()
        try:
            remove(spark, path)
        except Exception:  # the session may already be gone; the folder then stays, as any checkpoint does
            return


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read back: lineage ends here and a lost executor loses nothing."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables made by ``written`` that nothing reads any more."""
    for t in tables:
        _made.remove((t.sparkSession, t.written_to))
        remove(t.sparkSession, t.written_to)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
