"""Arriving drawings as a stream: each file is parsed once and its tables replaced by drawing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import dxf, json_drawings


def arriving(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(doc_id, value): a row for each file that appears."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(folder)
    return stream.select(F.element_at(F.split("path", "/"), -1).alias("doc_id"), F.decode("content", "UTF-8").alias("value"))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, kind: str = "dxf") -> StreamingQuery:
    """Writes an entities table a batch; runs until the files at hand are done."""

    def each(batch: DataFrame, number: int) -> None:
        rows = dxf.entities(dxf.records(dxf.pairs(batch))) if kind == "dxf" else json_drawings.entities(json_drawings.parse(batch))
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = arriving(spark, folder, "*.dxf" if kind == "dxf" else "*.json")
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
