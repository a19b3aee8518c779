"""Incremental extraction: new files in a folder get their feature rows as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import tokens
from ..operators import pe_features
from ..sources import pe, samples


def stream_files(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """(sha256, family, length, content) of files in folder/family/sha256, as a stream."""
    files = spark.readStream.format("binaryFile").schema(samples.FILE_SCHEMA).option("maxFilesPerTrigger", per_trigger).load(f"{folder}/*/*")
    return samples.located(files)


def file_features(files: DataFrame) -> DataFrame:
    """Row-local features: size, entropy, headers, sections. The same for a table and a stream."""
    parsed = pe_features.enriched(pe_features.section_features(files.withColumn("pe", pe.parse_pe(F.col("content")))))
    parts = [F.col(f"`{c}`") for c in parsed.columns if c.startswith("pesection") or c == "section_error"]
    return parsed.select("sha256", "family", F.col("length").alias("generic_fileSize"), tokens.byte_entropy(F.col("content")).alias("generic_fileEntropy"), *pe_features.header_features(F.col("pe")), *parts)


def start(files: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends the features of a stream of files to a Parquet table; each file once."""
    return file_features(files).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
