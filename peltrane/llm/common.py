"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.samples import spread  # noqa: F401  used by the operators
from ..sources.shared import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space of the contracts, as a Java and RE2 class body.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable instead of a repeated expression."""
    return F.transform(F.array(value), body)[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage, is computed once and outlives any executor.

    The files go when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_now(df: DataFrame) -> None:
    """Deletes what materialize() wrote for df, once nothing reads it any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, path)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles that no plan refers to any more. It does so beside what runs, so it gets a moment."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    try:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the gateway may be gone when Python ends
        return


def _straight(plan) -> bool:
    """Whether a plan only selects and filters the rows of files."""
    kids = plan.children()
    return plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "LogicalRelation") and all(_straight(kids.apply(k)) for k in range(kids.size()))


def with_row_id(df: DataFrame, name: str = "_rid") -> DataFrame:
    """A number for each row, repeated rows included. The same in every job, executors lost in between or not.

    Rows of files are numbered by the splits that they are read in. Those depend on the session's number of cores unless
    the least number of splits is set, so it is set here, once a session. Other rows (of shuffles, say) have no lasting
    order; they are written to the shared folder first.
    """
    spark, least = df.sparkSession, "spark.sql.files.minPartitionNum"
    if not (_straight(df._jdf.queryExecution().analyzed()) and len(df._jdf.inputFiles())):
        df = materialize(df, "rows")
    if spark.conf.get(least, None) is None:
        spark.conf.set(least, str(spark.sparkContext.defaultParallelism))
    return df.withColumn(name, F.monotonically_increasing_id())


def boxed(docs: DataFrame, *fields: str) -> tuple[DataFrame, list[Column], list[Column]]:
    """docs as (_rid, _doc), so that no name of theirs can clash; the columns of the fields, and those that give docs back."""
    names = docs.columns
    box = with_row_id(docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("_doc")))
    return box, [F.col(f"_doc.c{names.index(f)}") for f in fields], [F.col(f"_doc.c{i}").alias(c) for i, c in enumerate(names)]
