from pyspark.sql import functions as F

from peltrane.llm import common


def written(df):
    """Folders that a plan reads."""
    return {f.rpartition("/")[0] for f in df.inputFiles()}


def test_rows_of_files_are_numbered_in_place(small, spark):
    numbered = common.with_row_id(small.select("doc_id", F.upper("text").alias("t")).where("doc_id >= 0"))
    assert written(numbered) == written(small)
    one = {r.doc_id: r._rid for r in numbered.select("doc_id", "_rid").collect()}
    two = {r.doc_id: r._rid for r in numbered.select("_rid", "t", "doc_id").collect()}
    assert one == two and len(set(one.values())) == 200
    assert spark.conf.get("spark.sql.files.minPartitionNum")


def test_other_rows_are_written_first(small):
    dealt = common.with_row_id(small.repartition(3).select("doc_id"))
    assert written(dealt) and written(dealt) != written(small)
    assert dealt.select("_rid").distinct().count() == 200


def test_materialized_rows_go_when_told(small):
    kept = common.materialize(small.select("doc_id"), "kept")
    assert kept.count() == 200
    common.drop_now(kept)
    assert not any(__import__("os").path.exists(f.removeprefix("file://")) for f in kept.inputFiles())


def test_let_and_lower(spark):
    r = spark.createDataFrame([("AbÉ",)], "s string").select(common.ascii_lower(F.col("s")).alias("l"), common.let(F.length("s"), lambda n: n + n).alias("n")).first()
    assert (r.l, r.n) == ("abÉ", 6)
