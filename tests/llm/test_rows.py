"""Numbers of rows: each its own, the same in every reading, whatever the frame is."""
from pyspark.sql import functions as F

from lattica.llm.common import _one_table, settle, with_row


def test_numbers(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5000).select((F.col("id") % 7).alias("row_file"), F.col("id").alias("x"), F.lit("m").alias("_metadata")).repartition(5).write.parquet(path)
    docs = spark.read.parquet(path)
    twice = spark.read.parquet(path, path)
    assert _one_table(docs) and not any(map(_one_table, (docs.filter("x > 3"), docs.union(docs), twice, spark.range(3))))
    for df, n in ((docs, 5000), (docs.union(docs), 10000), (docs.filter("x < 0"), 0)):
        got = with_row(df, [F.col("x").alias("own_x"), F.col("row_file").alias("own_file")], "t")
        assert got.columns == ["own_x", "own_file", "row"] and got.count() == n == got.select("row").distinct().count()
        assert got.exceptAll(got).isEmpty()
    a, b = (with_row(docs, [F.col("x")], "t").select("x", "row") for _ in range(2))
    assert a.exceptAll(b).isEmpty()


def test_settle(spark):
    settle(spark)
