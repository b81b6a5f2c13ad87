from pyspark.sql import functions as F

from plumbline.streaming import current, fold_into_table, latest_rows


def test_fold_keeps_the_last_rows(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "id string, row_ord long, word string"
    for rows in ([("t1", 1, "verified"), ("t2", 2, "failed")], [("t1", 3, "failed")], [("t2", 1, "late"), ("t3", 4, "verified")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(schema).json(source)
        fold_into_table(stream, "id", ["row_ord"], table, str(tmp_path / "cp")).awaitTermination(120)
    assert sorted((r.id, r.row_ord, r.word) for r in current(spark, table).collect()) == [("t1", 3, "failed"), ("t2", 2, "failed"), ("t3", 4, "verified")]
    assert current(spark, str(tmp_path / "none")) is None


def test_latest_rows_in_memory(spark, tmp_path):
    schema = "id string, row_ord long, word string"
    spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], schema).write.json(str(tmp_path / "in"))
    stream = latest_rows(spark.readStream.schema(schema).json(str(tmp_path / "in")), "id", "row_ord")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("latest").select("id", F.col("word")).collect()) == [("a", "y"), ("b", "z")]
