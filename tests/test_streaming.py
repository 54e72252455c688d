"""Incremental intake: re-runs take only what is new, and overlaps count once."""

from datetime import date

from tallyspark.streaming import incremental

SCHEMA = "account string, sha256 string, day date, amount double"


def test_ingest_is_idempotent(spark, tmp_path):
    source, target, marks = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    first = spark.createDataFrame([("a", "1", date(2024, 1, 1), 1.0), ("a", "2", date(2024, 1, 2), 2.0)], SCHEMA)
    first.write.parquet(source)
    for _ in range(2):
        incremental.ingest(spark, source, first.schema, ["account", "sha256"], target, marks)
    assert spark.read.parquet(target).count() == 2
    spark.createDataFrame([("a", "2", date(2024, 1, 2), 2.0), ("b", "2", date(2024, 1, 3), 3.0), ("b", "2", date(2024, 1, 3), 3.0)], SCHEMA).write.mode("append").parquet(source)
    incremental.ingest(spark, source, first.schema, ["account", "sha256"], target, marks)
    assert sorted((r["account"], r["sha256"]) for r in spark.read.parquet(target).collect()) == [("a", "1"), ("a", "2"), ("b", "2")]


def test_high_water_marks(spark):
    rows = spark.createDataFrame([("a", date(2024, 1, 1)), ("a", date(2024, 3, 1)), ("b", None)], "account string, day date")
    found = {r["account"]: (r["last_fetch"], r["since"]) for r in incremental.high_water_marks(rows, "account", "day").collect()}
    assert found == {"a": (date(2024, 3, 1), date(2024, 2, 29)), "b": (None, None)}


def test_daily_totals(spark, tmp_path):
    spark.createDataFrame([("a", "1", date(2024, 1, 1), 1.0), ("a", "2", date(2024, 1, 1), 2.0), ("a", "3", date(2024, 1, 9), 4.0)], SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = incremental.daily_totals(stream, "day", ["account"], "amount").writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["day"], r["total"], r["n"]) for r in spark.table("totals").collect()) == [(date(2024, 1, 1), 3.0, 2), (date(2024, 1, 9), 4.0, 1)]
