"""Housekeeping actions, layout repairs and SQL functions."""

from datetime import date, datetime

from pyspark.sql import functions as F

from tallyspark.functions import sql, text
from tallyspark.operators import cleanup


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_markers(spark):
    rows = [("a", "1", "has MARK", False), ("a", "2", "none", False), ("a", "3", "MARK but  bad", False), ("a", "4", "bad MARK", True), ("a", "5", None, None)]
    files = spark.createDataFrame(rows, "account string, path string, text string, manual boolean")
    kept, alerts = cleanup.check_markers(files, ["MARK"], ["but bad", "bad MARK"])
    assert sorted(r["path"] for r in kept.collect()) == ["1", "4"] and sorted(r["path"] for r in alerts.collect()) == ["2", "3", "5"]
    assert sorted(r["path"] for r in cleanup.no_longer_eligible(files, ["MARK"], []).collect()) == ["2", "5"]
    assert [r["path"] for r in cleanup.outputs_of("a", files, files.where("path > '3'")).collect()] == ["1", "2", "3", "4", "5"]


def test_stale_and_actions(spark):
    pdfs = spark.createDataFrame([("a", "1", datetime(2024, 1, 2)), ("a", "2", datetime(2024, 1, 2)), ("a", "3", datetime(2024, 1, 2))], "account string, stem string, modified timestamp")
    texts = spark.createDataFrame([("a", "1", datetime(2024, 1, 1)), ("a", "2", datetime(2024, 1, 2))], "account string, stem string, modified timestamp")
    assert sorted(r["stem"] for r in cleanup.stale_texts(pdfs, texts, ["account", "stem"]).collect()) == ["1", "3"]
    files = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "account string, path string")
    decided = spark.createDataFrame([("a", "prepared", "y"), ("b", "ambiguous", None)], "account string, outcome string, keeper_path string")
    assert sorted((r["path"], r["action"]) for r in cleanup.collapsed(files, decided, ["account"]).collect()) == [("x", "delete"), ("y", "promote")]
    assert [r["path"] for r in cleanup.first_new(files, files.where("account = 'a'"), ["account"]).collect()] == ["z"]


def test_layout_repairs(spark):
    assert value(spark, text.join_detached_marks(F.lit("TEA 5.00\nCR\nBUN 6.00\n Dr \nX"))) == "TEA 5.00 CR\nBUN 6.00 Dr\nX"
    assert value(spark, text.drop_block(F.lit("a\nOFFERS\nb\nc\nTOTAL 1\nd"), "OFFERS", "^TOTAL")) == "a\nTOTAL 1\nd"
    assert value(spark, text.drop_block(F.lit("a\nOFFERS\nb"), "OFFERS", "^TOTAL")) == "a"
    assert value(spark, text.drop_block(F.lit("a\nb"), "OFFERS", "^TOTAL")) == "a\nb"
    greens = {(0.0, 0.6, 0.1): True, (0.8, 0.0, 0.9, 0.2): True, (0.3,): False, (0.9, 0.1, 0.1): False, (): False}
    for parts, expected in greens.items():
        assert value(spark, text.is_green(F.array(*(F.lit(p) for p in parts)).cast("array<double>"))) is expected


def test_sql_functions(spark):
    sql.register(spark)
    r = spark.sql(r"select fiscal_key(date '2024-03-31') k, balances_match(1.00, 1.21) m, approximate_start(date '2024-03-31') s, squeeze(' a \n b ') q").first()
    assert (r["k"], r["m"], r["s"], r["q"]) == ("FY23-2024", True, date(2024, 3, 1), "a b")
