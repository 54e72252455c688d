"""Uploads: outcomes, names that are free, archives, and keys of manual names."""

import io
import zipfile

from pyspark.sql import functions as F

from tallyspark.functions import periods
from tallyspark.sources import uploads
from tallyspark.sources.published import Published


def test_keys_of_manual_names(spark):
    names = {
        "manual__2024-05.pdf": "2024-05", "manual__2024-05.CSV": "2024-05", "manual__FY24-2025.csv": "FY24-2025", "manual__2024.pdf": "2024", "manual__2024-05-06.pdf": "2024-05",
        "manual__2024-05.txt": None, "manual__FY24-2025-01.csv": None, "x-manual__2024-05.pdf": None, "manual__notes.csv": None, "manual__20245.pdf": None,
    }
    found = spark.createDataFrame([(n,) for n in names], "name string").select("name", periods.upload_period("name")).collect()
    assert {n: k for n, k in found} == names


def test_plan(spark, tmp_path):
    schema = "account string, account_type string, kind string, key string, at int, content string"
    rows = [
        ("1", "card", "pdf", "2024-05", 1, "a"), ("1", "card", "pdf", "2024-05", 2, "b"), ("1", "card", "csv", "2024-05", 1, "c"), ("1", "card", "csv", "2024-05", 2, "d"),
        ("1", "card", "csv", "FY24-2025", 3, "e"), ("2", "card", "pdf", "2024-06", 1, "f"), ("2", "card", "pdf", "2024-13", 1, "g"), ("2", "card", "doc", "2024-07", 1, "h"),
        ("2", "card", "csv", None, 1, "i"), (None, "card", "csv", "2024-07", 1, "j"), ("2", "card", None, "2024-07", 1, "k"),
    ]
    canonical = spark.createDataFrame([("2", "pdf", "2024-06"), ("2", "pdf", "2024-06"), ("2", "csv", "2024-05")], "account string, kind string, key string")
    planned = uploads.plan(spark.createDataFrame(rows, schema), canonical, "/data/", "/in/")
    assert planned.columns == [*(c.split()[0] for c in schema.split(", ")), "outcome", "target"]
    found = {r["content"]: (r["outcome"], r["target"]) for r in planned.collect()}
    assert found == {
        "a": ("replaced", None), "b": ("staged", "/in/card/1/manual__2024-05.pdf"), "c": ("saved", "/data/FY24-2025/card/1/2024-05.csv"), "d": ("exists", None),
        "e": ("saved", "/data/FY24-2025/card/1/2025.csv"), "f": ("exists", None), **{x: ("invalid", None) for x in "ghijk"},
    }
    staging, saved = (Published(spark, f"file://{tmp_path}/{n}", ["target"]) for n in ("staging", "saved"))
    assert uploads.save(planned, staging, saved) == (1, 1)
    again = uploads.plan(spark.createDataFrame(rows, schema), saved.read(), "/data", "/in")
    assert {r["content"]: r["outcome"] for r in again.collect() if r["kind"] == "csv" and r["account"] == "1"} == {"c": "exists", "d": "exists", "e": "exists"}
    assert uploads.save(again.where("kind = 'csv'"), staging, saved) == (1, 1)
    assert sorted(r["content"] for r in saved.read().collect()) == ["c", "e"]
    assert uploads.plan(spark.createDataFrame([], schema), canonical, "/data", "/in").count() == 0


def test_names_that_are_free(spark):
    members = [("a", f"p{i}", n, k) for i, (n, k) in enumerate([("x/notes.csv", None), ("notes (4).csv", "unknown-month"), ("q.csv", "2024-05"), ("r.csv", "2024-05"), ("..", None), ("b\\notes.csv", ""), ("s.csv", "2024-05")])]
    members.append(("b", "p0", "notes.csv", None))
    taken = [("a", "manual__2024-05.csv"), ("a", "manual__2024-05 (2).csv"), ("a", "manual__notes (1).csv"), ("a", "other.csv")]
    rows = uploads.staged_names(spark.createDataFrame(members, "account string, path string, name string, key string"), spark.createDataFrame(taken, "account string, name string")).collect()
    assert {(r["account"], r["path"]): r["target"] for r in rows} == {
        ("a", "p0"): "manual__notes.csv", ("a", "p1"): "manual__notes (2).csv", ("a", "p5"): "manual__notes (3).csv", ("a", "p2"): "manual__2024-05 (1).csv", ("a", "p3"): "manual__2024-05 (3).csv",
        ("a", "p6"): "manual__2024-05 (4).csv", ("a", "p4"): "manual__attachment.csv", ("b", "p0"): "manual__notes.csv",
    }
    assert {r["path"]: r["key"] for r in rows if r["account"] == "a"}["p1"] is None


def test_archives(spark):
    def packed(**members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in members.items():
                z.writestr(f"{name}.csv", text)
        return bytearray(out.getvalue())

    export = "Card\nTransaction Details:\nDate,Sr.No.,Details,Points,Intl,Amount\n{}\n"
    month = export.format("05/06/2024,1000001,x,0,0,5.00")
    zips = [("1", "one.zip", packed(first=month, second=month, other=b"nothing \xff here")), ("1", "two.zip", bytearray(b"no archive"))]
    none = spark.createDataFrame([], "account string, name string")
    good, bad = uploads.from_archives(spark.createDataFrame(zips, "account string, path string, content binary"), none)
    found = {r["path"]: (r["key"], r["target"], r["text"]) for r in good.collect()}
    assert {k: v[:2] for k, v in found.items()} == {"one.zip!/first.csv": ("2024-06", "manual__2024-06.csv"), "one.zip!/second.csv": ("2024-06", "manual__2024-06 (1).csv"), "one.zip!/other.csv": (None, "manual__other.csv")}
    assert found["one.zip!/first.csv"][2] == month
    assert found["one.zip!/other.csv"][2] == "nothing \ufffd here"
    assert [tuple(r) for r in bad.collect()] == [("1", "two.zip", "not a zip archive")]
    assert good.select(F.max(periods.upload_period("target"))).first()[0] == "2024-06"


def test_sections_by_year(spark):
    span = spark.createDataFrame([("2024-02-15", "2024-05-02"), ("2024-05-02", "2024-02-15"), (None, "2024-01-01")], "a string, b string").select(F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    fiscal, year = span.select(periods.year_sections(F.col("a"), F.col("b")).alias("f"), periods.year_sections(F.col("a"), F.col("b"), fiscal=False).alias("c")).first()
    assert [tuple(x) for x in fiscal] == [("FY24-2025", ["2024-05", "2024-04"]), ("FY23-2024", ["2024-03", "2024-02"])]
    assert [tuple(x) for x in year] == [("2024", ["2024-05", "2024-04", "2024-03", "2024-02"])]
    assert [tuple(r[0] or []) for r in span.select(periods.year_sections(F.col("a"), F.col("b"))).collect()[1:]] == [(), ()]
