"""Metadata documents: types, defaults, problems, and the way back to what is computed."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyspark.sources import metadata_files

STATEMENT = {"statement_date": "2024-05-31", "formats": ["pdf", "txt"], "opening_balance": 12, "closing_balance": None, "granularity": "monthly", "covered_months": ["2024-05"]}
GOOD = {
    "account_number": "1", "bank": "yes", "account_type": "credit_card", "statements": [STATEMENT, "noise"], "statement_dates": ["2024-05-31"],
    "period_covered": {"start": "2024-05-01", "segments": [{"start": "2024-05-01", "end": "2024-05-31", "approximate": True}, 3], "gaps": [{"start": "a", "end": "b", "balances_match": "no"}]},
}


def changed(path, value):
    doc = json.loads(json.dumps(GOOD))
    *way, last = path
    at = doc
    for p in way:
        at = at[p]
    if value is ...:
        del at[last]
    else:
        at[last] = value
    return json.dumps(doc)


BROKEN = {
    "{": "not JSON",
    "[1]": "metadata must be an object",
    changed(["statements"], None): "statements must be a list",
    changed(["statements"], {}): "statements must be a list",
    changed(["statements", 0, "statement_date"], ...): "a statement has no date",
    changed(["statements", 0, "formats"], "pdf"): "formats must be a list",
    changed(["statements", 0, "period_approximate"], 1): "period_approximate must be true or false",
    changed(["statements", 0, "granularity"], "weekly"): "granularity must be monthly or annual",
    changed(["statements", 0, "granularity"], ...): "granularity must be monthly or annual",
    changed(["statements", 0, "covered_months"], None): "covered_months must be a list",
    changed(["period_covered"], ...): "period_covered must be an object",
    changed(["period_covered", "segments", 0, "approximate"], "yes"): "approximate must be true or false",
    changed(["period_covered", "approximate_statement_count"], "2"): "approximate_statement_count must be a number",
    changed(["statement_count"], 1.5): "statement_count must be a number",
    changed(["bank"], ...): "account_number, bank and account_type must be there",
}


def test_problems(spark):
    docs = spark.createDataFrame([(d, d) for d in BROKEN], "account string, document string")
    found = {r["account"]: (r["problem"], r["metadata"]) for r in metadata_files.checked(docs).collect()}
    assert found == {d: (p, None) for d, p in BROKEN.items()}
    with pytest.raises(PySparkException, match="granularity must be"):
        metadata_files.checked(docs.where(F.col("document").contains("weekly")), strict=True).collect()


def test_a_sound_document(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "metadata.json").write_text(json.dumps(GOOD, indent=2))
    (tmp_path / "x" / "other.json").write_text("{")
    row = metadata_files.checked(metadata_files.documents(spark, str(tmp_path)), strict=True).collect()
    assert len(row) == 1 and row[0]["problem"] is None and row[0]["path"].endswith("x/metadata.json")
    m = row[0]["metadata"].asDict(recursive=True)
    assert m["statements"] == [{**STATEMENT, "opening_balance": "12", "period_start": None, "period_end": None, "period_approximate": False, "year_key": None}]
    assert m["period_covered"] == {
        "start": "2024-05-01", "end": None, "segments": [{"start": "2024-05-01", "end": "2024-05-31", "approximate": True}], "gaps": [{"start": "a", "end": "b", "balances_match": None}],
        "months": [], "approximate_statement_count": 0,
    }
    assert (m["account_number"], m["variant"], m["formats"], m["statement_count"], m["last_fetch_date"]) == ("1", None, [], 1, None)
    assert metadata_files.checked(spark.createDataFrame([(changed(["statement_count"], 7),)], "document string")).first()["metadata"]["statement_count"] == 7


def test_loading(spark):
    docs = [("1", json.dumps(GOOD)), ("2", '{"last_fetch_date": "2024-05-01"}'), ("3", "{"), ("9", json.dumps(GOOD))]
    checked = metadata_files.checked(spark.createDataFrame(docs, "account string, document string"))
    computed = checked.where("account = '1'").select("metadata").crossJoin(spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "account string"))
    computed = computed.withColumn("metadata", F.col("metadata").withField("bank", F.lit("made")))
    rows = metadata_files.load(spark.createDataFrame([(str(i), i) for i in range(1, 6)], "account string, n int"), checked, computed).collect()
    assert {r["account"]: (r["metadata"] and r["metadata"]["bank"], r["stored"], r["problem"]) for r in rows} == {
        "1": ("yes", True, None), "2": ("made", False, None), "3": (None, False, "not JSON"), "4": ("made", False, None), "5": (None, False, None),
    }
