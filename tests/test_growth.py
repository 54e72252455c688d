"""What keeps work in proportion to the input: no statement is dealt out by its bank, and a run makes what it is asked for."""

from pyspark.sql import functions as F

from tallyspark.functions import periods, tables, text
from tallyspark.operators import handlers, registry, run, selection
from tallyspark.sources import metadata_files


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_statements_are_not_dealt_out_by_their_bank(spark):
    statements = spark.range(100).select("id", F.lit("yes").alias("bank"), F.when(F.col("id") % 2 == 0, "ace").alias("variant"))
    found = selection.with_fallback(statements, registry.readers(spark))
    assert "SortMergeJoin" not in _plan(found) and "hashpartitioning(bank" not in _plan(found)
    assert {r["rule"] for r in found.collect()} == {"marked"}


def test_lines_of_a_table_function_come_without_a_table_for_each_statement(spark):
    tables.register(spark)
    texts = spark.createDataFrame([("05/01/2024 TEA 4.00 Dr\nx\n06/01/2024 BACK 5.00 Cr",), ("",), (None,)], "text string")
    found = spark.sql("SELECT t.* FROM {texts} s, LATERAL statement_lines(s.text, 'yes', 'ace') t", texts=texts)
    assert "ArrowEvalPythonUDTF" not in _plan(found)
    assert [tuple(r) for r in found.collect()] == [(0, "05/01/2024", "TEA", "4.00", "DR", None), (2, "06/01/2024", "BACK", "5.00", "CR", None)]


def _files(spark, rows):
    table = spark.createDataFrame(rows, "account string, path string, text string, text_not_contains array<string>")
    return table.withColumns({"bank": F.lit("yes"), "variant": F.lit(None).cast("string"), "name": F.col("path"), "sha256": F.sha2("text", 256), "mail_date": F.lit(None).cast("date"), "text_contains": F.array().cast("array<string>")})


def test_a_run_makes_what_it_is_asked_for_and_judges_cleaned_texts_by_their_heads(spark, tmp_path):
    body = "Statement Period : 01/01/2024 To 31/01/2024\nPrevious Balance :\nRs. 1.00\nTotal Amount Due:\nRs. 2.00\nNOT~MINE"
    rows = [("a", "a.pdf", body, ["NOT  MINE"]), ("b", "b.pdf", body, ["OTHER"]), ("c", "c.pdf", body, [" "]), ("d", "d.pdf", body, None), ("e", "e.pdf", body, ["NOT~MINE"])]
    root = f"file://{tmp_path}/run"
    found = run.run(_files(spark, rows), ("yes",), root=root, parts=("metadata",))
    assert found.made == ["heads", "keyed", "decided", "kept", "metadata"] and found.gaps is None
    # cleaning makes a blank of the tilde, so the text that a marker bars is the cleaned one for a, the one as it stands for e
    assert sorted(r["account"] for r in found.metadata.collect()) == ["b", "c", "d"]
    assert run.run(_files(spark, rows), ("yes",), root=root, parts=("gaps",)).made == ["gaps"]


def test_a_key_is_read_by_its_digits(spark):
    keys = ["2024-02", "2024-13", "2024-00", "2024-2", "2024-02\n", "FY99-2000", "FY23-2024", "2024", "x", None]
    found = spark.createDataFrame([(k,) for k in keys], "k string").select(periods.key_bounds("k").alias("b"))
    assert "timestamp" not in str(periods.key_bounds(F.col("k"))).lower()
    shown = [r["b"] and (str(r["b"]["start"]), str(r["b"]["end"])) for r in found.collect()]
    assert shown == [("2024-02-01", "2024-02-29"), None, None, None, None, ("1999-04-01", "2000-03-31"), ("2023-04-01", "2024-03-31"), ("2024-01-01", "2024-12-31"), None, None]


def test_the_key_of_an_export_asks_for_no_balance(spark):
    label = text.label_pattern("Previous Balance").replace("\\", "\\\\")  # as a column shows it
    assert label in str(handlers.read(F.col("t"), "icici")) and label not in str(handlers.read(F.col("t"), "icici", balances=False))
    shown = spark.createDataFrame([("STATEMENT DATE\nJune 15, 2023\nStatement period : May 16, 2023 to June 15, 2023",), ("none",)], "t string")
    rows = shown.select(handlers.read(F.col("t"), "icici", balances=False).alias("a"), handlers.read(F.col("t"), "icici").alias("b")).collect()
    assert all(r["a"].asDict() == {k: v for k, v in r["b"].asDict().items() if k in r["a"].asDict()} for r in rows) and str(rows[0]["a"]["start"]) == "2023-05-16"


def test_a_document_is_not_written_anew_to_look_for_a_field(spark):
    docs = spark.createDataFrame([('{"last_fetch_date": "2024-01-01"}',), ('{"statements": null}',), ("[]",), ("x",)], "document string")
    found = metadata_files.checked(docs)
    assert "to_json" not in _plan(found)
    assert [(r["problem"], r["metadata"]) for r in found.collect()] == [(None, None), ("statements must be a list", None), ("metadata must be an object", None), ("not JSON", None)]
