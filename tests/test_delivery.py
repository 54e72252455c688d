"""Alerts, marks and table functions: restarts and SQL."""

import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import tables
from tallyspark.streaming import alerts, marks

ALERT = "kind string, account string, source_file string, message string"


def sender(folder, fail=None):
    """Appends what it sends to a file of each alert; fails once at one account."""

    def send(alert):
        if alert["account"] == fail and not os.path.exists(f"{folder}/failed"):
            open(f"{folder}/failed", "w").close()
            raise RuntimeError("no connection")
        with open(f"{folder}/{alert['account']}", "a") as f:
            f.write(alerts.mail(alert, "me@bank.example", "you@home.example")["Message-ID"] + "\n")

    return send


def test_alerts_are_delivered_once_over_restarts(spark, tmp_path):
    inbox, out = tmp_path / "in", tmp_path / "out"
    out.mkdir()

    def add(*rows):
        spark.createDataFrame([("ambiguous", a, f, "m") for a, f in rows], ALERT).coalesce(1).write.mode("append").parquet(str(inbox))

    def go(fail=None):
        stream = spark.readStream.schema(ALERT).parquet(str(inbox))
        alerts.deliver(stream, f"file://{tmp_path}/box", f"file://{tmp_path}/checkpoint", sender(str(out), fail)).awaitTermination()

    add(("a", "x"), ("b", None), ("a", "x"), ("c", "x"))
    with pytest.raises(Exception, match="no connection"):
        go(fail="b")
    go(fail="b")
    add(("a", "x"), ("d", "x"))  # the first again, and a new one
    go()
    go()
    sent = {n: (out / n).read_text().split() for n in os.listdir(out) if n != "failed"}
    assert sorted(sent) == ["a", "b", "c", "d"] and all(len(v) == 1 for v in sent.values())
    batch = spark.createDataFrame([("ambiguous", "e", None, "m")], ALERT)
    for _ in range(2):
        alerts.deliver_batch(batch, 7, f"file://{tmp_path}/box", sender(str(out)))
    assert len((out / "e").read_text().split()) == 1


def test_marks_survive_a_restart(spark, tmp_path):
    inbox, rows = tmp_path / "in", "account string, day date"

    def go(*values):
        spark.createDataFrame([(a, d and date(2024, 5, d)) for a, d in values], rows).coalesce(1).write.mode("append").parquet(str(inbox))
        found = marks.marks(spark.readStream.schema(rows).parquet(str(inbox)), "account", "day")
        seen = {}
        q = found.writeStream.outputMode("update").foreachBatch(lambda b, n: seen.update({r["account"]: tuple(r)[1:] for r in b.collect()})).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        return seen

    assert go(("a", 3), ("a", 7), ("b", None)) == {"a": (date(2024, 5, 7), date(2024, 5, 6), 2, 0), "b": (None, None, 1, 0)}
    assert go(("a", 6), ("a", 2)) == {"a": (date(2024, 5, 7), date(2024, 5, 6), 4, 1)}
    assert go(("a", 9), ("b", 1)) == {"a": (date(2024, 5, 9), date(2024, 5, 8), 5, 0), "b": (date(2024, 5, 1), date(2024, 4, 30), 2, 0)}


def test_table_function_in_a_lateral_join(spark):
    tables.register(spark)
    text = "head\n05/01/2024 TEA 4.00 Dr\nnil transaction\n06/01/2024 BACK 1,004.00 Cr\n"
    spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string").createOrReplaceTempView("statement_texts")
    got = spark.sql("SELECT s.id, t.* FROM statement_texts s, LATERAL statement_lines(s.text, 'yes', 'ace') t ORDER BY t.pos").collect()
    assert [tuple(r) for r in got] == [(1, 1, "05/01/2024", "TEA", "4.00", "DR", None), (1, 3, "06/01/2024", "BACK", "1,004.00", "CR", None)]
    for call in ("statement_lines(s.text, 'nobody', 'x')", "statement_lines(s.text, s.text, 'x')", "statement_lines(s.id, 'yes', 'ace')"):
        with pytest.raises(Exception, match="no single line rule|constants|first argument"):
            spark.sql(f"SELECT * FROM statement_texts s, LATERAL {call} t").collect()
