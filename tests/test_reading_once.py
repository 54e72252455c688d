"""What reading a statement costs: nothing is looked for twice, and patterns that Spark would compile for each row are avoided."""

from collections import Counter

from pyspark.sql import functions as F

from tallyspark.functions import amounts, dates, text
from tallyspark.operators import handlers, idfc


def test_each_step_is_taken_once(spark, monkeypatch):
    taken = Counter()

    def counted(kind, step):
        return lambda *args: (taken.update([(kind, *args[1:])]), step(*args))[1]

    monkeypatch.setattr(handlers, "STEPS", {k: counted(k, f) for k, f in handlers.STEPS.items()})
    for part in ("_summary", "_block"):
        monkeypatch.setattr(idfc, part, counted(part, getattr(idfc, part)))
    for name in ("bob", "yes", "icici", "hdfc", "indusind", "signet", "edge_plain"):
        taken.clear()
        handlers.read(F.col("text"), name)
        assert set(taken.values()) == {1}, name
    taken.clear()
    handlers.read(F.col("text"), "wow")
    assert taken[("_summary",)] == taken[("_block",)] == 1


def test_patterns_of_labels_and_amounts_are_not_split_by(spark):
    x = F.col("x")
    plans = [str(c) for c in (text.after_label(x, "Previous Balance"), text.from_label(x, "Previous Balance"), amounts.tokens(x), dates.date_at_label(x, "Date"))]
    assert all("split(x" not in p for p in plans)
    shown = spark.createDataFrame([("a pREvious  balance\nRs. 5.00 Cr 7",), ("none",), (None,), ("Previous Balance",)], "x string")
    rows = shown.select(text.after_label(x, "Previous Balance", 6), text.from_label(x, "Previous Balance", 9), amounts.tokens(x)["pos"], text.sanitize(F.concat(x, F.lit(" ~x \n "))))
    assert [tuple(r) for r in rows.collect()] == [
        ("\nRs. 5", "pREvious ", [20, 32], "a pREvious  balance\nRs. 5.00 Cr 7  x\n"), (None, None, [], "none  x\n"), (None, None, None, None), ("", "Previous ", [], "Previous Balance  x\n"),
    ]
