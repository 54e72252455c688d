"""Files, settings and whole runs on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from tallyspark import settings
from tallyspark.functions import periods, text
from tallyspark.operators import balances, handlers, messages, run
from tallyspark.sources import files


def test_listing_and_canonical(spark, tmp_path):
    for name in ("FY24-2025/card/1/2024-05.PDF", "FY24-2025/card/1/2024-05.txt", "FY24-2025/card/1/2025.csv", "FY24-2025/card/1/transactions-2025.csv", "2023/card/1/2023.csv", "x/notes.doc", "x/metadata.json"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"{name}\nmore")
    everything = files.listing(spark, str(tmp_path), ("",))
    found = files.listing(spark, str(tmp_path), (".pdf", ".csv", ".txt"))
    assert {r["name"] for r in found.collect()} == {"2024-05.PDF", "2024-05.txt", "2025.csv", "transactions-2025.csv", "2023.csv"}
    assert {r["name"] for r in files.unsupported(everything).collect()} == {"notes.doc", "2024-05.txt"}
    kept = files.canonical(found)
    assert {(r["folder"], r["key"], r["kind"]) for r in kept.collect()} == {("FY24-2025", "2024-05", "pdf"), ("FY24-2025", "2024-05", "txt"), ("FY24-2025", "FY24-2025", "csv"), ("2023", "2023", "csv")}
    assert files.canonical(found, "2023").count() == 1
    pair = files.pairs(kept).first()
    assert pair["pdf"].endswith("2024-05.PDF") and pair["txt"].endswith("2024-05.txt")
    assert files.has_transactions(found) and not files.has_transactions(found.where("suffix = '.txt'"))
    assert [r["text"] for r in files.texts(spark, str(tmp_path)).collect()] == ["FY24-2025/card/1/2024-05.txt\nmore"]


def test_keys_of_paths(spark):
    rows = spark.createDataFrame([("2024-03",), ("FY24-2025",), ("2024",), ("x",)], "k string")
    out = [tuple(r) for r in rows.select(periods.folder_of(F.col("k")), periods.file_stem(F.col("k"))).collect()]
    assert out == [("FY23-2024", "2024-03"), ("FY24-2025", "2025"), ("2024", "2024"), ("unknown-month", "x")]
    assert spark.range(1).select(periods.upload_period(F.lit("manual__2024-05-06.pdf"))).first()[0] == "2024-05"


def test_settings(spark, tmp_path):
    accounts = [
        {"bank": "Yes", "variant": "ace", "account_number": " 12 ", "opening_date": "01-08-2021", "statement": {"text_contains": ["A", "a", ""]}},
        {"bank": "hdfc", "account_number": "34", "mail": {"subjects": ["mine"], "from": ["x@y.z"]}},
    ]
    path = tmp_path / "accounts.json"
    path.write_text("\n " + json.dumps(accounts))
    found = {r["account_number"]: r for r in settings.resolve(settings.load_accounts(spark, str(path))).collect()}
    assert found["12"]["subjects"] == ["Your YES_BANK_ACE Rupay Credit Card E-Statement"] and found["12"]["text_contains"] == ["A"] and str(found["12"]["opening"]) == "2021-08-01"
    assert found["34"]["subjects"] == ["mine"] and found["34"]["fiscal"] and str(found["34"]["tolerance"]) == "0.99" and found["34"]["variant"] == "default"
    loaded = settings.resolve(settings.load_accounts(spark, str(path)))
    assert settings.for_run(loaded, {"identifier": "34"}).count() == 1 and settings.for_run(loaded, {"identifier": None}).count() == 2
    with pytest.raises(ValueError):
        settings.for_run(loaded, {"identifier": "99"})
    with pytest.raises(ValueError):
        settings.for_run(loaded, {"other": 1})
    path.write_text(json.dumps(accounts[0]))
    with pytest.raises(ValueError):
        settings.load_accounts(spark, str(path))
    path.write_text(json.dumps([{"bank": "yes", "account_number": ""}]))
    with pytest.raises(Exception, match="no number"):
        settings.resolve(settings.load_accounts(spark, str(path))).collect()


def test_env_chain(tmp_path):
    (tmp_path / "a.env").write_text("# x\nA=1\nB=2\nENV_PATH=b.env\n")
    (tmp_path / "b.env").write_text('export B="3"\nC=yes\n')
    env = settings.Env(settings.env_chain(str(tmp_path / "a.env")))
    assert (env.number("A", 0), env.text("B"), env.flag("C", False), env.flag("D", True), env.number("E", 7)) == (1, "3", True, True, 7)
    with pytest.raises(ValueError):
        env.text("E")
    with pytest.raises(ValueError):
        env.flag("B", True)
    (tmp_path / "b.env").write_text("ENV_PATH=b.env\n")
    with pytest.raises(ValueError):
        settings.env_chain(str(tmp_path / "b.env"))
    assert settings.env_chain(str(tmp_path / "none")) == {}


def _head(opening, closing, month, lines=""):
    return f"Statement Period : 01/{month}/2024 To 28/{month}/2024\nPrevious Balance :\nRs. {opening}\nTotal Amount Due:\nRs. {closing}\n{lines}"


def test_run(spark):
    texts = [_head("1.00", "5.00", "01", "05/01/2024 TEA 4.00 Dr"), _head("9.00", "5.00", "02", "05/02/2024 BACK 4.00 Cr"), _head("2.00", "3.00", "02") + " NOT MINE", "nothing"]
    rows = [("a", "yes", None, f"p{i}", f"yes__2024-0{i + 1}-28.pdf", str(i % 4), texts[i % 4]) for i in range(4)] + [("b", "none", None, "q", "none.pdf", "9", "x")]
    table = spark.createDataFrame(rows, "account string, bank string, variant string, path string, name string, sha256 string, text string")
    table = table.withColumns({"mail_date": F.lit(None).cast("date"), "text_contains": F.array(F.lit("Statement Period")), "text_not_contains": F.array(F.lit("NOT  MINE"))})
    seen = []
    found = run.run(table, ("yes",), hook=lambda name, _: seen.append(name))
    assert seen == ["heads", "keyed", "decided", "kept", "metadata", "selected", "transactions", "unread", "gaps", "coverage", "alerts"] == found.made
    assert {(r["account"], r["key"], r["outcome"]) for r in found.decisions.collect()} == {("a", "2024-01", "prepared"), ("a", "2024-02", "prepared"), ("a", "2024-04", "rejected"), ("b", "unknown-month", "rejected")}
    assert {(r["description"], str(r["credited"]), str(r["debited"])) for r in found.transactions.collect()} == {("TEA", "0.00", "4.00"), ("BACK", "4.00", "0.00")}
    assert {(r["month"], r["status"]) for r in found.gaps.collect()} == {("2024-01", "discontinuity"), ("2024-02", "discontinuity")}
    assert [(r["account"], str(r["start"]), str(r["end"]), len(r["gaps"] or [])) for r in found.coverage.collect()] == [("a", "2024-01-01", "2024-02-28", 1)]
    assert {r["key"] for r in found.alerts.collect()} == {"2024-04", "unknown-month"}
    part = run.run(table, ("yes",), only=spark.createDataFrame([("p0",)], "path string"))
    assert {r["key"] for r in part.decisions.collect()} == {"2024-01"}


def test_unlabelled_column_and_marks(spark):
    labels = handlers.LAYOUTS["csb_edge"].labels
    plain = "top\n 05 Jan 2024  Rs. 10.00\n\n" + "\n".join(f"  Rs. {i}.00" for i in range(7)) + "\nend"
    out = spark.range(1).select(text.label_column(F.lit(plain), labels), text.label_column(F.lit(plain.replace("Rs. 6.00", "x")), labels)).first()
    assert out[0].split("\n")[1] == "Opening Balance  05 Jan 2024  Rs. 10.00" and "Total Amount Due  Rs. 6.00" in out[0] and out[1] == plain.replace("Rs. 6.00", "x")


def test_theta_join_in_blocks(spark):
    mail = spark.createDataFrame([("Card THE x", "a@b.c"), ("none", "a@b.c")], "subject string, address string").withColumn("day", F.lit("2024-01-05").cast("date"))
    rules = spark.createDataFrame([(i, ["the"], []) for i in range(7)], "account int, subjects array<string>, senders array<string>").withColumns({"start": F.lit(None).cast("date"), "end": F.lit(None).cast("date")})
    for block in (100, 3):
        assert sorted(r["account"] for r in messages.for_accounts(mail, rules, block).collect()) == list(range(7))
    assert messages.for_accounts(mail, rules.where("false")).count() == 0


def _files(spark, rows):
    """(account, bank, variant, path, text) as staged files; their name is the path's last part."""
    table = spark.createDataFrame(rows, "account string, bank string, variant string, path string, text string")
    return table.withColumns({"name": F.element_at(F.split("path", "/"), -1), "sha256": F.sha2("text", 256), "mail_date": F.lit(None).cast("date"), "text_contains": F.array().cast("array<string>"), "text_not_contains": F.array().cast("array<string>")})


def _export(*lines, period=""):
    return f"Card\n{period}Transaction Details:\nDate,Sr.No.,Details,Points,Intl,Amount\n" + "\n".join(lines) + "\nMESSAGE Details:\n"


def test_sources_of_a_run_are_selected(spark):
    rows = [
        ("a", "icici", None, "a/icici__2024-05-28.pdf", "Statement\n05/05/2024 123456 TEXT SHOP 1 7.00\n"),
        ("a", "icici", None, "a/2024-05.csv", _export("05/05/2024,1234567,CSV SHOP,0,0,7.00")),
        ("a", "icici", None, "a/2023-06.csv", _export("05/06/2023,1234567,JUNE,0,0,9.00")),
        ("a", "icici", None, "a/2024.csv", _export("05/05/2023,1234567,MAY,0,0,1.00", "05/06/2023,1234568,JUNE,0,0,9.00")),
        ("b", "icici", None, "b/2023-06.csv", _export("05/06/2023,1234567,OWN,0,0,9.00")),
    ]
    found = run.run(_files(spark, rows), ("icici",))
    assert {(r["account"], r["kind"], r["path"]) for r in found.selected.collect()} == {("a", "csv", "a/2024-05.csv"), ("a", "csv", "a/2024.csv"), ("b", "csv", "b/2023-06.csv")}
    # June of account a is in the year's export and counts once; the text of May 2024 gives way to its export
    assert sorted((r["account"], r["description"], str(r["debited"])) for r in found.transactions.collect()) == [("a", "CSV SHOP", "7.00"), ("a", "JUNE", "9.00"), ("a", "MAY", "1.00"), ("b", "OWN", "9.00")]
    assert {(r["account"], r["key"]): r["formats"] for r in found.metadata.collect() if r["key"] == "2024-05"} == {("a", "2024-05"): ["pdf", "txt", "csv"]}
    assert {r["kind"] for r in found.decisions.collect()} == {"pdf", "csv"}


def test_a_content_is_read_by_the_bank_of_its_account(spark):
    text_ = _head("1.00", "1.00", "01")
    for order in (1, -1):
        rows = [("a", "yes", None, "p/yes__2024-01-28.pdf", text_), ("b", "none", None, "q/none__2024-01-28.pdf", text_)][::order]
        found = run.run(_files(spark, rows), ("yes",))
        assert {(r["account"], r["opening"] and str(r["opening"])) for r in found.metadata.collect()} == {("a", "1.00"), ("b", None)}
        assert [r["account"] for r in found.unread.collect()] == ["b"]


def test_a_stopped_run_goes_on_from_its_last_stage(spark, tmp_path):
    rows = [("a", "yes", None, f"p/yes__2024-0{i}-28.pdf", _head("1.00", "5.00", f"0{i}", f"05/0{i}/2024 TEA 4.00 Dr")) for i in (1, 2)]
    root = f"file://{tmp_path}/run"

    def stop(name, table):
        if name == "kept":
            assert table.count() == 2  # it is written when the hook hears of it
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        run.run(_files(spark, rows), ("yes",), hook=stop, root=root)
    found = run.run(_files(spark, rows[::-1]), ("yes",), root=root)
    assert found.made == ["metadata", "selected", "transactions", "unread", "gaps", "coverage", "alerts"] and found.transactions.count() == 2
    (tmp_path / "run" / next(p.name for p in (tmp_path / "run").iterdir() if p.name.startswith("gaps-")) / "_SUCCESS").unlink()  # a job that was lost while it wrote
    assert run.run(_files(spark, rows), ("yes",), root=root).made == ["gaps"]
    assert run.run(_files(spark, rows[:1]), ("yes",), root=root).made[0] == "heads"


def test_tolerance_and_estimates_of_a_run(spark):
    """HDFC's statements may differ by 0.99, and those without a start are approximate."""
    chain = spark.createDataFrame([("h", "2024-01-01", "0.00", "5.00", "0.99"), ("h", "2024-02-01", "5.90", "6.00", "0.99"), ("y", "2024-01-01", "0.00", "5.00", "0.21"), ("y", "2024-02-01", "5.90", "6.00", "0.21")], "account string, month string, opening string, closing string, tolerance string")
    chain = chain.withColumns({"month": F.to_date("month"), **{c: F.col(c).cast("decimal(18,2)") for c in ("opening", "closing", "tolerance")}})
    assert {(r["account"], r["month"]) for r in balances.balance_gaps(chain, tolerance=F.col("tolerance")).collect()} == {("y", "2024-01"), ("y", "2024-02")}
    rows = [("h", "hdfc", "swiggy", "h/1.pdf", "Statement Date 15/01/2024\n"), ("y", "yes", None, "y/1.pdf", _head("1.00", "1.00", "01"))]
    found = run.run(_files(spark, rows), ("hdfc", "yes"))
    assert {r["account"]: r["estimated"] for r in found.metadata.collect()} == {"h": True, "y": False}
    assert {r["account"]: r["n_approximate"] for r in found.coverage.collect()} == {"h": 1, "y": 0}
    assert {r["account"]: str(r["tolerance"]) for r in found.metadata.collect()} == {"h": "0.99", "y": "0.21"}


def test_estimated_months_inside_a_year_and_years_by_name(spark):
    """A statement that only says its end is inside a year's export all the same; an upload is a year's by its name; a year's metadata has the year's bounds."""
    late = "STATEMENT DATE\nJune 15, 2023\n05/06/2023 123456 SHOP 1 7.00\n"
    year = _export("05/05/2023,1234567,MAY,0,0,1.00", "05/06/2023,1234568,JUNE,0,0,9.00")
    rows = [
        ("a", "icici", None, "a/icici__2023-06-15.pdf", late), ("a", "icici", None, "a/2023.csv", year), ("b", "icici", None, "b/icici__2023-06-15.pdf", late),
        ("c", "icici", None, "c/manual__FY23-2024.csv", _export("05/06/2023,1234567,JUNE,0,0,9.00")), ("c", "icici", None, "c/manual__2023-07.pdf", late),
    ]
    found = run.run(_files(spark, rows), ("icici",))
    assert sorted(r["path"] for r in found.selected.collect()) == ["a/2023.csv", "b/icici__2023-06-15.pdf", "c/manual__2023-07.pdf", "c/manual__FY23-2024.csv"]
    m = {(r["account"], r["key"]): r for r in found.metadata.collect()}
    assert {k: (str(r["period_start"]), str(r["period_end"]), r["estimated"], r["granularity"], r["year_key"]) for k, r in m.items()} == {
        ("a", "2023-06"): ("2023-05-16", "2023-06-15", True, "monthly", None),
        ("b", "2023-06"): ("2023-05-16", "2023-06-15", True, "monthly", None),
        ("c", "2023-07"): ("2023-05-16", "2023-06-15", True, "monthly", None),
        ("a", "FY23-2024"): ("2023-04-01", "2024-03-31", False, "annual", "FY23-2024"),
        ("c", "FY23-2024"): ("2023-04-01", "2024-03-31", False, "annual", "FY23-2024"),
    }
    months = m[("a", "FY23-2024")]["covered_months"]
    assert (months[0], months[-1], len(months)) == ("2023-04", "2024-03", 12) and m[("b", "2023-06")]["covered_months"] == []
