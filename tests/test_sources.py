"""Sources that read only what is asked for."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from tallyspark.sources import files, mailbox_source, statement_tree


def tasks(df):
    """Tasks of a scan that have rows."""
    return df.select(F.spark_partition_id()).distinct().count()


def mail(sender, subject, day, body, charset="utf-8"):
    return f"From x\nFrom: {sender}\nSubject: {subject}\nDate: {day}\nContent-Type: text/plain; charset=\"{charset}\"\n\n{body}\n\n".encode("latin-1")


def with_store(path, *mails, name="Inbox"):
    path.mkdir(parents=True, exist_ok=True)
    (path / f"{name}.msf").write_text("index")
    (path / name).write_bytes(b"".join(mails))


ACCOUNTS = "account string, subjects array<string>, senders array<string>, body_contains array<string>, start date, end date"
#: Python refuses a charset with a zero byte, so decoding such a body ends the job.
POISON = "a\0b"


def accounts(spark, *rows):
    return spark.createDataFrame([(a, s, f, b, datetime.date(2024, 1, 1), datetime.date(2024, 12, 31)) for a, s, f, b in rows], ACCOUNTS)


def test_bodies_outside_the_filter_are_never_decoded(spark, tmp_path):
    good = mail("a@bank.example", "Your statement", "Tue, 02 Jan 2024 23:00:00 +0500", "hello card 12")
    other = mail("b@shop.example", "Offer", "Tue, 02 Jan 2024 23:00:00 +0500", "x", POISON)
    late = mail("a@bank.example", "Your statement", "Tue, 02 Jan 2029 23:00:00 +0500", "x", POISON)
    with_store(tmp_path, other, good, late, mail("a@bank.example", "Your statement", "Wed, 03 Jan 2024 01:00:00 +0500", "nothing"))
    mine = accounts(spark, ("1", ["statement"], ["bank.example"], ["card 12"]), ("2", ["STATEMENT"], [], []))
    found, counts = mailbox_source.scan(spark, str(tmp_path), mine)
    assert sorted((r["account"], r["body"].strip()) for r in found.collect()) == [("1", "hello card 12"), ("2", "hello card 12"), ("2", "nothing")]
    assert {r["account"]: r["messages"] for r in counts.collect()} == {"1": 1, "2": 2}
    everything = accounts(spark, ("3", ["offer"], [], []))
    with pytest.raises(Exception, match="null"):
        mailbox_source.scan(spark, str(tmp_path), everything)[0].collect()
    # the whole-message way decodes before it filters
    with pytest.raises(Exception, match="null"):
        mailbox_source.scan_messages(mailbox_source.messages(spark, str(tmp_path)), mine)[0].collect()


@pytest.mark.parametrize("split", [1, 37, 1 << 20])
def test_ranges_cover_every_message_once(spark, tmp_path, split):
    mails = [mail(f"s{i}@x.example", f"n {i}", "Tue, 02 Jan 2024 23:00:00 +0500", "From here\non" if i % 2 else ">From there\nFromage") for i in range(6)]
    with_store(tmp_path / "deep", *mails)
    with_store(tmp_path, mail("z@x.example", "crlf", "no day", "body").replace(b"\n", b"\r\n"), name="Sent")
    (tmp_path / "Stray").write_bytes(mails[0])
    found = mailbox_source.headers(spark, str(tmp_path), split).collect()
    subjects = sorted(r["subject"] for r in found if r["address"])
    assert subjects == ["crlf", *(f"n {i}" for i in range(6))]
    assert {(r["subject"], r["day"]) for r in found if r["subject"] in ("crlf", "n 1")} == {("crlf", None), ("n 1", datetime.date(2024, 1, 2))}
    for r in found:
        with open(r["path"], "rb") as f:
            f.seek(r["offset"])
            assert f.read(r["size"]).startswith((b"From: ", b"on"))  # a line of a body that begins like a message is one to any reader of such stores


def test_other_stores_and_days_do_not_leave_the_mail_source(spark, tmp_path):
    with_store(tmp_path, mail("a@x.example", "one", "Tue, 02 Jan 2024 23:00:00 +0500", "x"), mail("a@x.example", "undated", "?", "x"), name="A")
    with_store(tmp_path, mail("a@x.example", "two", "Wed, 03 Jan 2024 23:00:00 +0500", "x"), name="B")
    heads = lambda **k: mailbox_source.headers(spark, str(tmp_path), **k)
    names = lambda df: sorted(r["subject"] for r in df.collect())
    one = heads(paths=[str(tmp_path / "A")])
    assert tasks(one) == 1 and tasks(heads()) == 2
    assert names(one) == ["one", "undated"] and names(heads()) == ["one", "two", "undated"] and names(one.unionByName(heads(paths=[str(tmp_path / "B")]))) == ["one", "two", "undated"]
    day = datetime.date(2024, 1, 2)
    assert names(heads(since=day + datetime.timedelta(1))) == ["two"] and names(heads(until=day)) == ["one"] and names(heads(paths=[])) == []


@pytest.fixture
def grown(tmp_path):
    for name in ("FY24-2025/card/1/2024-05.pdf", "FY24-2025/card/1/2024-05.txt", "FY24-2025/card/2/2025.csv", "2023/card/1/2023.csv", "2023/bank/9/2023.csv", "other/card/1/2020-01.pdf"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
    return tmp_path


def test_only_the_wanted_folder_is_listed(spark, grown):
    tree = statement_tree.tree(spark, str(grown))
    wanted = statement_tree.tree(spark, str(grown), folder=["FY24-2025"])
    assert tasks(wanted) == 1 and tasks(tree) == 3
    assert sorted(r["name"] for r in wanted.collect()) == ["2024-05.pdf", "2024-05.txt", "2025.csv"]
    other = statement_tree.tree(spark, str(grown), folder=["2023"], account_type=["bank"])
    assert wanted.unionByName(other).count() == 4 and tree.count() == 5  # each frame has its own folders
    with pytest.raises(ValueError, match="no level"):
        statement_tree.tree(spark, str(grown), year=["2023"])


def test_folders_that_nobody_asks_for_are_not_opened(grown, monkeypatch):
    opened = []
    real = os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: (opened.append(os.path.relpath(p, grown)), real(p))[1])
    reader = statement_tree._TreeReader(str(grown), {"folder": ["2023"], "account_number": ["1", "7"]})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[1] for r in rows] == ["2023.csv"] and opened == ["2023", "2023/card/1"]


def test_canonical_of_a_tree(spark, grown):
    by_source = {(r["folder"], r["account_number"], r["key"], r["kind"]) for r in statement_tree.canonical(spark, str(grown)).collect()}
    listed = files.canonical(files.listing(spark, str(grown), (".pdf", ".txt", ".csv")))
    assert by_source == {(r["folder"], r["account_number"], r["key"], r["kind"]) for r in listed.collect()} and len(by_source) == 5
    assert statement_tree.canonical(spark, str(grown), "2023", ["9"]).count() == 1
    assert {r["name"] for r in statement_tree.under(spark, f"file://{grown}", "FY24-2025", "1").collect()} == {"2024-05.pdf", "2024-05.txt"}
    assert statement_tree.under(spark, f"file://{grown}").count() == 5
