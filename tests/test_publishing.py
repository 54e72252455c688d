"""Published tables, promotion and deletion, with failures between the steps."""

import os

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import cleanup
from tallyspark.sources import deletion, files, storage
from tallyspark.sources.published import Conflict, Published


def rows(df):
    return None if df is None else sorted(tuple(r) for r in df.collect())


def table_of(spark, *values):
    return spark.createDataFrame(list(values), "account string, key string, amount int")


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_an_upsert_replaces_its_keys_only(spark, tmp_path, fmt):
    table = Published(spark, f"file://{tmp_path}/t", ["account", "key"], fmt)
    assert table.read() is None and table.generation() == 0 and table.remove(table_of(spark, ("a", "1", 1))) == 0
    assert table.upsert(table_of(spark, ("a", "1", 1), ("a", "2", 2), ("b", None, 3))) == 1
    assert table.upsert(table_of(spark, ("a", "1", 7), ("a", "1", 8), ("b", None, 4))) == 2
    assert rows(table.read().fillna("-")) == [("a", "1", 7), ("a", "1", 8), ("a", "2", 2), ("b", "-", 4)]
    assert rows(table.read(1).fillna("-")) == [("a", "1", 1), ("a", "2", 2), ("b", "-", 3)]
    table.remove(table.read().where("key = '1'"))
    assert rows(table.read().fillna("-")) == [("a", "2", 2), ("b", "-", 4)]
    gone = table.vacuum()
    assert len([x for x in gone if x.startswith("log/")]) == 2 and rows(table.read().fillna("-")) == [("a", "2", 2), ("b", "-", 4)]
    assert len(storage.names(spark, f"file://{tmp_path}/t/data")) == 2 and table.vacuum() == []


def test_a_failure_before_the_publication_leaves_the_old_state(spark, tmp_path, monkeypatch):
    table = Published(spark, f"file://{tmp_path}/t", ["account", "key"])
    table.upsert(table_of(spark, ("a", "1", 1)))
    for broken in ("publish", "_commit"):  # after the rows are written; after the manifest is made
        with monkeypatch.context() as m:
            m.setattr(Published, broken, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(RuntimeError):
                table.upsert(table_of(spark, ("a", "1", 2), ("a", "2", 2)))
        assert rows(table.read()) == [("a", "1", 1)] and table.generation() == 1
    failing = table_of(spark, ("a", "1", 2)).withColumn("amount", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        table.upsert(failing)
    assert rows(table.read()) == [("a", "1", 1)]
    table.upsert(table_of(spark, ("a", "1", 3)))
    assert rows(table.read()) == [("a", "1", 3)]
    assert len([x for x in table.vacuum() if x.startswith("data/")]) >= 3 and rows(table.read()) == [("a", "1", 3)]


def test_the_second_of_two_writers_starts_anew(spark, tmp_path, monkeypatch):
    table, other = (Published(spark, f"file://{tmp_path}/t", ["account", "key"]) for _ in range(2))
    table.upsert(table_of(spark, ("a", "1", 1)))
    commit, tries = Published._commit, []

    def late(self, n, manifest, schema):
        tries.append(n)
        if self is table and len(tries) == 1:
            other.upsert(table_of(spark, ("b", "1", 2)))
        return commit(self, n, manifest, schema)

    monkeypatch.setattr(Published, "_commit", late)
    assert table.upsert(table_of(spark, ("a", "1", 5))) == 3 and tries == [2, 2, 3]
    assert rows(table.read()) == [("a", "1", 5), ("b", "1", 2)]
    assert not storage.create(spark, f"file://{tmp_path}/t/log/{3:012d}", "x")
    monkeypatch.setattr(storage, "create", lambda *_: False)
    with pytest.raises(Conflict):
        table.upsert(table_of(spark, ("a", "1", 6)))


def staged(spark, root, names):
    root.mkdir(parents=True, exist_ok=True)
    for n in names:
        (root / n).write_text(n)
    return files.listing(spark, f"file://{root}").select("path", "name", "modified")


def test_promotion_then_deletion_of_what_was_staged(spark, tmp_path, monkeypatch):
    listed = staged(spark, tmp_path / "in", ["a1.pdf", "a2.pdf", "b1.pdf"])
    table = Published(spark, f"file://{tmp_path}/canonical", ["account", "key"])
    known = listed.select(F.substring("name", 1, 1).alias("account"), F.lit("2024-01").alias("key"), "path", "modified", F.sha2("name", 256).alias("sha256"), F.concat(F.lit("text of "), F.col("name")).alias("text"))
    outcome = F.when(F.col("account") == "a", "prepared").otherwise("ambiguous")
    decisions = known.groupBy("account", "key").agg(F.max("path").alias("keeper_path")).withColumn("outcome", outcome)
    with monkeypatch.context() as m:
        m.setattr(Published, "publish", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            cleanup.promote(known, decisions, table, ["account", "key"])
    assert table.read() is None and len(os.listdir(tmp_path / "in")) >= 3
    may_go = cleanup.promote(known, decisions, table, ["account", "key"])
    assert [(r["account"], r["text"]) for r in table.read().collect()] == [("a", "text of a2.pdf")] and table.generation() == 1
    cleanup.promote(known, decisions, table, ["account", "key"])
    assert table.generation() == 1  # nothing new
    journal = f"file://{tmp_path}/journal"
    first = deletion.delete(may_go, journal)
    assert sorted(r["outcome"] for r in first.collect()) == ["deleted", "deleted"] and [x for x in os.listdir(tmp_path / "in") if x.endswith("pdf")] == ["b1.pdf"]
    assert deletion.delete(known.where("false"), journal).count() == 0


def test_a_second_run_deletes_nothing_and_new_files_of_old_names_can_go(spark, tmp_path):
    root, journal = tmp_path / "in", f"file://{tmp_path}/journal"
    listed = staged(spark, root, ["x.pdf", "y.pdf"]).cache()
    assert listed.count() == 2
    assert deletion.delete(listed, journal).where("outcome = 'deleted'").count() == 2
    (root / "x.pdf").write_text("new")
    os.utime(root / "x.pdf", (2_000_000_000, 2_000_000_000))
    assert deletion.delete(listed, journal).count() == 0 and (root / "x.pdf").exists()
    assert deletion.delete(files.listing(spark, f"file://{root}"), journal).count() == 1 and not (root / "x.pdf").exists()
    listed.unpersist()


def test_a_run_that_died_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    root, journal = tmp_path / "in", f"file://{tmp_path}/journal"
    listed = staged(spark, root, [f"{i}.pdf" for i in range(6)])
    with monkeypatch.context() as m:
        m.setattr(deletion, "_outcomes", lambda planned: planned.withColumn("outcome", F.raise_error(F.lit("lost")).cast("string")))
        with pytest.raises(Exception, match="lost"):
            deletion.delete(listed, journal)
    (root / "0.pdf").unlink()  # what a lost task had done
    (root / "1.pdf").write_text("changed")
    os.utime(root / "1.pdf", (2_000_000_000, 2_000_000_000))
    found = deletion.delete(listed.where("false"), journal)
    assert {r["path"][-5:]: r["outcome"] for r in found.collect()} == {"0.pdf": "gone", "1.pdf": "kept"} | {f"{i}.pdf": "deleted" for i in range(2, 6)}
    assert [x for x in os.listdir(root) if x.endswith("pdf")] == ["1.pdf"]


def test_an_account_goes_with_its_empty_folders(spark, tmp_path):
    root = tmp_path / "tree"
    for n in ("FY24-2025/card/1/2024-05.pdf", "2023/card/1/2023.csv", "2023/card/2/2023.csv"):
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_text(n)
    listed = files.listing(spark, f"file://{root}").withColumn("account", F.element_at(F.split("path", "/"), -2))
    table = Published(spark, f"file://{tmp_path}/canonical", ["account", "key"])
    table.upsert(table_of(spark, ("1", "2024-05", 1), ("2", "2023", 2)))
    done = cleanup.delete_account("1", table, listed, f"file://{tmp_path}/journal", str(root))
    assert done.where("outcome = 'deleted'").count() == 2 and rows(table.read()) == [("2", "2023", 2)]
    assert sorted(os.path.relpath(d, root) for d, _, _ in os.walk(root)) == [".", "2023", "2023/card", "2023/card/2"]


def test_a_refresh_of_metadata_keeps_the_fetch_date(spark, tmp_path):
    table = Published(spark, f"file://{tmp_path}/meta", ["account"], "json")
    old = spark.createDataFrame([("a", 1, "2024-05-01"), ("b", 2, None)], "account string, statements int, last_fetch_date string")
    table.upsert(old)
    cleanup.publish_metadata(spark.createDataFrame([("a", 9), ("c", 3)], "account string, statements int"), table, "account")
    assert {tuple(r) for r in table.read().collect()} == {("a", 9, "2024-05-01"), ("b", 2, None), ("c", 3, None)}
