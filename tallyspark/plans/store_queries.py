"""Queries of what is published, selected and delivered."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import tables
from tallyspark.operators import run
from tallyspark.plans.catalogue import ORDERS_SQL, orders, query
from tallyspark.plans.parse_queries import render
from tallyspark.sources.published import Published
from tallyspark.sources.shared import shared_dir


@query(f"""with {ORDERS_SQL}, s as (select account, strftime(day, '%Y-%m') as key, sum(amount)::decimal(18,2) as total, count(*) as n from orders_t group by 1, 2)
select account, key, (case when n > 1 then 2 * total else total end)::decimal(18,2) as total from s where account % 10 <> 0""")
def published_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all periods are published; those of several orders are replaced, those of some accounts removed."""
    totals = orders(spark, sf_dir).groupBy("account", F.date_format("day", "yyyy-MM").alias("key")).agg(F.sum("amount").cast("decimal(18,2)").alias("total"), F.count(F.lit(1)).alias("n"))
    table = Published(spark, f"{shared_dir(spark)}/published-{uuid.uuid4().hex}", ["account", "key"])
    table.upsert(totals.select("account", "key", "total"))
    table.upsert(totals.where("n > 1").select("account", "key", (2 * F.col("total")).cast("decimal(18,2)").alias("total")))
    table.remove(totals.where("account % 10 = 0"))
    return table.read()


@query(f"""with {ORDERS_SQL} select account, day as date, 'N' || ref as description, amount, mark from orders_t""")
def parse_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of statements by a table function in SQL; the planner takes the rule from the constants."""
    tables.register(spark)
    line = F.concat_ws(" ", F.date_format("day", "dd/MM/yyyy"), F.concat(F.lit("N"), F.col("ref")), F.format_number("amount", 2), F.initcap("mark"))
    texts = render(orders(spark, sf_dir), line, "Statement").where("text is not null")
    return spark.sql(
        """SELECT s.account, to_date(t.day, 'dd/MM/yyyy') AS date, t.description, CAST(replace(t.amount, ',', '') AS DECIMAL(18,2)) AS amount, t.mark
        FROM {texts} s, LATERAL statement_lines(s.text, 'yes', 'ace') t""",
        texts=texts,
    )


@query(f"""with {ORDERS_SQL}, o as (
  select account, ref, strftime(day, '%Y-%m') as month, 'FY' || lpad((year(day - interval 3 month) % 100)::varchar, 2, '0') || '-' || (year(day - interval 3 month) + 1) as fy from orders_t
), y as (
  select account, fy, count(distinct month) as months from o group by 1, 2
)
select distinct o.account::varchar as account, case when account % 3 = 0 and months > 1 then fy else month end as key, 'csv' as kind from o join y using (account, fy)""")
def run_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports of every month, and for some accounts of every fiscal year too: the months that a year's export covers aren't parsed."""
    o = orders(spark, sf_dir).withColumn("fy", F.year(F.add_months("day", -3)))
    line = F.concat_ws(",", F.date_format("day", "dd/MM/yyyy"), F.col("ref") + 1000000, F.lit("x"), F.lit("0"), F.lit("0"), F.col("amount"))
    body = F.concat(F.lit("Card\nTransaction Details:\nDate,Sr.No.,Details,Points,Intl,Amount\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n"), F.lit("\nMESSAGE Details:\n"))
    months = o.groupBy("account", F.date_format("day", "yyyy-MM").alias("name")).agg(body.alias("text"))
    years = o.where("account % 3 = 0").groupBy("account", F.concat(F.lit("all-"), F.col("fy")).alias("name")).agg(body.alias("text"))
    none = F.array().cast("array<string>")
    files = months.unionByName(years).select(
        F.col("account").cast("string").alias("account"), F.lit("icici").alias("bank"), F.lit(None).cast("string").alias("variant"), F.concat_ws("/", "account", F.concat("name", F.lit(".csv"))).alias("path"),
        F.concat("name", F.lit(".csv")).alias("name"), F.sha2(F.concat_ws("/", "account", "text"), 256).alias("sha256"), "text", F.lit(None).cast("date").alias("mail_date"), none.alias("text_contains"), none.alias("text_not_contains"),
    )
    return run.run(files, ("icici",), parts=("selected",)).selected.select("account", "key", "kind")
