"""Registry of queries: each has a name, a function (spark, sf_dir) and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as transactions: account, day, ref, amount, mark, note."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("account"),
        F.to_date("o_orderdate").alias("day"),
        F.col("o_orderkey").alias("ref"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        F.when(F.col("o_orderstatus") == "F", "CR").otherwise("DR").alias("mark"),
        F.col("o_orderpriority").alias("note"),
    )


def dealt(rows: DataFrame, key: str = "ref") -> DataFrame:
    """``rows`` dealt over the cores by a key that few share: what is done with an order takes far longer than its few bytes suggest, and few row groups may hold them."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


#: The same for SQL, to stand after WITH.
ORDERS_SQL = """
orders_t as (
  select o_custkey as account, o_orderdate::date as day, o_orderkey as ref, o_totalprice::decimal(18,2) as amount,
         case when o_orderstatus = 'F' then 'CR' else 'DR' end as mark, o_orderpriority as note
  from orders
)
"""


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements: account x month with first and last day, and running balances.

    The reported opening balance is off by 0.22 (beyond the tolerance), 0.21 (on its edge) or 0 by the least ref modulo 7.
    """
    from pyspark.sql import Window

    signed = F.when(F.col("mark") == "CR", -F.col("amount")).otherwise(F.col("amount"))
    per = orders(spark, sf_dir).groupBy("account", F.trunc("day", "MM").alias("month")).agg(
        F.min("day").alias("start"), F.max("day").alias("end"), F.sum(signed).cast("decimal(18,2)").alias("net"), F.count(F.lit(1)).alias("n"), F.min("ref").alias("ref")
    )
    w = Window.partitionBy("account").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    off = F.when(F.col("ref") % 7 == 0, F.lit("0.22")).when(F.col("ref") % 7 == 1, F.lit("0.21")).otherwise("0.00").cast("decimal(18,2)")
    closing = F.sum("net").over(w).cast("decimal(18,2)")
    return per.withColumn("closing", closing).withColumn("opening", (F.col("closing") - F.col("net") + off).cast("decimal(18,2)"))


MONTHLY_SQL = (
    ORDERS_SQL
    + """, per_month as (
  select account, date_trunc('month', day)::date as month, min(day) as start, max(day) as "end",
         sum(case when mark = 'CR' then -amount else amount end)::decimal(18,2) as net, count(*) as n, min(ref) as ref
  from orders_t group by 1, 2
), closed as (
  select *, (sum(net) over (partition by account order by month))::decimal(18,2) as closing from per_month
), monthly as (
  select *, (closing - net + case when ref % 7 = 0 then 0.22 when ref % 7 = 1 then 0.21 else 0 end)::decimal(18,2) as opening from closed
)
"""
)
