"""Queries of uploads, stored metadata, and months by year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import periods
from tallyspark.operators import run
from tallyspark.plans.catalogue import ORDERS_SQL, dealt, orders, query, table
from tallyspark.sources import metadata_files, uploads

_FISCAL = "'FY' || lpad((year(day - interval 3 month) % 100)::varchar, 2, '0') || '-' || (year(day - interval 3 month) + 1)"


@query(f"""with {ORDERS_SQL}, u as (
  select account::varchar as account, ref, case when ref % 2 = 0 then 'pdf' else 'csv' end as kind, ref % 5 as k, {_FISCAL} as fy, strftime(day, '%Y-%m') as month,
         case ref % 5 when 0 then {_FISCAL} when 1 then strftime(day, '%Y') || '-13' else strftime(day, '%Y-%m') end as key
  from orders_t
), there as (select distinct account, kind, month as key, true as t from u where ref % 7 = 0
), w as (select u.*, t, min(ref) over p as first, max(ref) over p as last from u left join there using (account, kind, key) window p as (partition by account, kind, key)
), o as (select *, case when k = 1 then 'invalid' when t then 'exists' when kind = 'pdf' then case when ref = last then 'staged' else 'replaced' end when ref = first then 'saved' else 'exists' end as outcome from w)
select ref, outcome, case outcome when 'staged' then '/in/card/' || account || '/manual__' || key || '.pdf'
       when 'saved' then '/data/' || fy || '/card/' || account || '/' || (case when k = 0 then right(fy, 4) else key end) || '.csv' end as target from o""")
def uploads_planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is an upload of its month or year, PDF or export, some for months that aren't; some months have a canonical file."""
    day, ref = F.col("day"), F.col("ref")
    kind = F.when(ref % 2 == 0, "pdf").otherwise("csv")
    key = F.when(ref % 5 == 0, periods.fiscal_key(day)).when(ref % 5 == 1, F.concat(F.year(day), F.lit("-13"))).otherwise(periods.month_key(day))
    o = dealt(orders(spark, sf_dir)).withColumn("account", F.col("account").cast("string"))
    canonical = o.where("ref % 7 = 0").select("account", kind.alias("kind"), periods.month_key(day).alias("key"))
    given = o.select("account", F.lit("card").alias("account_type"), kind.alias("kind"), key.alias("key"), "ref")
    return uploads.plan(given, canonical, "/data", "/in", order="ref").select("ref", "outcome", "target")


@query(f"""with {ORDERS_SQL}, e as (
  select account, strftime(day, '%Y') as y, count(distinct date_trunc('month', day)) as n, max(day) as day from orders_t group by 1, 2
), k as (
  select account, account || '-' || y || '-' || copy || '.zip' as path, n, case when n = 1 then strftime(day, '%Y-%m') else {_FISCAL} end as key from e, (values (1), (2)) c(copy)
), r as (
  select *, row_number() over (partition by account, key order by path) - 1 as i from k
), m as (
  select *, case when n > 1 or account % 2 = 1 then i when account % 4 = 2 then i + 1 when i = 0 then 1 else i + 2 end as number from r
)
select path, 'manual__' || key || case when number > 0 then ' (' || number || ')' else '' end || '.csv' as target from m""")
def uploads_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two copies of every year's export per account, named by the period in them; of even accounts names of months are taken already."""
    line = F.concat_ws(",", F.date_format("day", "dd/MM/yyyy"), F.col("ref") + 1000000, F.lit("x"), F.lit("0"), F.lit("0"), F.col("amount"))
    o = orders(spark, sf_dir)
    per = o.groupBy("account", F.year("day").alias("y")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("rows"))
    body = F.concat(F.lit("Card\nTransaction Details:\nDate,Sr.No.,Details,Points,Intl,Amount\n"), F.col("rows"))
    copies = per.select("account", "y", body.alias("text"), F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    members = copies.select("account", F.concat(F.concat_ws("-", "account", "y", "copy"), F.lit(".zip")).alias("path"), F.lit("x.csv").alias("name"), "text", F.lit(1).alias("anchor"))
    said = run.export_keys(members.drop("account")).select(F.col("id").alias("path"), "key")
    name = F.concat(F.lit("manual__"), periods.month_key(F.col("day")), F.col("n"), F.lit(".csv"))
    numbers = F.when(F.col("account") % 4 == 0, F.array(F.lit(""), F.lit(" (2)"))).when(F.col("account") % 4 == 2, F.array(F.lit("")))
    taken = o.select("account", "day", F.explode(numbers).alias("n")).select("account", name.alias("name"))
    return uploads.staged_names(members.join(said, "path"), taken).select("path", "target")


@query(f"""with {ORDERS_SQL}, n as (select account, count(*) as n, count(distinct strftime(day, '%Y-%m')) as m from orders_t group by 1
), d as (select c_custkey as account, c_custkey % 7 as kind, n, m from customer left join n on account = c_custkey)
select account, kind >= 4 or (kind = 2 and n is null) as stored, case when kind = 2 and n > 0 then 'granularity must be monthly or annual' when kind = 3 then 'statements must be a list' end as problem,
       (case when kind < 2 then m when kind = 3 or (kind = 2 and n > 0) then null else coalesce(n, 0) end)::bigint as n_statements,
       (case when kind < 2 then m when kind = 3 or (kind = 2 and n > 0) then null else coalesce(n, 0) end)::bigint as statement_count from d""")
def metadata_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata per customer: from a document where there is a sound one, computed where there is none or one without statements."""
    day, kind = F.col("day"), F.col("account") % 7
    o = orders(spark, sf_dir)
    accounts = dealt(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account")), "account")

    def payload(dates: str, granularity: str) -> Column:
        one = lambda d: F.struct(d.alias("statement_date"), F.array(F.lit("pdf")).alias("formats"), F.lit(granularity).alias("granularity"), F.array(F.substring(d, 1, 7)).alias("covered_months"))
        head = (F.col("account").cast("string").alias("account_number"), F.lit("yes").alias("bank"), F.lit("credit_card").alias("account_type"))
        return F.to_json(F.struct(*head, F.transform(dates, one).alias("statements"), F.col(dates).alias("statement_dates"), F.struct(F.size(dates).alias("approximate_statement_count")).alias("period_covered")))

    days = accounts.join(o.groupBy("account").agg(F.sort_array(F.collect_list(F.date_format(day, "yyyy-MM-dd"))).alias("days")), "account", "left").withColumn("days", F.coalesce("days", F.array().cast("array<string>")))
    document = F.when(kind == 1, '{"last_fetch_date": "2024-01-01"}').when(kind == 2, payload("days", "weekly")).when(kind == 3, '{"statements": {}}').otherwise(payload("days", "monthly"))
    docs = metadata_files.checked(days.where(kind > 0).select("account", document.alias("document")))
    months = o.groupBy("account").agg(F.sort_array(F.collect_set(F.date_format(F.trunc("day", "MM"), "yyyy-MM-dd"))).alias("days"))
    computed = months.select("account", F.from_json(payload("days", "monthly"), f"struct<{metadata_files.METADATA}>").withField("statement_count", F.size("days").cast("long")).alias("metadata"))
    found = metadata_files.load(accounts, docs, computed)
    n = F.when(F.col("metadata").isNotNull(), F.size("metadata.statements").cast("long"))
    return found.select("account", "stored", "problem", n.alias("n_statements"), F.col("metadata.statement_count").alias("statement_count"))


@query(f"""with {ORDERS_SQL}, s as (select account, date_trunc('month', min(day)) as a, date_trunc('month', max(day)) as b from orders_t group by 1
), m as (select account, unnest(generate_series(a, b, interval 1 month))::date as day from s), k as (select account, day, {_FISCAL} as year_key, year(day - interval 3 month) as y from m)
select account, year_key, (dense_rank() over (partition by account order by y desc) - 1)::integer as section, (row_number() over (partition by account, y order by day desc) - 1)::integer as place, strftime(day, '%Y-%m') as month from k""")
def months_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every month of an account's span with its place: the newest fiscal year first, in it the newest month first."""
    span = orders(spark, sf_dir).groupBy("account").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    sections = span.select("account", F.posexplode(periods.year_sections(F.col("a"), F.col("b"))).alias("section", "s"))
    return sections.select("account", "s.year_key", "section", F.posexplode("s.months").alias("place", "month"))
