"""Queries of whole runs: staged statements to transactions and metadata, keys of exports and paths, accounts with their handler's rules."""

from __future__ import annotations

import inspect
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark import settings
from tallyspark.functions import dates, periods, text
from tallyspark.operators import run
from tallyspark.operators.stages import Stage, Stages, fingerprint
from tallyspark.plans.catalogue import MONTHLY_SQL, ORDERS_SQL, monthly, orders, query
from tallyspark.plans.parse_queries import render
from tallyspark.sources import files as listing
from tallyspark.sources.shared import shared_dir


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement per account and month, two files of each: the second is a copy, as an overlapping fetch leaves it."""
    money = lambda c: F.format_number(c, 2)
    line = F.concat_ws(" ", F.date_format("day", "dd/MM/yyyy"), F.concat(F.lit("N"), F.col("ref")), money(F.col("amount")), F.initcap("mark"))
    body = render(orders(spark, sf_dir), line).withColumnRenamed("month", "m")
    m = monthly(spark, sf_dir).select(F.col("account").alias("a"), F.date_format("month", "yyyy-MM").alias("mm"), "month", "opening", "closing")
    joined = body.join(m, (F.col("account") == F.col("a")) & (F.col("m") == F.col("mm")))
    signed = lambda c: F.concat(F.lit("Rs. "), F.format_number(F.abs(c), 2), F.when(F.col(c) < 0, " Cr").otherwise(" Dr"))
    head = F.concat(
        F.lit("Statement Period : "), F.date_format("month", "dd/MM/yyyy"), F.lit(" To "), F.date_format(F.last_day("month"), "dd/MM/yyyy"),
        F.lit("\nPrevious Balance :\n"), signed("opening"), F.lit("\nTotal Amount Due:\n"), signed("closing"), F.lit("\n"),
    )
    one = joined.select("account", F.lit("yes").alias("bank"), F.lit("ace").alias("variant"), F.concat(head, F.col("text")).alias("text"), F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"), F.col("mm"))
    name = F.concat(F.lit("yes__"), F.col("mm"), F.lit("-28"), F.when(F.col("copy") == 2, " (1)").otherwise(""), F.lit(".pdf"))
    return one.select(
        F.col("account").cast("string").alias("account"), "bank", "variant", F.concat_ws("/", F.col("account"), name).alias("path"), name.alias("name"), F.sha2("text", 256).alias("sha256"), "text",
        F.lit(None).cast("date").alias("mail_date"), F.array(F.lit("Statement Period")).alias("text_contains"), F.array(F.lit("NOT  MINE")).alias("text_not_contains"),
    )


def _run(spark: SparkSession, sf_dir: str, part: str) -> DataFrame:
    """A table of one run for all queries that ask for a part of it: the second finds the stages of the first. The files are written once, as a run reads them several times."""
    root, o = f"{shared_dir(spark)}/runs", orders(spark, sf_dir)
    files = Stages(spark, root).run("files", [Stage(o, fingerprint(o, o.columns))], lambda: _staged(spark, sf_dir), inspect.getsource(sys.modules[__name__]))
    return getattr(run.run(files.table, ("yes",), root=root, parts=(part,)), part)


@query(f"""with {MONTHLY_SQL}, nxt as (
  select *, lead(month) over w as next_month, lead(opening) over w as next_opening from monthly window w as (partition by account order by month)
), said as (
  select account, unnest([month, next_month]) as m, 'discontinuity' as status from nxt where next_month = month + interval 1 month and abs(closing - next_opening) > 0.21
  union all
  select account, unnest(generate_series(month + interval 1 month, next_month - interval 1 month, interval 1 month))::date,
         case when abs(closing - next_opening) <= 0.21 then 'matched' else 'mismatched' end from nxt where next_month > month + interval 1 month
)
select account::varchar as account, strftime(m, '%Y-%m') as month, status from said""")
def run_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaks in the balances and missing months of staged statements, by their handler's tolerance."""
    return _run(spark, sf_dir, "gaps").select("account", "month", "status")


@query(f"""with {MONTHLY_SQL}, marked as (
  select account, month, coalesce(lag(month) over (partition by account order by month) = month - interval 1 month, false) as goes_on from monthly
)
select account::varchar as account, min(month) as "start", last_day(max(month)) as "end", count(*) filter (not goes_on) as n_segments, (count(*) filter (not goes_on) - 1)::bigint as n_gaps, count(*) as n_months, 0::bigint as n_approximate
from marked group by account""")
def run_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What staged statements cover; none of their periods is estimated."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    found = _run(spark, sf_dir, "coverage").withColumn("gaps", F.coalesce("gaps", F.array().cast("array<struct<start:date,end:date>>")))
    return found.select("account", "start", "end", n("segments").alias("n_segments"), n("gaps").alias("n_gaps"), n("months").alias("n_months"), "n_approximate")


@query(f"""with {ORDERS_SQL}
select account::varchar as account, strftime(day, '%Y-%m') as key, day as date, 'N' || ref as description,
       (case when mark = 'CR' then amount else 0 end)::decimal(18,2) as credited, (case when mark = 'CR' then 0 else amount end)::decimal(18,2) as debited
from orders_t""")
def run_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged statements to the transactions of the kept ones."""
    return _run(spark, sf_dir, "transactions").select("account", "key", "date", "description", "credited", "debited")


@query(f"""with {MONTHLY_SQL}
select account::varchar as account, strftime(month, '%Y-%m') as key, account || '/yes__' || strftime(month, '%Y-%m') || '-28 (1).pdf' as other_path, last_day(month) as statement_date, month as period_start,
       last_day(month) as period_end, opening, closing from monthly""")
def run_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept statement of each period with its head; equal contents are read once, and the smallest path of them stays."""
    kept = _run(spark, sf_dir, "metadata")
    # the copy's name has a blank where the kept one has a full stop, so the copy sorts first
    return kept.select("account", "key", F.col("path").alias("other_path"), "statement_date", "period_start", "period_end", "opening", "closing")


@query(f"""with {ORDERS_SQL}, c as (
  select account, strftime(day, '%Y') as y, count(distinct date_trunc('month', day)) as n, min(date_trunc('month', day))::date as a, last_day(max(day)) as b from orders_t group by 1, 2
), k as (select *, case when n = 1 then strftime(b, '%Y-%m') else 'FY' || lpad((year(b - interval 3 month) % 100)::varchar, 2, '0') || '-' || (year(b - interval 3 month) + 1) end as key from c)
select account || '-' || y as id, key, case when n = 1 then 'content' else 'annual' end as source, a as "start", b as "end" from k""")
def export_period_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export per account and year without a period in its head: the billing cycles of its transactions decide."""
    line = F.concat_ws(",", F.date_format("day", "dd/MM/yyyy"), F.col("ref") + 100000, F.col("note"), F.lit("0"), F.lit("0"), F.col("amount"))
    per = orders(spark, sf_dir).groupBy("account", F.year("day").alias("y")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("rows"))
    body = F.concat(F.lit("Card\nTransaction Details:\nDate,Sr.No.,Details,Points,Intl,Amount\n"), F.col("rows"))
    exports = per.select(F.concat_ws("-", "account", "y").alias("path"), body.alias("text"), F.lit("x.csv").alias("name"), F.lit(1).alias("anchor"))
    return run.export_keys(exports)


@query(f"""with {ORDERS_SQL}, k as (select ref, ref % 3 as kind, day, year(day - interval 3 month) as y from orders_t)
select ref, case kind when 0 then strftime(day, '%Y-%m') when 1 then 'FY' || lpad((y % 100)::varchar, 2, '0') || '-' || (y + 1) else strftime(day, '%Y') end as key,
       case kind when 2 then strftime(day, '%Y') else 'FY' || lpad((y % 100)::varchar, 2, '0') || '-' || (y + 1) end as folder from k""")
def path_key_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month's, a fiscal or a calendar year's statement put where it belongs, and its key read from the path."""
    day = F.col("day")
    key = F.when(F.col("ref") % 3 == 0, periods.month_key(day)).when(F.col("ref") % 3 == 1, periods.fiscal_key(day)).otherwise(F.date_format(day, "yyyy"))
    o = orders(spark, sf_dir).select("ref", listing.canonical_path("/data", key, F.lit("card"), F.lit("1"), ".pdf").alias("path"))
    return o.select("ref", periods.key_of_path("path").alias("key"), F.regexp_extract("path", r"^/data/([^/]+)/", 1).alias("folder"))


@query(f"""with {ORDERS_SQL} select ref, date_trunc('month', day)::date as "start", last_day(day + interval 11 month) as "end" from orders_t""")
def year_end_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.concat(F.lit("Account Summary\nfor the period from "), F.upper(F.date_format("day", "MMMM-yyyy")), F.lit(" to "), F.date_format(F.add_months("day", 11), "MMMM-yyyy"))
    found = dates.year_end_range(shown)
    return orders(spark, sf_dir).select("ref", found["start"].alias("start"), found["end"].alias("end"))


@query(f"""with {ORDERS_SQL}
select ref, format('{{:,.2f}}', amount::double) || ' CR' || '   ' || '5.00 DR' as first_line, 'x' as last_line from orders_t""")
def detached_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of amounts whose marks stand on the line below."""
    money = F.format_number("amount", 2)
    shown = F.concat(money, F.lit("   5.00\n"), F.rpad(F.lit("CR"), F.length(money) + 3, " "), F.lit("DR\nx"))
    rows = text.lines(text.merge_marks(shown))
    return orders(spark, sf_dir).select("ref", F.get(rows, F.lit(0)).alias("first_line"), F.get(rows, F.lit(1)).alias("last_line"))


@query("""select c_custkey::varchar as account_number, ['hdfc', 'yes', 'indusind'][c_custkey % 3 + 1] as bank, case when c_custkey % 3 = 0 then 0.99 else 0.21 end::decimal(18,2) as tolerance, c_custkey % 3 = 0 as fiscal,
       case c_custkey % 3 when 0 then 'own' when 1 then 'Your YES_BANK_ACE Rupay Credit Card E-Statement' else 'IndusInd Bank Credit Card' end as subject, case when c_custkey % 3 = 2 then 5 else 1 end as n_exclude
from customer""")
def accounts_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An account per customer: its own subjects win, its own markers join those of its handler."""
    kind = F.col("c_custkey") % 3
    none = F.array().cast("array<string>")
    mail = F.struct(F.when(kind == 0, F.array(F.lit("own"), F.lit(" OWN "))).alias("subjects"), none.alias("body_contains"), none.alias("from"))
    raw = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.element_at(F.array(F.lit("HDFC "), F.lit("yes"), F.lit("indusind")), (kind + 1).cast("int")).alias("bank"), F.when(kind == 1, "ace").when(kind == 2, "other").alias("variant"), F.col("c_custkey").cast("string").alias("account_number"),
        F.lit(None).cast("string").alias("type"), F.lit("01-08-2021").alias("opening_date"), F.lit(None).cast("string").alias("closing_date"), none.alias("passwords"), mail.alias("mail"),
        F.struct(none.alias("text_contains"), F.array(F.lit("mine"), F.lit("mine")).alias("text_not_contains")).alias("statement"),
    )
    found = settings.resolve(raw)
    return found.select("account_number", "bank", "tolerance", "fiscal", F.get("subjects", F.lit(0)).alias("subject"), F.size("text_not_contains").cast("long").alias("n_exclude"))


@query(f"""with {ORDERS_SQL}, d as (
  select account, 'FY' || lpad((year(day - interval 3 month) % 100)::varchar, 2, '0') || '-' || (year(day - interval 3 month) + 1) as key, max(ref) as r from orders_t group by 1, 2
), s as (select account, count(*) as on_disk, count(*) filter (r % 4 <> 0) as visible from d group by 1)
select account, on_disk::bigint as on_disk, visible::bigint as visible, on_disk = visible as agrees from s""")
def annual_csv_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year's CSV per account; of some the summary lacks the format."""
    per = orders(spark, sf_dir).groupBy("account", periods.fiscal_key(F.col("day")).alias("key")).agg(F.max("ref").alias("r"))
    shown = per.select("account", F.when(F.col("r") % 4 != 0, F.array(F.lit("pdf"), F.lit("csv"))).otherwise(F.array(F.lit("pdf"))).alias("formats"))
    return run.annual_reconciliation(per.select("account", "key"), shown)


@query(f"""with {ORDERS_SQL}, a as (
  select account, ref, day as statement_date, 'FY' || lpad((year(day - interval 3 month) % 100)::varchar, 2, '0') || '-' || (year(day - interval 3 month) + 1) as year_key from orders_t
)
select account, statement_date, year_key, lag(statement_date) over (partition by account, year_key order by statement_date) as replaces from a""")
def annual_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir).select("account", F.col("day").alias("statement_date"), F.lit(True).alias("annual"), F.col("day").alias("period_start"), F.col("day").alias("period_end"))
    return run.year_summaries(o).select("account", "statement_date", "year_key", "replaces")


@query(f"""with {ORDERS_SQL} select ref, strftime(day, '%Y-%m-%d') as last_fetch_date, note, amount::varchar as amount from orders_t""")
def json_field_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One field of a JSON document is set, the others stay."""
    schema = "ref long, note string, amount string, last_fetch_date string"
    doc = F.to_json(F.struct("ref", "note", F.col("amount").cast("string").alias("amount"), F.lit("1970-01-01").alias("last_fetch_date")))
    patched = run.with_field(doc, schema, "last_fetch_date", F.date_format("day", "yyyy-MM-dd"))
    back = orders(spark, sf_dir).select(run.typed(patched, schema).alias("d"))
    return back.select("d.ref", "d.last_fetch_date", "d.note", "d.amount")


@query(f"""with {ORDERS_SQL} select ref, ref % 4 <> 3 as same from orders_t""")
def balances_as_printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal, on the edge of the tolerance, unreadable but equal, and apart."""
    kind, money = F.col("ref") % 4, F.format_number("amount", 2)
    left = F.when(kind == 2, "n/a").otherwise(money)
    right = F.when(kind == 0, F.concat(F.lit("Rs. "), money)).when(kind == 1, F.format_number(F.col("amount") + F.lit("0.21").cast("decimal(18,2)"), 2)).when(kind == 2, "n/a").otherwise(F.format_number(F.col("amount") + 1, 2))
    return orders(spark, sf_dir).select("ref", run.same_balance(left, right).alias("same"))


@query(f"""with {ORDERS_SQL} select ref, '05 Jan 2024 A Rs. ' || amount || case when ref % 2 = 0 then ' Cr' else ' Dr' end as first_line, '  05 Jan 24 B Rs. 2.00 Dr' as last_line from orders_t""")
def amounts_by_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of transaction lines are marked by the colours of all amounts; one on another line uses up its own, one has its mark already."""
    shown = F.concat(F.lit("Total Rs. 9.00\n05 Jan 2024 A Rs. "), F.col("amount"), F.lit("\n  05 Jan 24 B Rs. 2.00 Dr"))
    green, red = F.array(F.lit(0.1), F.lit(0.6), F.lit(0.1)), F.array(F.lit(0.0), F.lit(0.9), F.lit(0.9), F.lit(0.2))
    colours = F.array(green, F.when(F.col("ref") % 2 == 0, green).otherwise(red), green)
    rows = text.lines(text.mark_amounts(shown, F.transform(colours, text.is_green)))
    return orders(spark, sf_dir).select("ref", F.get(rows, F.lit(1)).alias("first_line"), F.get(rows, F.lit(2)).alias("last_line"))


@query(f"""with {ORDERS_SQL} select ref, 'keep ' || ref || chr(10) || 'Total ' || ref as text from orders_t""")
def dropped_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a header line to the line before the total."""
    shown = F.concat(F.lit("keep "), F.col("ref"), F.lit("\nOffers\nx\ny 1\nTotal "), F.col("ref"))
    return orders(spark, sf_dir).select("ref", text.drop_block(shown, "Offers", "^Total").alias("text"))


@query(f"""with {ORDERS_SQL}, p as (select account, date_trunc('month', day)::date as s, last_day(day) as e, ref % 3 = 0 as approximate from orders_t)
select account, min(s) as "start", max(e) as "end", count(distinct s) as months, count(*) filter (approximate) as n_approximate from p group by account""")
def coverage_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is covered of each account: bounds, months, and how many periods are estimated."""
    from tallyspark.operators import coverage

    o = orders(spark, sf_dir).select("account", F.trunc("day", "MM").alias("start"), F.last_day("day").alias("end"), (F.col("ref") % 3 == 0).alias("approximate"))
    return coverage.roll_up(o).select("account", "start", "end", F.size("months").cast("long").alias("months"), "n_approximate")
