"""Queries over rendered statement text: orders are written as statement lines, then parsed back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import amounts, dates, text
from tallyspark.operators import extract, parsing
from tallyspark.plans.catalogue import ORDERS_SQL, orders, query, table
from tallyspark.sources import sectioned

_KEYS = ["account", "month"]


def _money(amount: Column) -> Column:
    return F.format_number(amount, 2)


def render(rows: DataFrame, line: Column, head: str | None = None) -> DataFrame:
    """A statement text per account and month, its lines in order of day and ref."""
    each = rows.withColumn("month", F.date_format("day", "yyyy-MM")).groupBy(*_KEYS).agg(F.array_sort(F.collect_list(F.struct("day", "ref", line.alias("line")))).alias("l"))
    joined = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return each.select(*_KEYS, (F.concat(F.lit(head + "\n"), joined) if head else joined).alias("text"))


def _ref_line() -> Column:
    return F.concat_ws(" ", F.date_format("day", "dd/MM/yyyy"), F.concat(F.lit("T"), F.col("ref")), F.col("note"), _money(F.col("amount")), F.col("mark"))


@query(f"""with {ORDERS_SQL}
select account, strftime(day, '%Y-%m') as month, day as date, note as description, 'T' || ref as ref_no,
       (case when mark = 'CR' then amount else 0 end)::decimal(18,2) as credited,
       (case when mark = 'CR' then 0 else amount end)::decimal(18,2) as debited
from orders_t""")
def parse_lines_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    statements = render(orders(spark, sf_dir), _ref_line(), "Statement of account")
    found = parsing.transactions(statements, parsing.RULES["ref_marked"])
    return found.select("account", "month", "date", "description", "ref_no", "credited", "debited")


@query(f"""with {ORDERS_SQL}, numbered as (
  select *, row_number() over (partition by account, strftime(day, '%Y-%m') order by day, ref) as n from orders_t
)
select account, strftime(day, '%Y-%m') as month, day as date, note || ' ' || ref as description, amount::decimal(18,2) as total
from numbered where n <= 2""")
def parse_stop_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marker stands before the third line."""
    line = F.concat(F.date_format("day", "dd MMM yyyy"), F.lit(" "), F.col("note"), F.lit(" "), F.col("ref"), F.lit(" Rs. "), _money(F.col("amount")), F.lit(" "), F.initcap("mark"))
    plain = render(orders(spark, sf_dir), line)
    rows = F.split("text", "\n")
    cut = F.concat(F.slice(rows, 1, 2), F.array(F.lit("** End of Transactions **")), F.slice(rows, 3, F.greatest(F.size(rows) - 2, F.lit(0))))
    found = parsing.transactions(plain.withColumn("text", F.array_join(cut, "\n")), parsing.RULES["rupee_marked"])
    return found.select("account", "month", "date", "description", (F.col("credited") + F.col("debited")).cast("decimal(18,2)").alias("total"))


@query("""with t as (
  select l_orderkey, l_shipdate::date as date, l_linestatus as description, (round(l_quantity) % 3)::decimal(18,2) as amount, l_returnflag as mark, l_linenumber as pos, l_partkey, l_suppkey
  from lineitem
)
select l_orderkey as statement, date_trunc('month', date)::date as date, description, amount, mark, pos from t
qualify row_number() over (partition by l_orderkey, date_trunc('month', date), description, amount, mark order by pos, l_partkey, l_suppkey) = 1""")
def parse_dedupe_in_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("statement"), F.to_date(F.trunc("l_shipdate", "MM")).alias("date"), F.col("l_linestatus").alias("description"),
        (F.round("l_quantity") % 3).cast("decimal(18,2)").alias("amount"), F.col("l_returnflag").alias("mark"), F.col("l_linenumber").alias("pos"), "l_partkey", "l_suppkey",
    )
    return parsing.first_of_each(rows, ["statement"], ["date", "description", "amount", "mark"], ["pos", "l_partkey", "l_suppkey"]).drop("l_partkey", "l_suppkey")


@query(f"""with {ORDERS_SQL}
select ref, (case when mark = 'CR' then amount else 0 end)::decimal(18,2) as credited,
       (case when mark = 'CR' then 0 else amount end)::decimal(18,2) as debited from orders_t""")
def direction_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    credited, debited = amounts.split_direction(F.col("amount"), F.col("mark"))
    return orders(spark, sf_dir).select("ref", credited.alias("credited"), debited.alias("debited"))


@query(f"""with {ORDERS_SQL}
select ref, (case when ref % 6 in (1, 2, 3) then -amount else amount end)::decimal(18,2) as value from orders_t""")
def amount_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain, style = _money(F.col("amount")), F.col("ref") % 6
    shown = (
        F.when(style == 1, F.concat(F.lit("("), plain, F.lit(")"))).when(style == 2, F.concat(F.lit("-"), plain)).when(style == 3, F.concat(plain, F.lit(" Cr")))
        .when(style == 4, F.concat(F.lit("Rs. "), plain, F.lit(" Dr"))).when(style == 5, F.concat(F.lit("₹ "), plain)).otherwise(plain)
    )
    return orders(spark, sf_dir).select("ref", amounts.parse_amount(shown).alias("value"))


@query(f"""with {ORDERS_SQL}
select ref, unnest([0, 1]) as i, unnest([7, 7 + length(format('{{:,.2f}}', amount::double)) + 4]) as pos,
       unnest([amount, (ref % 1000)::decimal(18,2)]) as value from orders_t""")
def amount_tokens_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("Total: "), _money(F.col("amount")), F.lit(" of "), F.format_number((F.col("ref") % 1000).cast("decimal(18,2)"), 2))
    each = orders(spark, sf_dir).select("ref", F.posexplode(amounts.tokens(line)).alias("i", "t"))
    return each.select("ref", "i", "t.pos", F.col("t.amount").alias("value"))


@query(f"with {ORDERS_SQL} select ref, day as date from orders_t")
def date_multi_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir)
    shown = F.date_format("day", "d/M/yyyy")
    for i, (pattern, _) in enumerate(dates.FORMATS):
        shown = F.when(F.col("ref") % len(dates.FORMATS) == i, F.date_format("day", pattern)).otherwise(shown)
    return rows.select("ref", dates.parse_date(shown).alias("date"))


@query(f"""with {ORDERS_SQL}
select account, strftime(day, '%Y-%m') as month, min(day) as start, max(day) as "end" from orders_t group by 1, 2""")
def date_range_after_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label's letters are doubled, as some text layers have them."""
    per = orders(spark, sf_dir).groupBy("account", F.date_format("day", "yyyy-MM").alias("month")).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    shown = F.concat(F.lit("Card summary\nBBiilllliinngg  PPeerriioodd : "), F.date_format("a", "dd/MM/yyyy"), F.lit(" to "), F.date_format("b", "dd MMM yyyy"), F.lit("\nTotal due 01/01/1990"))
    found = dates.range_after_label(shown, "Billing Period")
    return per.select("account", "month", found["start"].alias("start"), found["end"].alias("end"))


@query("select doc_id, sha256(array_to_string(list_transform(string_split(regexp_replace(text, '[^A-Za-z0-9 \\n\\r.,/\\-:()%&@#*+=<>|_$]', ' ', 'g'), chr(10)), lambda x: rtrim(x)), chr(10))) as digest from documents")
def text_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.sanitize("text"), 256).alias("digest"))


@query("""with l as (select doc_id, string_split(text, chr(10)) as l from documents),
p as (
  select doc_id, l, [i for i in range(1, len(l) + 1) if contains(l[i], 'the') or contains(l[i], 'que')] as starts,
         [i for i in range(1, len(l) + 1) if contains(l[i], 'and') or contains(l[i], 'der')] as ends from l
), b as (select *, coalesce(starts[1], 1) as a, coalesce(ends[-1], len(l)) as z from p)
select doc_id, sha256(case when z < a then '' else array_to_string(l[a:z], chr(10)) end) as digest from b""")
def trim_by_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    trimmed = text.trim_by_markers("text", ["the", "que"], ["and", "der"])
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(trimmed, 256).alias("digest"))


@query(r"""select doc_id, sha256(array_to_string([x for x in string_split(regexp_replace(regexp_replace(text, '(?i)of\s+the', '', 'g'), '(?i)de\s+la', '', 'g'), chr(10)) if trim(x) <> ''], chr(10))) as digest
from documents""")
def drop_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.drop_phrases("text", ["of the", "de la"]), 256).alias("digest"))


@query(r"""select doc_id, (contains(text, 'tion') or contains(text, 'der')) as included,
       (contains(trim(regexp_replace(text, '\s+', ' ', 'g')), 'the of') or contains(trim(regexp_replace(text, '\s+', ' ', 'g')), 'und die')) as excluded,
       (contains(text, 'tion') or contains(text, 'der')) and not (contains(trim(regexp_replace(text, '\s+', ' ', 'g')), 'the of') or contains(trim(regexp_replace(text, '\s+', ' ', 'g')), 'und die')) as eligible
from documents""")
def marker_include_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    include, exclude = ["tion", "", "der"], ["the of", "und  die"]
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.contains_any("text", include).alias("included"), text.contains_any_squeezed("text", exclude).alias("excluded"), text.eligible("text", include, exclude).alias("eligible")
    )


@query(f"""with {ORDERS_SQL}
select ref, strftime(day, '%d/%m/%Y') as shown, amount, (amount * 2)::decimal(18,2) as due from orders_t""")
def nearest_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary row below its header: the amount that stands nearest to each header word."""
    head = "Date         Purchases             Total Due"
    rows = orders(spark, sf_dir).withColumn("line", F.concat(F.rpad(F.date_format("day", "dd/MM/yyyy"), 13, " "), F.rpad(_money(F.col("amount")), 22, " "), _money(F.col("amount") * 2)))
    found = amounts.tokens(F.col("line"), decimals=True)
    at = {c: F.lit(head.index(n)) for c, n in (("amount", "Purchases"), ("due", "Total Due"))}
    return rows.select("ref", F.date_format(dates.first_date("line"), "dd/MM/yyyy").alias("shown"), *(amounts.nearest(found, p).alias(c) for c, p in at.items()))


@query(f"""with {ORDERS_SQL}, n as (select *, row_number() over (partition by account, strftime(day, '%Y-%m') order by day, ref) as n from orders_t)
select account, strftime(day, '%Y-%m') as month, (case when mark = 'CR' then -amount else amount end)::decimal(18,2) as second from n where n = 2""")
def nth_row_after_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last amount of the second line with an amount after the anchor."""
    statements = render(orders(spark, sf_dir), _ref_line(), "Balance 1.00\nYour transactions")
    second = extract.nth_row_after("text", "Your transactions", 2)
    return statements.select("account", "month", second.alias("second")).where("second is not null")


@query(f"""with {ORDERS_SQL}
select account, day as date, 'File ' || strftime(day, '%Y-%m') as file, case when ref % 3 = 0 then '' else 'T' || ref end as ref, note as description,
       (case when mark = 'CR' then amount else 0 end)::decimal(18,2)::varchar as credited, (case when mark = 'CR' then 0 else amount end)::decimal(18,2)::varchar as debited
from orders_t""")
def transactions_sorted_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyspark.sources.sinks import csv_rows

    credited, debited = amounts.split_direction(F.col("amount"), F.col("mark"))
    rows = orders(spark, sf_dir).select(
        "account", F.date_format("day", "yyyy-MM").alias("period"), F.col("day").alias("date"), F.concat(F.lit("File "), F.date_format("day", "yyyy-MM")).alias("source_file"),
        F.when(F.col("ref") % 3 != 0, F.concat(F.lit("T"), F.col("ref"))).alias("ref_no"), F.col("note").alias("description"), credited.alias("credited"), debited.alias("debited"),
    )
    return csv_rows(rows, ["account", "period"]).drop("period").withColumn("date", F.to_date("date"))


@query(f"""with {ORDERS_SQL}
select account, strftime(day, '%Y-%m') as month, day as date, case when ref % 2 = 0 then 'T' || (ref + 100000) end as ref_no, note as description,
       (case when mark = 'CR' then amount else 0 end)::decimal(18,2) as credited, (case when mark = 'CR' then 0 else amount end)::decimal(18,2) as debited
from orders_t""")
def csv_section_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement exports as text: preamble, section, header, rows, next section."""
    signed = F.when(F.col("mark") == "CR", -F.col("amount")).otherwise(F.col("amount"))
    ref = F.when(F.col("ref") % 2 == 0, F.concat(F.lit("T"), F.col("ref") + 100000)).otherwise((F.col("ref") % 1000).cast("string"))
    line = F.concat_ws(",", F.date_format("day", "dd/MM/yyyy"), ref, F.col("note"), F.lit("0"), F.lit("0"), F.concat(F.lit('"'), _money(F.abs(signed)), F.lit('"')), F.when(F.col("mark") == "CR", signed.cast("string")).otherwise(""))
    body = render(orders(spark, sf_dir), line)
    head = "Customer,X\nTransaction Details:\nDate,Sr.No.,Transaction Details,Points,Intl,Amount,Sign\n4321XXXX1234\n"
    found = sectioned.rows(body.withColumn("text", F.concat(F.lit(head), F.col("text"), F.lit("\n\nMESSAGE Details:\n01/01/2020,9,x,0,0,1.00,"))))
    return found.select("account", "month", "date", "ref_no", "description", "credited", "debited")
