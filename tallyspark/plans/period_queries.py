"""Queries over periods: cycles, fiscal years, keys, coverage, balances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import dates, periods
from tallyspark.operators import balances, coverage, selection
from tallyspark.plans.catalogue import MONTHLY_SQL, ORDERS_SQL, monthly, orders, query, table

_CYCLE_SQL = f"""with {ORDERS_SQL}, a as (
  select *, day(min(day) over (partition by account)) as anchor from orders_t
), m as (
  select *, case when day(day) >= least(anchor, day(last_day(day))) then date_trunc('month', day)::date else (date_trunc('month', day) - interval 1 month)::date end as sm from a
), c as (
  select *, sm + (least(anchor, day(last_day(sm))) - 1)::int as start, (sm + interval 1 month)::date as nm from m
), cycles as (
  select *, case when anchor = 1 then last_day(sm) else nm + (least(anchor - 1, day(last_day(nm))) - 1)::int end as "end" from c
)
"""


def _cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir)
    anchors = o.groupBy(F.col("account").alias("a")).agg(F.dayofmonth(F.min("day")).alias("anchor"))
    joined = o.join(anchors, F.col("account") == F.col("a")).drop("a")
    return joined.withColumn("cycle", periods.billing_cycle(F.col("day"), F.col("anchor")))


@query(_CYCLE_SQL + 'select ref, start, "end" from cycles')
def billing_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cycles(spark, sf_dir).select("ref", "cycle.start", "cycle.end")


@query(_CYCLE_SQL + """select account, count(distinct start) as cycles, min(start) as start, max("end") as "end",
       case when count(distinct start) = 1 then 'monthly' else 'annual' end as granularity from cycles group by account""")
def billing_cycle_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count_distinct("cycle.start")
    return _cycles(spark, sf_dir).groupBy("account").agg(n.alias("cycles"), F.min("cycle.start").alias("start"), F.max("cycle.end").alias("end"), F.when(n == 1, "monthly").otherwise("annual").alias("granularity"))


@query(f"""with {ORDERS_SQL}, e as (select account, max(day) as "end", case when account % 2 = 0 then min(day) end as start from orders_t group by account),
b as (select account, "end", start is null as approximate, coalesce(start, (("end" - interval 1 month)::date + 1)) as low from e)
select account, least(low, "end") as start, greatest(low, "end") as "end", approximate from b""")
def approx_period_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = orders(spark, sf_dir).groupBy("account").agg(F.max("day").alias("b"), F.min("day").alias("a"))
    found = periods.bounds(F.when(F.col("account") % 2 == 0, F.col("a")), F.col("b"))
    return per.select("account", found.alias("x")).select("account", "x.start", "x.end", "x.approximate")


_FY = "'FY' || lpad((year(day - interval 3 month) % 100)::varchar, 2, '0') || '-' || (year(day - interval 3 month) + 1)"


@query(f"with {ORDERS_SQL} select {_FY} as fy, count(*) as n, sum(amount)::decimal(18,2) as total from orders_t group by 1")
def fiscal_year_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).groupBy(periods.fiscal_key(F.col("day")).alias("fy")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("decimal(18,2)").alias("total"))


@query(f"with {ORDERS_SQL} select account, {_FY} as fy, count(*) as n from orders_t group by rollup (account, 2)".replace("rollup (account, 2)", f"rollup (account, {_FY})"))
def account_year_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyspark.operators.accounts import counts

    return counts(orders(spark, sf_dir).withColumn("fy", periods.fiscal_key(F.col("day"))), "account", "fy")


@query(f"""with {ORDERS_SQL}, s as (select account, date_trunc('month', min(day)) as a, date_trunc('month', max(day)) as b from orders_t group by account),
m as (select account, unnest(generate_series(a, b, interval 1 month)) as day from s),
n as (select account, {_FY} as fy, count(*) as n from m group by 1, 2)
select account, arg_max(fy, n * 10000 - right(fy, 4)::int) as fy from n group by account""")
def fy_majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = orders(spark, sf_dir).groupBy("account").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    months = span.select("account", F.explode(periods.months_between(F.col("a"), F.col("b"))).alias("m"))
    votes = months.groupBy("account", periods.fiscal_key(F.col("m")).alias("fy")).count()
    return votes.groupBy("account").agg(F.max_by("fy", F.struct("count", -F.substring("fy", -4, 4).cast("int"))).alias("fy"))


@query(f"""with {ORDERS_SQL}, k as (select distinct unnest([strftime(day, '%Y-%m'), strftime(day, '%Y'), {_FY}]) as key from orders_t),
b as (select key, case when key like 'FY%' then make_date(right(key, 4)::int - 1, 4, 1) when length(key) = 4 then make_date(key::int, 1, 1) else (key || '-01')::date end as start from k)
select key, start, case when key like 'FY%' then make_date(right(key, 4)::int, 3, 31) when length(key) = 4 then make_date(key::int, 12, 31) else last_day(start) end as "end",
       case when key like 'FY%' then 'fiscal' when length(key) = 4 then 'calendar' else 'month' end as kind,
       case when key like 'FY%' then 'FY ' || year(start) || '-' || right(key, 2) when length(key) = 4 then key else strftime(start, '%b %Y') end as label
from b""")
def fy_key_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("day")
    keys = orders(spark, sf_dir).select(F.explode(F.array(periods.month_key(day), F.date_format(day, "yyyy"), periods.fiscal_key(day))).alias("key")).distinct()
    return keys.select("key", periods.key_bounds("key").alias("b"), periods.key_kind("key").alias("kind"), periods.key_label("key").alias("label")).select("key", "b.start", "b.end", "kind", "label")


@query(f"""with {ORDERS_SQL}, s as (select date_trunc('month', min(day)) as a, date_trunc('month', max(day)) as b from orders_t),
m as (select unnest(generate_series(a, b, interval 1 month))::date as day from s)
select {_FY} as year_key, count(*) as months, min(strftime(day, '%Y-%m')) as first_month, max(strftime(day, '%Y-%m')) as last_month from m group by 1""")
def calendar_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest month first inside each section."""
    span = orders(spark, sf_dir).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    months = span.select(F.explode(F.reverse(periods.months_between(F.col("a"), F.col("b")))).alias("m"))
    sections = months.groupBy(periods.fiscal_key(F.col("m")).alias("year_key")).agg(F.sort_array(F.collect_list(periods.month_key(F.col("m"))), asc=False).alias("months"))
    return sections.select("year_key", F.size("months").cast("long").alias("months"), F.element_at("months", -1).alias("first_month"), F.element_at("months", 1).alias("last_month"))


@query(f"""with {ORDERS_SQL}
select account, strftime(date_trunc('month', day) - interval 1 month, '%Y-%m') as month from orders_t where ref % 2 = 0
union
select account, strftime(m, '%Y-%m') from (select account, unnest(generate_series(date_trunc('month', min(day)), date_trunc('month', max(day)), interval 1 month)) as m from orders_t where ref % 2 = 1 group by account)""")
def covered_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months behind monthly keys, which even orders are, united with the months of annual periods, made of odd ones."""
    o = orders(spark, sf_dir)
    by_month = o.where("ref % 2 = 0").select("account", periods.covered_month(periods.month_key(F.col("day"))).alias("month"))
    annual = o.where("ref % 2 = 1").groupBy("account").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    by_year = annual.select("account", F.explode(periods.months_between(F.col("a"), F.col("b"))).alias("m")).select("account", periods.month_key(F.col("m")).alias("month"))
    return by_month.union(by_year).distinct()


@query(f"with {ORDERS_SQL} select ref, case when ref % 4 = 3 then null else day end as date from orders_t")
def account_date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("ref") % 4
    shown = F.when(kind == 0, F.date_format("day", "dd-MM-yyyy")).when(kind == 1, F.date_format("day", "yyyy-MM-dd")).when(kind == 2, F.concat(F.lit(" "), F.date_format("day", "dd-MM-yyyy"))).otherwise(F.date_format("day", "MMM yyyy"))
    return orders(spark, sf_dir).select("ref", dates.account_date(shown).alias("date"))


@query(f"""with {ORDERS_SQL}
select ref, day from orders_t where date_trunc('month', day) between date '1996-03-01' and date '1998-07-01' and ref % 10 <> 0""")
def month_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds inside a month admit all of it; a null day is never inside."""
    day = F.when(F.col("ref") % 10 != 0, F.col("day"))
    return orders(spark, sf_dir).where(dates.between_months(day, F.lit("1996-03-17").cast("date"), F.lit("1998-07-02").cast("date"))).select("ref", "day")


@query(f"""with {MONTHLY_SQL}, a as (
  select account, month as m from monthly where month < date '1997-01-01' and account % 3 = 0
), nxt as (
  select *, lead(month) over w as next_month, lead(opening) over w as next_opening from monthly window w as (partition by account order by month)
), broken as (
  select account, unnest([month, next_month]) as m, 'discontinuity' as status from nxt
  where next_month = month + interval 1 month and abs(closing - next_opening) > 0.21
), missing as (
  select account, unnest(generate_series(month + interval 1 month, next_month - interval 1 month, interval 1 month))::date as m,
         case when abs(closing - next_opening) <= 0.21 then 'matched' else 'mismatched' end as status
  from nxt where next_month > month + interval 1 month
)
select account, strftime(m, '%Y-%m') as month, status from broken
union all
select account, strftime(m, '%Y-%m'), status from missing x where not exists (
  select 1 from (select account, unnest(generate_series(min(m), max(m), interval 1 month))::date as m from a group by account) y where x.account = y.account and x.m = y.m)""")
def balance_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: orders as statements, their balance chain, its gaps; annual statements cover some."""
    m = monthly(spark, sf_dir)
    annual = m.where("month < date '1997-01-01' and account % 3 = 0").groupBy("account").agg(F.min("month").alias("a"), F.max("month").alias("b"))
    covered = annual.select("account", F.explode(periods.months_between(F.col("a"), F.col("b"))).alias("month"))
    return balances.balance_gaps(m, covered)


_PERIODS = """, p as (select account, start, "end" + 20 as "end", n = 1 as approximate from monthly)"""
_ISLANDS = (
    MONTHLY_SQL
    + _PERIODS
    + """, b as (
  select *, max("end") over (partition by account order by start, "end" rows between unbounded preceding and 1 preceding) as before from p
), i as (
  select *, sum(case when before is null or start > before + 1 then 1 else 0 end) over (partition by account order by start, "end" rows unbounded preceding) as island from b
), islands as (
  select account, min(start) as start, max("end") as "end", bool_or(approximate) as approximate, count(*) as periods from i group by account, island
)
"""
)


def _periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly(spark, sf_dir).select("account", "start", F.date_add("end", 20).alias("end"), (F.col("n") == 1).alias("approximate"), "opening", "closing")


@query(f'with {_ISLANDS} select account, start, "end", approximate, periods from islands')
def coverage_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.segments(_periods(spark, sf_dir))


@query(f"""with {_ISLANDS}, g as (
  select account, "end" + 1 as start, lead(start) over (partition by account order by start) - 1 as "end" from islands
), gaps as (select * from g where "end" is not null),
q as (select m.account, m.start, m."end" + 20 as "end", opening, closing from monthly m)
select g.account, g.start, g."end", b.closing as before, a.opening as after, abs(b.closing - a.opening) <= 0.21 as balances_match
from gaps g
left join (select account, "end", arg_min(closing, start) as closing from q group by 1, 2) b on b.account = g.account and b."end" = g.start - 1
asof left join q a on a.account = g.account and a.start > g."end" """.replace("asof left join q a on a.account = g.account and a.start > g.\"end\"", "asof left join q a on a.account = g.account and g.\"end\" < a.start"))
def coverage_gaps_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _periods(spark, sf_dir)
    return coverage.gap_balances(coverage.gaps(coverage.segments(p)), p)


@query(f"""with {MONTHLY_SQL}, a as (select account, min(start) as s, max("end") as e from monthly where year(month) = 1997 and account % 2 = 0 group by account)
select account, start, case when n > 1 then "end" end as "end" from monthly m
where not exists (select 1 from a where a.account = m.account and m.start >= a.s and (case when m.n > 1 then m."end" end) <= a.e)""")
def monthly_within_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = monthly(spark, sf_dir)
    annual = m.where("year(month) = 1997 and account % 2 = 0").groupBy("account").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return selection.outside_annual(m.select("account", "start", F.when(F.col("n") > 1, F.col("end")).alias("end")), annual)


@query("""select user_id, (max(ts)::date - 1) as since, max(ts)::date as last_fetch, count(*) as n from events group by user_id""")
def last_fetch_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High-water mark per user, and where the next fetch starts: a day earlier."""
    from tallyspark.streaming.incremental import high_water_marks

    return high_water_marks(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), "user_id", "day").select("user_id", "since", "last_fetch", "n")


@query(f"""with {MONTHLY_SQL}
select account, strftime(min(month), '%Y-%m') as first_period, strftime(max(month), '%Y-%m') as last_period, count(*) as statements,
       strftime(min(start), '%d-%m-%Y') as period_start from monthly group by account""")
def metadata_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account metadata through JSON and back: nested statements survive as they were."""
    m = monthly(spark, sf_dir)
    row = F.struct(periods.month_key(F.col("month")).alias("statement_date"), F.col("opening").alias("opening_balance"), F.col("closing").alias("closing_balance"), F.date_format("start", "dd-MM-yyyy").alias("period_start"))
    docs = m.groupBy("account").agg(F.to_json(F.struct(F.array_sort(F.collect_list(row)).alias("statements"))).alias("json"))
    schema = "statements array<struct<statement_date:string,opening_balance:decimal(18,2),closing_balance:decimal(18,2),period_start:string>>"
    back = docs.select("account", F.from_json("json", schema, {"mode": "FAILFAST"})["statements"].alias("s"))
    first = F.element_at("s", 1)
    return back.select("account", first["statement_date"].alias("first_period"), F.element_at("s", -1)["statement_date"].alias("last_period"), F.size("s").cast("long").alias("statements"), first["period_start"].alias("period_start"))
