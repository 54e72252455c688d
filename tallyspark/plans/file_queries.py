"""Queries over staged files, messages and accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import periods
from tallyspark.operators import accounts, keeper, messages, selection
from tallyspark.plans.catalogue import ORDERS_SQL, orders, query, table


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as staged files; what a statement parser would find is a function of doc_id."""
    i = F.col("doc_id")
    day = F.date_add(F.lit("2023-01-05").cast("date"), (i % 97).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("account"), F.format_string("2023-%02d", i % 60 + 1).alias("period"), F.format_string("f%07d.pdf", i).alias("path"), F.sha2("text", 256).alias("sha256"),
        F.when(i % 3 == 0, "content").when(i % 3 == 1, "filename").otherwise("unknown").alias("source"), (i % 41 == 0).alias("manual"), F.contains("text", F.lit("worthless")).alias("excluded"),
        (F.col("lang") != "de").alias("has_markers"), F.contains("text", F.lit("tion")).alias("included"), F.when(i % 7 != 0, day).alias("statement_date"),
        F.when(i % 11 == 0, day).alias("period_start"), F.when(i % 2 == 0, day).alias("period_end"), F.when(i % 5 == 0, (i % 10).cast("decimal(18,2)")).alias("opening"),
        F.when(i % 4 == 0, (i % 8).cast("decimal(18,2)")).alias("closing"), F.when(i % 6 == 0, F.lit("AAN1")).alias("reference"), F.when(i % 9 != 0, day).alias("mail_date"),
    )


_FILES_SQL = """files_t as (
  select lang as account, format('2023-{:02d}', doc_id % 60 + 1) as period, format('f{:07d}.pdf', doc_id) as path, sha256(text) as sha256,
         case when doc_id % 41 = 0 then true else false end as manual, contains(text, 'worthless') as excluded, lang <> 'de' as has_markers, contains(text, 'tion') as included,
         case doc_id % 3 when 0 then 1 when 1 then 2 else 3 end as rank, date '2023-01-05' + (doc_id % 97)::int as day, doc_id as i
  from documents
), parsed as (
  select *, case when i % 7 <> 0 then day end as statement_date, case when i % 11 = 0 then day end as period_start, case when i % 2 = 0 then day end as period_end,
         case when i % 5 = 0 then (i % 10)::decimal(18,2) end as opening, case when i % 4 = 0 then (i % 8)::decimal(18,2) end as closing,
         case when i % 6 = 0 then 'AAN1' end as reference, case when i % 9 <> 0 then day end as mail_date
  from files_t
), uniq as (
  select * from parsed qualify row_number() over (partition by account, period, sha256 order by path) = 1
)
"""


@query("""select text_id as sha256, path from (select sha256(text) as text_id, format('f{:07d}.pdf', doc_id) as path from documents)
qualify row_number() over (partition by text_id order by path) = 1""")
def hash_dedupe_first_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keeper.first_of_digest(files(spark, sf_dir).select("sha256", "path"), []).select("sha256", "path")


_KEEPER_SQL = f"""with {_FILES_SQL}, usable as (
  select *, (case when statement_date is not null then 1 else 0 end + case when period_start is not null then 1 else 0 end + case when period_end is not null then 1 else 0 end
          + case when opening is not null then 1 else 0 end + case when closing is not null then 1 else 0 end) as rich,
         case when reference is not null and statement_date is not null then 'I|' || reference || '|' || statement_date
              else 'K|' || coalesce(statement_date::varchar, '-') || '|' || coalesce(period_start::varchar, '-') || '|' || coalesce(period_end::varchar, '-') || '|' || coalesce(opening::varchar, '-') || '|' || coalesce(closing::varchar, '-') end as ck
  from uniq where manual or not excluded
), a as (
  select *, included or not has_markers as listed, min(case when included or not has_markers then rank end) over (partition by account, period) as best from usable
), f as (
  select *, listed and rank = best as fin from a
), g as (
  select *, max(case when fin then rich end) over (partition by account, period) as top_rich from f
), h as (
  select *, fin and rich = top_rich as at_top from g
), k as (
  select *, max(case when at_top then mail_date end) over (partition by account, period) as last_mail from h
), s as (
  select account, period, max(case when manual then path end) as manual_path, max(path) as last_path, bool_or(has_markers) as markers,
         count(*) filter (fin) as n_fin, max(case when fin then path end) as fin_path, count(distinct case when fin then ck end) as n_keys,
         coalesce(bool_or(fin and ck = 'K|-|-|-|-|-'), false) as weak, count(*) filter (at_top) as n_top, max(case when at_top then path end) as top_path,
         count(*) filter (at_top and mail_date = last_mail) as n_latest, max(case when at_top and mail_date = last_mail then path end) as latest_path
  from k group by account, period
), d as (
  select account, period,
         case when manual_path is not null then manual_path when not markers then last_path when n_fin = 0 then null when n_fin = 1 then fin_path
              when n_keys > 1 or weak then null when n_top = 1 then top_path when n_latest = 1 then latest_path end as keeper_path,
         case when manual_path is not null or not markers then 'prepared' when n_fin = 0 then 'rejected' when n_fin = 1 then 'prepared'
              when n_keys > 1 or weak then 'ambiguous' when n_top = 1 or n_latest = 1 then 'prepared' else 'ambiguous' end as outcome
  from s
), decided as (
  select e.account, e.period, coalesce(outcome, 'rejected') as outcome, keeper_path from (select distinct account, period from files_t) e left join d using (account, period)
)
"""


@query(_KEEPER_SQL + "select account, period, outcome, keeper_path from decided")
def keeper_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keeper.keep_pdf(files(spark, sf_dir), ["account", "period"])


@query(f"""with {_FILES_SQL}
select account, period, path as keeper_path from uniq where (manual or not excluded) and (manual or included or not has_markers)
qualify row_number() over (partition by account, period order by manual desc, case when manual then -1 else rank end, mail_date desc nulls last, path desc) = 1""")
def keeper_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keeper.keep_csv(files(spark, sf_dir), ["account", "period"])


@query(_KEEPER_SQL + """select account, period, outcome as kind, string_agg(path, ',' order by path) as files
from files_t join decided using (account, period) where outcome <> 'prepared' group by all""")
def ambiguity_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return keeper.alerts(f, keeper.keep_pdf(f, ["account", "period"]), ["account", "period"])


@query("""select doc_id, case when n = 0 then name else replace(name, '.pdf', ' (' || n || ').pdf') end as unique_name
from (select doc_id, lang || '.pdf' as name, row_number() over (partition by source, lang order by doc_id) - 1 as n from documents)""")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat("lang", F.lit(".pdf")).alias("name"))
    return keeper.unique_names(named, ["source"], order="doc_id").select("doc_id", "unique_name")


@query(f"""with {ORDERS_SQL} select account, stem, ref from (select account, strftime(day, '%Y-%m') as stem, ref from orders_t where ref % 5 <> 1) t
where not exists (select 1 from orders_t c where c.ref % 5 = 1 and c.account = t.account and strftime(c.day, '%Y-%m') = t.stem)""")
def csv_wins_over_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth order is a CSV source, all others are texts."""
    o = orders(spark, sf_dir).select("account", periods.month_key(F.col("day")).alias("stem"), "ref")
    return selection.csv_wins(o.where("ref % 5 <> 1"), o.where("ref % 5 = 1"))


@query(f"""with {ORDERS_SQL}, p as (select account, strftime(day, '%Y-%m') as period, bool_or(ref % 4 = 0) as txt from orders_t where ref % 3 <> 0 group by 1, 2),
c as (select distinct account, strftime(day, '%Y-%m') as period from orders_t where ref % 3 = 0)
select coalesce(p.account, c.account) as account, coalesce(p.period, c.period) as period,
       concat_ws(',', case when p.account is not null then 'pdf' end, case when p.txt then 'txt' end, case when c.account is not null then 'csv' end) as formats
from p full join c on p.account = c.account and p.period = c.period""")
def formats_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third order is a CSV, all others are PDFs, some of them with a text."""
    o = orders(spark, sf_dir).select("account", periods.month_key(F.col("day")).alias("period"), "ref", (F.col("ref") % 4 == 0).alias("has_txt"))
    merged = selection.merge_formats(o.where("ref % 3 <> 0"), o.where("ref % 3 = 0"), ["account", "period"])
    return merged.select("account", "period", F.array_join("formats", ",").alias("formats"))


@query("""select o_orderkey as key, case o_orderkey % 3 when 1 then 'csv' else 'pdf' end as lacks from orders where o_orderkey % 3 <> 0""")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order has a PDF, a CSV or both; the lone ones are found from either side."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return selection.orphans(o.where("key % 3 <> 2"), o.where("key % 3 <> 1"), ["key"], ("pdf", "csv"))


_REGISTRY = [(1, "BUILDING", "a"), (1, "default", "b"), (2, "default", "c"), (3, "MACHINERY", "d"), (4, "FURNITURE", "e"), (4, "default", "f")]


@query(f"""with rules(bank, variant, rule) as (values {', '.join(map(str, _REGISTRY))})
select c_custkey as account, coalesce(x.rule, d.rule) as rule from customer
left join rules x on x.bank = c_nationkey and x.variant = c_mktsegment left join rules d on d.bank = c_nationkey and d.variant = 'default'""")
def registry_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(_REGISTRY, "bank int, variant string, rule string")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account"), F.col("c_nationkey").alias("bank"), F.col("c_mktsegment").alias("variant"))
    return selection.with_fallback(c, rules).select("account", "rule")


@query("""with o as (select c_custkey as k, c_name as name, [c_mktsegment, 'BASE'] as markers from customer where c_custkey % 3 = 0)
select c_custkey as account, coalesce(o.name, 'default') as name,
       case when o.k is null then 'BASE,' || c_nationkey else 'BASE,' || c_nationkey || ',' || c_mktsegment end as markers
from customer left join o on o.k = c_custkey""")
def config_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    defaults = c.select(F.col("c_custkey").alias("account"), F.lit("default").alias("name"), F.array(F.lit("BASE"), F.col("c_nationkey").cast("string")).alias("markers"))
    overrides = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("account"), F.col("c_name").alias("name"), F.array("c_mktsegment", F.lit("BASE")).alias("markers"))
    merged = accounts.overlay(defaults, overrides, "account", ["name"], ["markers"])
    return merged.select("account", "name", F.array_join("markers", ",").alias("markers"))


@query("select c_custkey % 500 as account_number, count(distinct c_nationkey) as banks from customer group by 1 having count(distinct c_nationkey) > 1")
def account_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 500).alias("account_number"), F.col("c_nationkey").alias("bank"))
    return accounts.shared_numbers(c)


@query("""select conv_id, turn, (contains(lower(text), 'annual') or contains(lower(text), 'tion of')) as matches,
       coalesce(regexp_matches(text, '(?i)annual|year end'), false) as annual from conversations""")
def message_subject_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array(F.lit("ANNUAL"), F.lit("Tion OF"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", messages.subject_matches(F.col("text"), wanted).alias("matches"), messages.is_annual(F.col("text"), F.lit(None).cast("string")).alias("annual"))


@query("""select page_id from (select page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host from pages) where host in (select regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) from pages where page_id % 10 = 0)""")
def sender_domain_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses at the hosts of every tenth page, matched as exact domains."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"))
    wanted = p.where("page_id % 10 = 0").select(F.array("host").alias("senders"), F.col("host").alias("domain")).distinct()
    address = F.concat(F.lit("mail@"), F.col("host"))
    return p.join(wanted, F.col("host") == F.col("domain")).where(messages.sender_matches(address, F.col("senders"))).select("page_id")


@query("""with a(account, subject, since, until) as (values (1, 'the', date '2023-01-10', date '2023-03-02'), (2, 'que', date '2023-02-01', date '2023-02-02'), (3, 'und', date '2023-04-30', date '2023-05-01'))
select doc_id, account from documents, a where contains(lower(text), subject)
and date_trunc('month', date '2023-01-05' + (doc_id % 97)::int) between date_trunc('month', since) and date_trunc('month', until) and (account <> 2 or source in ('src1', 'src3'))""")
def message_account_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(
        [(1, ["THE"], [], "2023-01-10", "2023-03-02"), (2, ["Que"], ["src1", "@src3"], "2023-02-01", "2023-02-02"), (3, ["und"], [], "2023-04-30", "2023-05-01")],
        "account int, subjects array<string>, senders array<string>, start string, end string",
    ).withColumns({"start": F.to_date("start"), "end": F.to_date("end")})
    mail = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("subject"), F.concat(F.lit("x@"), F.col("source")).alias("address"), F.date_add(F.lit("2023-01-05").cast("date"), (F.col("doc_id") % 97).cast("int")).alias("day"))
    return messages.for_accounts(mail, rules).select("doc_id", "account")


@query("select distinct user_id, event_type, value from events")
def incremental_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events taken in as a stream with what is there already, each kind once."""
    from tallyspark.streaming.incremental import ingest_available

    return ingest_available(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema, ["user_id", "event_type", "value"]).select("user_id", "event_type", "value")
