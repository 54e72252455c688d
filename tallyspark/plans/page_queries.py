"""Queries over the pages of statements: sections that go, glyphs that say what amounts are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.operators import glyphs
from tallyspark.plans.catalogue import ORDERS_SQL, orders, query, table

_HEADINGS = ("IMPORTANT", "Loan Summary", "STATEMENT SUMMARY", "Did You Know", "REWARDS")
_MARKERS = ["IMPORTANT", "Did You Know", "REWARDS"]


def _without_section(source: str, marker: str, name: str) -> str:
    """SQL of one heading marker: its lines up to the next that holds a marker or begins another section, and blank lines, if there is such a heading."""
    ends = [*text.BOUNDARIES, *_MARKERS]
    holds = " or ".join(f"contains(line, '{e}')" for e in ends)
    return f"""{name}_a as (
  select doc_id, bool_or(upper(trim(line)) = '{marker}') as shown, min(i) filter (contains(line, '{marker}')) as first from {source} group by doc_id
), {name}_b as (
  select s.doc_id, min(i) filter (i > first and ({holds})) as stop from {source} s join {name}_a using (doc_id) group by s.doc_id
), {name} as (
  select s.doc_id, i, line from {source} s join {name}_a a using (doc_id) join {name}_b b using (doc_id)
  where not a.shown or (trim(line) <> '' and not (i >= first and i < coalesce(stop, 1000000000)))
)"""


@query(f"""with lines as (
  select doc_id, i - 1 as i, case when (i - 1) % 7 = 3 then {list(_HEADINGS)}[((doc_id + i - 1) % 5 + 1)::int] else p[i] end as line
  from (select doc_id, p, unnest(range(1, len(p) + 1)) as i from (select doc_id, string_split(replace(text, chr(10), ' '), '. ') as p from documents where text is not null))
), {_without_section("lines", "IMPORTANT", "one")}, two as (
  select doc_id, i, replace(line, 'Did You Know', '') as line from one
), {_without_section("two", "REWARDS", "three")}
select doc_id, sha256(coalesce(string_agg(line, chr(10) order by i) filter (trim(line) <> ''), '')) as digest, count(i) filter (trim(line) <> '') as n_lines
from (select doc_id from documents where text is not null) left join three using (doc_id) group by doc_id""")
def sections_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with headings on every seventh line: two headings go with their sections, a phrase goes wherever it stands."""
    headings = F.array(*(F.lit(h) for h in _HEADINGS))
    named = lambda p: F.transform(p, lambda x, i: F.when(i % 7 == 3, F.get(headings, ((F.col("doc_id") + i) % len(_HEADINGS)).cast("int"))).otherwise(x))
    docs = table(spark, sf_dir, "documents").where("text is not null")
    kept = docs.select("doc_id", text.drop_sections(text.unlines(named(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), r"\. "))), _MARKERS).alias("kept"))
    return kept.select("doc_id", F.sha2("kept", 256).alias("digest"), F.when(F.col("kept") == "", 0).otherwise(F.size(text.lines("kept"))).cast("long").alias("n_lines"))


@query(f"""with {ORDERS_SQL}, placed as (
  select *, row_number() over (partition by account order by day, ref) as i from orders_t
)
select account, count(*) as n, count(*) filter (mark = 'CR') as n_credits,
       sha256(string_agg(strftime(day, '%d %b %Y') || ' ' || note || ' Rs. ' || amount || case when mark = 'CR' then ' Cr' else ' Dr' end, chr(10) order by i)) as digest
from placed group by account""")
def glyphs_to_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of an account's orders, whose amounts are glyphs a little off their line, credits in green: the marks that the colours say."""
    from pyspark.sql import Window

    w = Window.partitionBy("account").orderBy("day", "ref")
    placed = orders(spark, sf_dir).withColumn("i", F.row_number().over(w))
    line = F.concat_ws(" ", F.date_format("day", "dd MMM yyyy"), "note", F.lit("Rs."), F.col("amount").cast("string"))
    texts = placed.groupBy("account").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    # "Rs." is one glyph, digits are one each; tops stray by less than the reach, and some lines are printed from right to left
    shown = F.concat(F.array(F.lit("Rs."), F.lit(" ")), F.split(F.col("amount").cast("string"), ""))
    each = placed.select("account", "i", "mark", F.posexplode(F.filter(shown, lambda c: c != "")).alias("at", "text"))
    green, black = F.array(F.lit(0.1), F.lit(0.55), F.lit(0.2)), F.array(F.lit(0.0))
    chars = each.select(
        "account", "text", (F.col("at") * 5.5).alias("x0"), (12.0 * F.col("i") + 0.9 * ((F.col("at") + F.col("i")) % 3)).alias("top"),
        F.when((F.col("mark") == "CR") & (F.col("at") > 1), green).otherwise(black).alias("color"),
    )
    marked = glyphs.mark_pages(texts, chars, ["account"])
    return marked.select("account", F.size(text.lines("text")).cast("long").alias("n"), F.regexp_count("text", F.lit(" Cr(?=\n|$)")).cast("long").alias("n_credits"), F.sha2("text", 256).alias("digest"))
