"""The queries that apply each operator to its whole table, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import decontaminate, filter_audit, html_text, importance, langid, mixing, near_dup, ogg, passages, preference, quality, simhash, suffix_dedup, unit_dedup

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and passage_bytes: what a second index, whose suffixes count in words, finds in repeats of over 50 words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_dedup.dedup(docs)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    columns = ("doc_id", n_bytes.alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    repeats = passages.repeated(docs).select(F.col("digest").alias("__found"), size.alias("passage_bytes"))
    keyed = found.select(*columns, F.unhex(F.md5("text")).alias("__digest"))
    joined = keyed.join(repeats.hint("merge"), F.col("__digest") == F.col("__found"), "left")
    return joined.withColumn("passage_bytes", F.coalesce("passage_bytes", F.lit(0).cast("long"))).drop("__digest", "__found")


def op3_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = preference.format_pairs(preference.other_replies(table(spark, sf_dir, "conversations")))
    spans = {f"{s}_loss": F.array_join(F.transform(f"{s}_spans", lambda x: F.concat_ws("+", x["start"], x["n"])), ",") for s in ("chosen", "rejected")}
    return found.withColumns(spans).drop("chosen_spans", "rejected_spans")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op5_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.round_trip(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = unit_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=1)
    total = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["n_bytes"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws("+", x["start"], x["n_bytes"])), ",")
    return found.select(
        "doc_id",
        total("passages").alias("passage_bytes"),
        total("removed").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"),
        listed("removed").alias("removed_spans"),
        listed("passages").alias("passage_spans"),
    )


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "class_size")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = langid.learn(docs.where(langid.fold() != 2))
    rows = docs.select("doc_id", "text", F.coalesce(langid.fold() == 2, F.lit(False)).alias("held_out"))
    return langid.predict(rows, profiles).select("doc_id", "held_out", "lang_pred", "score")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("key").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = (
        op1_mix, op2_suffixes, op3_preference, op4_quality, op5_ogg, op6_decontaminate, op7_lines, op8_main_text, op9_near_dups, op10_language,
        op11_importance, op12_filter_audit, op13_simhash,
    )
    return {f.__name__: f for f in found}


_OP1 = r"""
with sized as (
  select doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '') || chr(10) || coalesce(text, '')), 1, 15))::bigint as hash
  from documents
), totals as (
  select source, sum(size)::bigint as source_size from sized group by source
), weighed as (
  select *, row_number() over by_code as place, list_value(3, 1, 2)[(row_number() over by_code - 1) % 3 + 1] as weight,
         sum(source_size) over () as everything
  from totals window by_code as (order by hex(encode(source)) nulls last)
), rising as (  -- sources reach their ceiling in this order as the common rate grows
  select *, coalesce(sum(2 * source_size) over earlier, 0) as capped_size, sum(weight) over later as free_weight
  from weighed
  window earlier as (order by 2.0 * source_size / weight, place rows between unbounded preceding and 1 preceding),
         later as (order by 2.0 * source_size / weight, place rows between current row and unbounded following)
), rate as (
  select arg_min(capped_size, free_weight * -1) as capped_size, max(free_weight) as free_weight from rising
  where 2.0 * source_size * free_weight >= weight * (1.5 * everything - capped_size)
), goals as (
  select source, source_size,
         case when r.free_weight is null then (2 * source_size)::double
              else least(weight * (1.5 * everything - capped_size)::double / r.free_weight, (2 * source_size)::double) end as target
  from weighed, rate r
), units as (
  select source, hash, sum(size)::bigint as size from sized group by source, hash
), placed as (
  select u.source, u.hash, u.size as unit,
         coalesce(sum(u.size) over (partition by u.source order by u.hash rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from units u
)
select s.doc_id, s.size::bigint as size, g.source_size, g.target,
       (s.size * (case when g.source_size = 0 then 0 else floor(g.target / g.source_size)::bigint end
        + case when g.source_size > 0 and g.target - floor(g.target / g.source_size) * g.source_size > 0
                and 2 * p.before + p.unit <= 2 * (g.target - floor(g.target / g.source_size) * g.source_size) then 1 else 0 end))::bigint as taken
from sized s
join goals g on s.source is not distinct from g.source
join placed p on p.source is not distinct from s.source and p.hash = s.hash
"""

_OP3 = """
with messages as (
  select conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text
  from conversations where conv_id is not null and turn is not null
), lasts as (
  select conv_id, turn as reply_turn, max(text) as text
  from (select *, max(turn) over (partition by conv_id) as last from messages where role = 'assistant')
  where turn = last group by conv_id, turn
), sided as (
  select conv_id, 'chosen' as side, turn, role, text from messages
  union all
  select m.conv_id, 'rejected', m.turn, m.role, case when m.turn = l.reply_turn and m.role = 'assistant' then d.text else m.text end
  from messages m join lasts l on m.conv_id = l.conv_id join lasts d on d.conv_id = xor(l.conv_id, 1)
  where m.turn <= l.reply_turn
), turns as (
  select conv_id, turn,
         list({'role': role, 'text': text} order by role, text) filter (side = 'chosen') as c,
         list({'role': role, 'text': text} order by role, text) filter (side = 'rejected') as r
  from sided group by all
), cut as (
  select conv_id, min(turn) filter (c is distinct from r) as first_other from turns group by conv_id
), rendered as (
  select s.*, floor(turn / 64)::bigint as segment, coalesce(turn < first_other, true) as shared,
         '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as line
  from sided s join cut using (conv_id)
), placed as (
  select *, coalesce(sum(length(line)) over (partition by conv_id, segment, side, shared order by turn, role, text
                                             rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from rendered
)
select conv_id as pair_id, segment,
       coalesce(string_agg(line, '' order by turn, role, text) filter (shared and side = 'chosen'), '') as prompt,
       coalesce(string_agg(line, '' order by turn, role, text) filter (not shared and side = 'chosen'), '') as chosen,
       coalesce(string_agg((start + length(role) + 13)::varchar || '+' || (length(text) + 10)::varchar, ',' order by start)
                filter (not shared and side = 'chosen' and role = 'assistant'), '') as chosen_loss,
       coalesce(string_agg(line, '' order by turn, role, text) filter (not shared and side = 'rejected'), '') as rejected,
       coalesce(string_agg((start + length(role) + 13)::varchar || '+' || (length(text) + 10)::varchar, ',' order by start)
                filter (not shared and side = 'rejected' and role = 'assistant'), '') as rejected_loss
from placed group by conv_id, segment
"""

_OP6 = r"""
with dw as (
  select doc_id, rid, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from (select *, row_number() over () as rid from documents)
), iw as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), windows as (
  select distinct item_id::varchar as item, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as phrase
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from iw where len(w) > 0)
), lengths as (select distinct n from windows),
starts as (
  select rid, n, i, array_to_string(w[i:i + n - 1], ' ') as phrase
  from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, lengths where len(w) >= n)
), found as (
  select rid, i, s.n, item from starts s join windows x on s.n = x.n and s.phrase = x.phrase
), hit as (
  select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from (select distinct rid, i, n from found)) group by rid
), listed as (
  select rid, count(item) as n_items, string_agg(item, ',' order by item) as items from (select distinct rid, item from found) group by rid
)
select doc_id, coalesce(len(w), 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join hit using (rid) left join listed using (rid)
"""

_OP11 = r"""
with recursive crc_bits as (  -- the table of the reflected polynomial 0xEDB88320, from its rule
  select i, 0 as k, i::bigint as c from range(256) t(i)
  union all
  select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from crc_bits where k < 8
), crc as (select list(c order by i) as tab from crc_bits where k = 8),
docs as (select *, row_number() over () as rid from documents),
words as (
  select 'd' as side, rid, w from (select rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from docs)
  union all
  select 'b', 0, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark
),
features as (
  select side, rid, f, count(*)::bigint as n from (
    select side, rid, unnest(w || [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) as f from words
  ) group by all
), vocabulary as (
  select f, xor(list_reduce([4294967295::bigint] || [('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::bigint for i in range(octet_length(encode(f)))],
                            lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket
  from (select distinct f from features), crc
), cells as (
  select side, rid, bucket, sum(n)::bigint as n from features join vocabulary using (f) group by all
), sums as (
  select bucket, coalesce(sum(n) filter (side = 'd'), 0)::bigint as s, coalesce(sum(n) filter (side = 'b'), 0)::bigint as t from cells group by bucket
), gains as (
  select bucket, floor(1000 * ln((t + 1)::double * (sum(s) over () + 10000)::double / ((s + 1)::double * (sum(t) over () + 10000)::double)))::bigint as gain from sums
), means as (
  select rid, sum(n)::bigint as n_features, sum(n * gain)::hugeint as total from cells join gains using (bucket) where side = 'd' group by rid
), scored as (
  select d.doc_id, d.rid, coalesce(n_features, 0)::bigint as n_features, len(w) as n_words,
         coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0)::bigint as weight,
         floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(d.doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as noise
  from docs d join (select rid, w from words where side = 'd') using (rid) left join means using (rid)
), placed as (
  select *, weight + noise as score, row_number() over (partition by n_words >= 20 order by weight + noise desc, doc_id nulls last, n_features, weight) as place,
         count(*) filter (n_words >= 20) over () as able
  from scored
)
select doc_id, n_features, weight, score, case when n_words >= 20 and place <= 25 * able // 100 then place::bigint end as rank from placed
"""

_OP12 = r"""
with first as (select coalesce(text, '') as text, min(doc_id) as first from documents group by all),
labelled as (
  select d.doc_id, coalesce(d.source, '') as part, coalesce(d.text, '') as text,
         exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 1)::bigint as good,
         exists (select 1 from labels l where l.doc_id = d.doc_id and l.toxic = 1)::bigint as toxic
  from documents d
), failing as (
  select part, good, toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * len(text),
                             regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] as fails
  from (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from labelled) join first using (text)
), counts as (
  select part, fails, count(*)::bigint as n, sum(good)::bigint as good, sum(toxic)::bigint as toxic from failing group by all
), letters as (select unnest(range(1, 6)) as i),
orders as (
  select [a.i, b.i, c.i, d.i, e.i] as o from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps as (
  select part, o, step, n, good, toxic, fails[o[step]] as own, len(list_filter(o[1:step - 1], lambda i: fails[i])) > 0 as early, len(list_filter(fails, lambda f: f)) = 1 as alone
  from counts, orders, (select unnest(range(1, 6)) as step)
), summed as (
  select part, o, step, coalesce(sum(n) filter (not early and not own), 0)::bigint as kept, coalesce(sum(n) filter (own and not early), 0)::bigint as removed,
         coalesce(sum(n) filter (own and early), 0)::bigint as redundant, coalesce(sum(n) filter (own and alone), 0)::bigint as unique_fails,
         coalesce(sum(good) filter (own and not early), 0)::bigint as good_lost, coalesce(sum(toxic) filter (own and not early), 0)::bigint as toxic_lost
  from steps group by all
)
select part, array_to_string([substr('ABCDE', i::bigint, 1) for i in o], '') as filter_order, step::integer as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) over (partition by part, o[step]))::bigint as shapley
from summed
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix": _OP1, "op3_preference": _OP3, "op6_decontaminate": _OP6, "op11_importance": _OP11, "op12_filter_audit": _OP12}
