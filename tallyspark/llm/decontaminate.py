r"""Benchmark decontamination by winnowing, in DataFrame operations only.

Texts become words (``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z). Every window of ``WINDOW`` words holds
``WINDOW - GRAM + 1`` word k-grams; the smallest of their hashes is the window's fingerprint, so equal windows have
equal fingerprints and no shared span of ``WINDOW`` words is missed. Neighbouring windows mostly share their
fingerprint, hence a document sends few rows for many windows. Those that meet an item's fingerprint are extended: each
window that they stand for is compared, word by word, with the items' windows.

Items shorter than a window are one window of their own length; documents are searched for them by the hash of each
such length, which costs nothing where no item is short.

Defined results: a null text has no words; an item without words matches nothing; a null item_id is left out of the
list of items but its windows still hit; equal texts share one result; long texts are searched whole; columns of ``docs`` named n_words, n_hit, items or
contaminated are replaced by :func:`report`, others stay; empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.store import Workspace

WINDOW = 10
GRAM = 5
STEP = WINDOW - GRAM + 1  # grams in a window
SMALL = 200_000  # rows up to which a table is broadcast, if it has no more than ``BROADCAST`` bytes
BROADCAST = 32 << 20
_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _loose(text: Column) -> Column:
    return F.lower(F.replace(text, F.lit("\u03a3"), F.lit("\u03c3")))


def words(text: Column, exact: bool = True) -> Column:
    """The words of a text. Without ``exact`` all letters are lowered, which joins some words that differ but is quicker.

    No letter's lower case changes between word and separator, so positions and counts are the same either way. The capital sigma is
    the one letter whose lower case depends on what follows; it is replaced first, so a word has one form wherever it stands.
    """
    low = F.translate(text, _UPPER, _LOWER) if exact else _loose(text)
    return F.coalesce(F.array_remove(F.split(low, _OTHER), ""), F.array().cast("array<string>"))


def _bounded(df: DataFrame, width: Column | int) -> DataFrame:
    """``df`` for the small side of a join: broadcast if its rows, of ``width`` bytes each, are counted to be few, else left to a shuffle."""
    size = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.lit(width) if isinstance(width, int) else width).alias("bytes")).first()
    return F.broadcast(df) if size["n"] <= SMALL and (size["bytes"] or 0) <= BROADCAST else df


def _windows(rows: DataFrame) -> DataFrame:
    """One row per word of ``rows`` (key, w): (key, n_words, pos from 0, fp, sent).

    fp is the fingerprint of the window that begins at pos, null where none does. sent is fp where a run of windows with
    one fingerprint begins and at every STEP-th position, so that each window is one of the STEP from some sent one on.
    Hashes of words and grams are arrays; the minimum runs in generated code over the exploded rows, which is kept short
    enough for the JVM to compile.
    """
    hashed = rows.select("key", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    # near the end a gram takes fewer words; no window reaches it. The outer explode keeps Spark from adding a filter on the
    # array's size, which would compute it twice
    gram = F.transform("h", lambda x, i: F.xxhash64(x, *(F.get("h", i + k) for k in range(1, GRAM))))
    each = hashed.select("key", gram.alias("g")).select("key", "g", F.posexplode_outer("g").alias("pos", "own"))
    around = [F.get("g", F.col("pos") + k) for k in range(-1, STEP)]
    fp = F.when(F.col("pos") + WINDOW <= F.size("g"), F.least(*around[1:]))
    each = each.select("key", F.size("g").alias("n_words"), "pos", fp.alias("fp"), F.least(*around[:-1]).alias("last"))
    return each.select("key", "n_words", "pos", "fp", F.when((F.col("fp") != F.col("last")) | (F.col("pos") % STEP == 0), F.col("fp")).alias("sent"))


def _phrase(w: Column, at: Column, n: Column | int) -> Column:
    return F.array_join(F.slice(w, at, n), " ")


def item_windows(bench: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, n, phrase) of every window of every item."""
    w = bench.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).withColumn("len", F.size("w")).where("len > 0")
    size = F.least("len", F.lit(WINDOW))
    starts = F.sequence(F.lit(1), F.greatest(F.col("len") - WINDOW + 1, F.lit(1)))
    each = w.select("item", "w", size.alias("n"), F.explode(starts).alias("i"))
    return each.select("item", "n", _phrase(F.col("w"), F.col("i"), F.col("n")).alias("phrase")).distinct()


def hits(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key, n_words) of each different text with words, and (key, start, n, item): the words start .. start + n - 1 (from 1)
    of the text with this key are a window of the item. key is the MD5 of the text."""
    work = Workspace(docs.sparkSession, "decontaminate")
    items = work.save(item_windows(bench, item, item_text), "items")
    keyed = docs.where(F.col(text).isNotNull()).select(F.unhex(F.md5(F.col(text))).alias("key"), F.col(text).alias("t"))
    loose = keyed.select("key", words(F.col("t"), exact=False).alias("w"))

    phrases = items.where(F.col("n") == WINDOW).select(F.lit(b"").alias("key"), F.split(_loose(F.col("phrase")), " ").alias("w"))
    prints = _windows(phrases).where("fp is not null").select(F.col("fp").alias("wanted")).distinct()
    prints = work.save(prints, "prints")
    small = prints.limit(SMALL + 1).count() <= SMALL
    # a filter before the join would have every fingerprint computed twice; where rows are shuffled it is worth that
    sent = _windows(loose) if small else _windows(loose).where("pos = 0 or sent is not null")
    met = sent.join(F.broadcast(prints) if small else prints, F.col("sent") == F.col("wanted"), "left").where("pos = 0 or wanted is not null")
    span = F.when(F.col("wanted").isNotNull(), F.struct((F.col("pos") + 1).alias("start"), F.lit(STEP).alias("run"), F.lit(WINDOW).alias("n")))
    found = met.select("key", "n_words", span.alias("r"))

    lengths = [r["n"] for r in items.where(F.col("n") < WINDOW).select("n").distinct().collect()]  # 9 values at most
    for n in sorted(lengths):
        short = _bounded(items.where(F.col("n") == n).select(F.xxhash64(*(F.xxhash64(F.get(F.split(_loose(F.col("phrase")), " "), i)) for i in range(n))).alias("wanted")).distinct(), 40)
        each = loose.select("key", F.transform("w", lambda x: F.xxhash64(x)).alias("h")).select("key", "h", F.posexplode_outer("h").alias("pos", "own"))
        gram = F.xxhash64(*(F.get("h", F.col("pos") + i) for i in range(n)))
        grams = each.where(F.col("pos") + n <= F.size("h")).select("key", "pos", gram.alias("fp"))
        starts = F.struct((F.col("pos") + 1).alias("start"), F.lit(1).alias("run"), F.lit(n).alias("n"))
        found = found.unionByName(grams.join(short, F.col("fp") == F.col("wanted"), "left_semi").select("key", F.lit(None).cast("int").alias("n_words"), starts.alias("r")))

    texts = work.save(found.groupBy("key").agg(F.max("n_words").alias("n_words"), F.collect_set("r").alias("runs")), "texts")
    near = keyed.join(_bounded(texts.where(F.size("runs") > 0).select("key", "runs"), 80 + 40 * F.size("runs")), "key")
    # the grouping also keeps the words from being computed again for every window
    near = near.select("key", "runs", words(F.col("t")).alias("w")).dropDuplicates(["key"])
    inside = F.transform(
        "runs",
        lambda r: F.transform(
            F.sequence(r["start"], F.least(r["start"] + r["run"] - 1, F.size("w") - r["n"] + 1)),
            lambda i: F.struct(i.alias("start"), r["n"].alias("n"), _phrase(F.col("w"), i, r["n"]).alias("phrase")),
        ),
    )
    each = near.select("key", F.explode(F.flatten(inside)).alias("x")).select("key", "x.start", "x.n", "x.phrase")
    out = work.save(each.join(_bounded(items, 100 + F.octet_length("phrase") + F.coalesce(F.octet_length("item"), F.lit(0))), ["n", "phrase"]).select("key", "start", "n", "item").distinct(), "hits")
    work.drop("items", "prints")
    return texts.select("key", "n_words"), out


def covered(spans: Column) -> Column:
    """Number of words in the union of an array of (start, n)."""
    step = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["total"] + F.greatest(F.lit(0), s["start"] + s["n"] - F.greatest(s["start"], acc["end"]))).alias("total"),
            F.greatest(acc["end"], s["start"] + s["n"]).alias("end"),
        ),
    )
    return step["total"]


def report(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit (words inside any window's occurrence), items (ids, sorted) and contaminated."""
    counts, found = hits(docs, bench, text, item, item_text)
    marks = found.groupBy("key").agg(covered(F.collect_set(F.struct("start", "n"))).cast("long").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    results = counts.join(marks, "key", "left").withColumnRenamed("key", "__key")
    plain = docs.drop("n_words", "n_hit", "items", "contaminated").withColumn("__md5", F.unhex(F.md5(F.col(text))))
    joined = plain.join(results, F.col("__md5") == F.col("__key"), "left").drop("__md5", "__key")
    zero = F.lit(0).cast("long")
    filled = {"n_words": F.coalesce(F.col("n_words").cast("long"), zero), "n_hit": F.coalesce("n_hit", zero), "items": F.coalesce("items", F.array().cast("array<string>"))}
    return joined.withColumns(filled).withColumn("contaminated", F.col("n_hit") > 0)


def clean(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no window of any item, with the columns of ``docs``."""
    dirty = hits(docs, bench, text, item, item_text)[1].select(F.col("key").alias("__key")).distinct()
    return docs.withColumn("__md5", F.unhex(F.md5(F.col(text)))).join(_bounded(dirty, 64), F.col("__md5") == F.col("__key"), "left_anti").drop("__md5")
