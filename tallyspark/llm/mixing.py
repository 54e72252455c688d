"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a fixed 60-bit hash. Sizes are summed by source and hash bucket; running sums over the at most
``BUCKETS`` buckets of a source find the bucket in which its budget ends; only that bucket is split further, until one
hash is left. What remains is a threshold per source, and the mix is a filter: no documents are sorted. As the hash is
fixed, a smaller budget takes a subset of what a larger one takes.

Defined results: a null text has size 0; a null source is a source of its own, last in order; rows that agree in all
key columns share a hash and are taken together; a source's last document is taken when that brings it nearer to its
target; a source without words has target 0; long texts are counted whole; columns of ``docs`` named size, source_size, target, copies or taken
are replaced, others stay; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.store import Workspace

WEIGHTS = (3, 1, 2)
SHARE = 1.5  # of all sizes
CEILING = 2  # times a source's size
BITS = 10
BUCKETS = 1 << BITS
HASH_BITS = 60
SMALL = 100_000  # a table of sources up to this many rows is broadcast, a larger one is joined by a shuffle


def word_count(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in the text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unit_hash(*keys: Column) -> Column:
    """The first 60 bits of the MD5 of the keys."""
    text = F.concat_ws("\n", *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def _with(sources: DataFrame, n: int) -> DataFrame:
    return F.broadcast(sources) if n <= SMALL else sources


def rank_sources(sources: DataFrame, work: Workspace) -> DataFrame:
    """``sources`` (source) with place: 0, 1, ... by code point, null last, without sorting in one task."""
    key = F.hex(F.encode("source", "utf-8"))  # hexadecimal digits sort like bytes, UTF-8 bytes like code points
    placed = work.save(sources.withColumn("key", F.coalesce(key, F.lit("~"))).repartitionByRange("key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id()), "ranged")
    inside = placed.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("key")))
    counts = placed.groupBy("part").count()
    before = counts.withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(F.broadcast(before), "part").select("source", (F.col("n") - 1 + F.col("before")).alias("place"))


def targets(sizes: DataFrame, work: Workspace) -> DataFrame:
    """(source, source_size, target) for all sources of ``sizes`` (source, size).

    Sources that the common rate would lift above their ceiling stop there; the rate of the others is computed anew
    from what is left, until none is above. Each round is one aggregation over the table of sources.
    """
    totals = work.save(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "totals")
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    places = rank_sources(totals.select("source"), work)
    n = totals.count()
    placed = _with(places.withColumnRenamed("source", "s"), n)
    s = work.save(totals.join(placed, F.col("source").eqNullSafe(F.col("s"))).select("source", "source_size", weight.alias("weight")), "weights")
    everything = s.agg(F.sum("source_size")).first()[0] or 0
    pool, left, capped = SHARE * everything, None, None
    while True:
        # a source is at its ceiling if weight * pool / left reaches it
        over = F.lit(False) if left is None else F.col("weight") * F.lit(float(pool)) / F.lit(left) > CEILING * F.col("source_size")
        row = s.agg(F.sum(F.when(over, 1).otherwise(0)).alias("n"), F.sum(F.when(over, F.col("source_size") * CEILING)).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("left")).first()
        if left is not None and row["n"] == capped:
            break
        capped, pool, left = row["n"], SHARE * everything - (row["full"] or 0), row["left"]
        if not left:
            return s.select("source", "source_size", (CEILING * F.col("source_size")).cast("double").alias("target"))
    free = F.col("weight") * F.lit(float(pool)) / F.lit(left)
    return s.select("source", "source_size", F.least(free, (CEILING * F.col("source_size")).cast("double")).alias("target"))


def thresholds(sizes: DataFrame, goals: DataFrame, n_sources: int, work: Workspace) -> DataFrame:
    """(source, source_size, target, copies, limit): documents with a hash up to ``limit`` are taken once more than ``copies``.

    ``limit`` is -1 where no document is.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = goals.withColumn("copies", whole).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
    state = work.save(state.withColumns({"prefix": F.lit(0).cast("long"), "before": F.lit(0).cast("long"), "limit": F.lit(-1).cast("long"), "open": F.col("budget") > 0}), "level0")
    for level, shift in enumerate(range(HASH_BITS - BITS, -1, -BITS), 1):
        going = state.where("open").select(F.col("source").alias("s"), "prefix", "budget", "before")
        if going.isEmpty():
            break
        bucket = F.shiftright("hash", shift)
        inside = sizes.join(_with(going, n_sources), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("hash", shift + BITS) == F.col("prefix")))
        sums = inside.groupBy("s", bucket.alias("bucket")).agg(F.sum("size").alias("size"), F.min("hash").alias("low"), F.max("hash").alias("high"), F.first("budget").alias("budget"), F.first("before").alias("before"))
        run = Window.partitionBy("s").orderBy("bucket")  # at most BUCKETS rows
        sums = sums.withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        # a bucket is taken whole if its last document is; the first that isn't is the boundary
        fits = F.col("start") + F.col("size") <= F.col("budget")
        one = F.col("low") == F.col("high")
        taken = F.when(one, 2 * F.col("start") + F.col("size") <= 2 * F.col("budget")).otherwise(fits)
        found = sums.groupBy("s").agg(F.max(F.when(taken, F.col("high"))).alias("top"), F.min_by(F.struct("bucket", "start", one.alias("one")), F.when(~taken, F.col("bucket"))).alias("edge"))
        joined = state.join(_with(found, n_sources), F.col("source").eqNullSafe(F.col("s")), "left")
        state = work.save(
            joined.select(
                "source", "source_size", "target", "copies", "budget",
                F.coalesce("edge.bucket", "prefix").alias("prefix"),
                F.coalesce("edge.start", "before").alias("before"),
                F.greatest("limit", F.coalesce("top", F.lit(-1))).alias("limit"),
                (F.col("open") & F.col("edge").isNotNull() & ~F.coalesce("edge.one", F.lit(True))).alias("open"),
            ),
            f"level{level}",
        )
    return state.select("source", "source_size", "target", "copies", "limit")


def plan(docs: DataFrame, source: str = "source", text: str = "text", keys: tuple[str, ...] = ("doc_id", "text")) -> tuple[DataFrame, int]:
    """The thresholds of a mix of ``docs`` by source, and the number of sources."""
    work = Workspace(docs.sparkSession, "mix")
    sizes = work.save(docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"), unit_hash(*(F.col(k) for k in keys)).alias("hash")), "sizes")
    goals = work.save(targets(sizes, work), "targets")
    n = goals.count()
    found = work.save(thresholds(sizes, goals, n, work), "limits")
    work.drop("sizes", "ranged", "totals", "weights", "targets", *(f"level{i}" for i in range(HASH_BITS // BITS + 1)))
    return found, n


def mix(docs: DataFrame, source: str = "source", text: str = "text", keys: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """``docs`` with size, source_size, target, copies (times the mix takes the document) and taken (words it takes).

    Documents of which the mix takes nothing stay with 0 copies; ``where("copies > 0")`` leaves the mix.
    """
    found, n = plan(docs, source, text, keys)
    found = found.select(F.col("source").alias("__s"), "source_size", "target", F.col("copies").alias("__whole"), F.col("limit").alias("__limit"))
    plain = docs.drop("size", "source_size", "target", "copies", "taken")
    marked = plain.withColumns({"size": word_count(F.col(text)), "__hash": unit_hash(*(F.col(k) for k in keys))})
    joined = marked.join(_with(found, n), F.col(source).eqNullSafe(F.col("__s")), "left")
    copies = F.col("__whole") + F.when(F.col("__hash") <= F.col("__limit"), 1).otherwise(0)
    return joined.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop("__s", "__whole", "__hash", "__limit")
