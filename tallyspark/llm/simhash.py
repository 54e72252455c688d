"""SimHash near-dedup by a hierarchical index in Gray order.

A text's fingerprint has 64 bits, each the majority of that bit over the hashes of its shingles. Fingerprints link at ``DISTANCE`` or fewer differing
bits; groups are the connected components of all links.

The index. A fingerprint is cut into ``SEGMENTS`` = ``DISTANCE`` + 1 segments and entered once for each of them, turned so that this segment leads. Of two
fingerprints that link, one turn agrees in its first segment, has at most 1 difference in the first two, at most 2 in the first three and
so on (where the running sum of differences less the mean first stays lowest, the cycle begins). Entries are dealt out by range of turn, leading
segment and Gray rank of the rest, so that neighbours share long prefixes, and packed in blocks of up to ``BLOCK`` entries. Every
node holds the mask of the bits that all entries below share and their pattern. Nodes on the way from the top:

    turn and leading segment > entries of one task (:func:`upper`) > block > prefixes of ``DEPTHS`` bits inside the block > fingerprint

Two nodes are compared by the differences in the bits that both share; beyond what the depth allows the whole groups are pruned (:func:`_descend`). Equal prefixes
are one node, so differences are counted once for all fingerprints below. A leading segment that very many fingerprints have is
many blocks in many tasks, of which only pairs that pass the upper nodes meet. From two blocks come no more links than they have entries: a spanning forest
of the linked pairs, which has the same components.

Defined results: a null text and a text without words have fingerprint zero and link like any other; a text of fewer than ``SHINGLE`` words is one
shingle; repeated shingles count each time; texts of any length are hashed whole; rows of one fingerprint are one component, also if they repeat; a component's
id is its smallest key that isn't null; other columns stay, but for fingerprint and component_id, which are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tallyspark.llm.components import connected_components
from tallyspark.llm.store import Workspace

SHINGLE, HASH_SEED = 4, 42
DISTANCE = 4
SEGMENTS = DISTANCE + 1
EDGES = tuple(64 * i // SEGMENTS for i in range(SEGMENTS + 1))  # where segments begin, from the highest bit
DEPTHS = (4, 8)  # bits inside a segment after which nodes are compared, besides its end
BLOCK = 1024
_PAIRS = 1 << 20  # node pairs looked at together
_PIECE = 1 << 16  # shingles of a text that are hashed together
_U = np.uint64
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def fingerprint(text: bytes) -> int:
    """The SimHash of one text."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    size = min(SHINGLE, len(words))
    start = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    end = ends[size - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, len(start), _PIECE):
        n = len(start[i : i + _PIECE])
        hashes = np.fromiter((xxh64_intdigest(line[s:e], HASH_SEED) for s, e in zip(start[i : i + n], end[i : i + n], strict=True)), _U, n)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(start)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, bits): the fingerprint of every row as a signed number."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(x.as_py()) for x in b.column(1)), _U, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["key", "bits"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, bits long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of ``x`` among the Gray codes: neighbours in this order differ in one bit."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> _U(shift))
    return x


def turned(x: np.ndarray, by: np.ndarray | int) -> np.ndarray:
    """``x`` with its highest ``by`` bits moved to the end."""
    by = np.asarray(by).astype(_U) & _U(63)
    return (x << by) | (x >> ((_U(64) - by) & _U(63)))


def allowed(turn: int) -> list[tuple[int, int]]:
    """(bits, differences): how many differences the first bits of a turned fingerprint may have at each depth."""
    out, at = [], 0
    for i in range(SEGMENTS):
        k = (turn + i) % SEGMENTS
        width = EDGES[k + 1] - EDGES[k]
        out += [(at + d, i) for d in DEPTHS if d < width] if i else []
        at += width
        out.append((at, i))
    return out


def entries(distinct: DataFrame) -> DataFrame:
    """(turn, lead, rank, value): every fingerprint in ``distinct`` (bits) once for each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = np.asarray(b.column(0)).view(_U)
            for turn in range(SEGMENTS):
                value = turned(bits, EDGES[turn])
                rank = gray_rank(value) ^ _U(1 << 63)  # Spark's numbers are signed
                lead = (value >> _U(64 - (EDGES[turn + 1] - EDGES[turn]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bits), turn, np.int32)), pa.array(lead), pa.array(rank.view(np.int64)), pa.array(value.view(np.int64))], names=["turn", "lead", "rank", "value"])

    return distinct.select("bits").mapInArrow(run, "turn int, lead int, rank long, value long")


def blocks(dealt: DataFrame, size: int = BLOCK) -> DataFrame:
    """(turn, lead, task, block, n, ones, anys, body): the entries of each task, which come in order, cut where the lead changes and after ``size`` entries.

    ``ones`` and ``anys`` are the AND and the OR of all values: bits in which they agree are shared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        held = np.zeros((0, 3), np.int64)
        names = ["turn", "lead", "task", "block", "n", "ones", "anys", "body"]

        def packed(rows: np.ndarray, last: bool) -> tuple[pa.RecordBatch | None, np.ndarray]:
            nonlocal number
            change = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            firsts = np.concatenate(([0], change)) if len(rows) else change
            lengths = np.diff(np.append(firsts, len(rows)))
            cuts = np.concatenate([np.arange(f, f + n, size) for f, n in zip(firsts, lengths, strict=True)]) if len(rows) else firsts
            if not last:
                cuts, rows, rest = cuts[:-1], rows[: cuts[-1]] if len(cuts) else rows, rows[cuts[-1] :] if len(cuts) else rows
            else:
                rest = rows[:0]
            if not len(cuts):
                return None, rest
            value = np.ascontiguousarray(rows[:, 2])
            ends = np.append(cuts[1:], len(rows))
            body = [value[s:e].tobytes() for s, e in zip(cuts, ends, strict=True)]
            ids = np.arange(number, number + len(cuts), dtype=np.int64)
            number += len(cuts)
            columns = [rows[cuts, 0].astype(np.int32), rows[cuts, 1].astype(np.int32), np.full(len(cuts), task, np.int32), ids, (ends - cuts).astype(np.int32), np.bitwise_and.reduceat(value, cuts), np.bitwise_or.reduceat(value, cuts)]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(body, pa.binary())], names=names), rest

        for b in batches:
            rows = np.column_stack([np.asarray(b.column(c)).astype(np.int64) for c in ("turn", "lead", "value")])
            out, held = packed(np.concatenate((held, rows)), last=False)
            if out is not None:
                yield out
        out, _ = packed(held, last=True)
        if out is not None:
            yield out

    schema = "turn int, lead int, task int, block long, n int, ones long, anys long, body binary"
    return dealt.select("turn", "lead", "value").mapInArrow(run, schema)


class _Tree:
    """Nodes of some blocks of one turn: at each depth the runs of equal prefixes, in Gray order, with the bits that they share."""

    def __init__(self, bodies: list[np.ndarray], depths: list[tuple[int, int]]):
        self.values = np.concatenate(bodies).view(_U)
        roots = np.concatenate(([0], np.cumsum([len(b) for b in bodies])))
        starts, self.levels = roots[:-1], []
        self.shared = [self._bits(starts)]
        for bits, _ in depths:
            prefix = self.values >> _U(64 - bits)
            new = np.ones(len(prefix), bool)
            new[1:] = prefix[1:] != prefix[:-1]
            new[roots[:-1]] = True
            below = np.flatnonzero(new)
            self.levels.append(np.searchsorted(below, np.append(starts, len(prefix))))  # each node's first child
            starts = below
            self.shared.append(self._bits(starts))
        self.leaves = self.values[starts]
        self.root_of = np.searchsorted(roots, np.arange(len(self.values)), "right") - 1

    def _bits(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ones, anys = np.bitwise_and.reduceat(self.values, starts), np.bitwise_or.reduceat(self.values, starts)
        return ones, ~(ones ^ anys)


def _descend(a: _Tree, b: _Tree, depths: list[tuple[int, int]], left: np.ndarray, right: np.ndarray, level: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of leaves below the node pairs (left, right) of ``level`` whose differences stay within the depths' limits."""
    if level == len(depths):
        yield left, right
        return
    bits, most = depths[level]
    first_a, first_b = a.levels[level], b.levels[level]
    wide, high = first_a[left + 1] - first_a[left], first_b[right + 1] - first_b[right]
    ends = np.cumsum(wide * high)
    at = 0
    while at < len(left):
        # so many pairs of nodes that their children can be looked at together, one at least
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, "right")))
        sizes = (wide * high)[at:stop]
        own = np.repeat(np.arange(at, stop), sizes)
        place = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        x, y = first_a[left[own]] + place // high[own], first_b[right[own]] + place % high[own]
        if a is b:
            once = x <= y
            x, y = x[once], y[once]
        (pa_, ma), (pb, mb) = a.shared[level + 1], b.shared[level + 1]
        differ = (pa_[x] ^ pb[y]) & ma[x] & mb[y]
        near = (np.bitwise_count(differ >> _U(64 - bits)) <= most) & (np.bitwise_count(differ) <= DISTANCE)
        yield from _descend(a, b, depths, x[near], y[near], level + 1)
        at = stop


def forest(a: _Tree, b: _Tree, depths: list[tuple[int, int]], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between turned fingerprints, as many as nodes at most, that connect what the linked pairs below (left, right) connect."""
    n, shift = len(a.leaves), 0 if a is b else len(a.leaves)
    label = np.arange(n + (0 if a is b else len(b.leaves)))
    for x, y in _descend(a, b, depths, left, right):
        y = y + shift
        own = x != y
        x, y = np.concatenate((x[own], np.arange(len(label)))), np.concatenate((y[own], label))
        while True:
            low = np.minimum(label[x], label[y])
            new = label.copy()
            np.minimum.at(new, x, low)
            np.minimum.at(new, y, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
    everything = a.leaves if a is b else np.concatenate((a.leaves, b.leaves))
    linked = np.flatnonzero(label != np.arange(len(label)))
    return everything[linked], everything[label[linked]]


def _links_batch(turn: int, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    back = (64 - EDGES[turn]) % 64
    return pa.RecordBatch.from_arrays([pa.array(turned(v, back).view(np.int64)) for v in (x, y)], names=["a", "b"])


def _grouped(turns: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Row numbers of one turn each, of about ``BLOCK`` * 16 entries together."""
    for turn in np.unique(turns):
        rows = np.flatnonzero(turns == turn)
        part = np.cumsum(sizes[rows]) // (BLOCK * 16)
        for p in np.unique(part):
            yield int(turn), rows[part == p]


def links_within(table: DataFrame) -> DataFrame:
    """(a, b): links inside each block of ``table``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for turn, rows in _grouped(np.asarray(batch.column(0)), np.asarray(batch.column(1))):
                depths = allowed(turn)
                tree = _Tree([np.frombuffer(batch.column(2)[int(i)].as_py(), np.int64) for i in rows], depths)
                roots = np.arange(len(rows))
                yield _links_batch(turn, *forest(tree, tree, depths, roots, roots))

    return table.where("n > 1").select("turn", "n", "body").mapInArrow(run, "a long, b long")


def _may_link(ones: Column, anys: Column, ones2: Column, anys2: Column) -> Column:
    """Whether nodes differ in few enough of the bits that both share."""
    shared = F.bitwise_not(ones.bitwiseXOR(anys)).bitwiseAND(F.bitwise_not(ones2.bitwiseXOR(anys2)))
    return F.bit_count(ones.bitwiseXOR(ones2).bitwiseAND(shared)) <= DISTANCE


def upper(table: DataFrame) -> DataFrame:
    """The nodes above the blocks: what one task has of a leading segment."""
    return table.groupBy("turn", "lead", "task").agg(F.count(F.lit(1)).alias("blocks"), F.bit_and("ones").alias("ones"), F.bit_or("anys").alias("anys"))


def block_pairs(table: DataFrame, work: Workspace) -> DataFrame:
    """(turn, task, block, task2, block2): different blocks that may hold linked entries; first the upper nodes meet, then what is below those that may."""
    nodes = work.save(upper(table), "upper")
    second = nodes.select(F.col("turn").alias("t"), F.col("lead").alias("l"), F.col("task").alias("task2"), F.col("ones").alias("o2"), F.col("anys").alias("a2"))
    may = _may_link(F.col("ones"), F.col("anys"), F.col("o2"), F.col("a2"))
    apart = nodes.join(second, (F.col("turn") == F.col("t")) & (F.col("lead") == F.col("l")) & (F.col("task") < F.col("task2")) & may).select("turn", "lead", "task", "task2")
    met = apart.unionByName(nodes.where("blocks > 1").select("turn", "lead", "task", F.col("task").alias("task2")))
    heads = table.select("turn", "lead", "task", "block", "ones", "anys")
    other = heads.toDF("t", "l", "k", "block2", "o2", "a2")
    same = (F.col("turn") == F.col("t")) & (F.col("lead") == F.col("l"))
    pairs = met.join(heads, ["turn", "lead", "task"]).join(other, same & (F.col("task2") == F.col("k")) & may)
    return pairs.where((F.col("task") < F.col("task2")) | (F.col("block") < F.col("block2"))).select("turn", "task", "block", "task2", "block2")


def links_between(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """(a, b): links between the two blocks of each pair."""
    body = table.select(F.col("task").alias("k"), F.col("block").alias("i"), "body")
    first = pairs.join(body, (F.col("task") == F.col("k")) & (F.col("block") == F.col("i"))).select("turn", "task2", "block2", F.col("body").alias("body1"))
    rows = first.join(body, (F.col("task2") == F.col("k")) & (F.col("block2") == F.col("i"))).select("turn", "body1", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = np.zeros(1, np.int64)
        for batch in batches:
            for turn, x, y in zip(*batch.columns, strict=True):
                depths = allowed(turn.as_py())
                trees = [_Tree([np.frombuffer(v.as_py(), np.int64)], depths) for v in (x, y)]
                yield _links_batch(turn.as_py(), *forest(*trees, depths, root, root))

    return rows.mapInArrow(run, "a long, b long")


def groups(distinct: DataFrame, work: Workspace, size: int = BLOCK) -> DataFrame:
    """(node, label): the smallest fingerprint of the component, for every one of ``distinct`` (bits) that links with another."""
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = entries(distinct).repartitionByRange(n, "turn", "lead", "rank").sortWithinPartitions("turn", "lead", "rank")
    table = work.save(blocks(dealt, size), "blocks")
    pairs = work.save(block_pairs(table, work), "pairs")
    links = work.save(links_within(table).unionByName(links_between(pairs, table)).distinct(), "links")
    labels = connected_components(links, work, "round")
    work.drop("blocks", "upper", "pairs", "links")
    return labels


def _known(docs: DataFrame, key: str, text: str, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(key, bits) of every row, and (bits, component_id) of every fingerprint."""
    rows = work.save(fingerprints(docs, key, text), "fingerprints")
    distinct = work.save(rows.groupBy("bits").agg(F.min("key").alias("first")), "distinct")
    labels = groups(distinct, work)
    met = work.save(distinct.join(labels, F.col("bits") == F.col("node"), "left").select("bits", "first", F.coalesce("label", "bits").alias("label")), "labelled")
    least = met.groupBy("label").agg(F.min("first").alias("component_id"))
    return rows, work.save(met.join(least, "label").select("bits", "component_id"), "components")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) of every row of ``docs``."""
    work = Workspace(docs.sparkSession, "simhash")
    rows, known = _known(docs, key, text, work)
    found = rows.join(known.withColumnRenamed("bits", "b"), F.col("bits") == F.col("b"))
    return found.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each component the row with the smallest key. Rows of one key stay or go together, equal ones stay once; rows without a key stay."""
    stays = classes(docs, key, text).select(F.col("component_id").alias("__first")).distinct()
    named = docs.where(F.col(key).isNotNull()).join(stays, F.col(key) == F.col("__first"), "left_semi").dropDuplicates([key, text])
    return named.unionByName(docs.where(F.col(key).isNull()))
