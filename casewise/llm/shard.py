"""Shards of equal size by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewise.llm.common import Scratch, digest, table

ROW_BYTES = 16
#: Rows of one task when rows are numbered.
ROWS_PER_TASK = 20_000
#: Sizes are told apart to one part in 2**10, so there are at most 64 * 2**10 size classes.
SIZE_BITS = 10


class _Bins:
    """Bins by remaining capacity in a balanced search tree (a treap); finds the tightest that fits."""

    def __init__(self, capacities: list[int]):
        self._random = random.Random(7)
        self._root = None
        for at, capacity in enumerate(capacities):
            self.put(capacity, at)

    def put(self, remaining: int, at: int) -> None:
        key = (remaining, at)
        low, high = self._cut(self._root, key)
        self._root = self._join(self._join(low, [key, self._random.random(), None, None]), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least remaining capacity of at least ``size``."""
        low, high = self._cut(self._root, (size, -1))
        node = high
        while node and node[2]:
            node = node[2]
        if node:
            rest = self._cut(high, (node[0][0], node[0][1] + 1))[1]
            self._root = self._join(low, rest)
            return node[0]
        self._root = low
        return None

    def _cut(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._cut(node[3], key)
            node[3] = low
            return node, high
        low, high = self._cut(node[2], key)
        node[2] = high
        return low, node

    def _join(self, low, high):
        if not low or not high:
            return low or high
        if low[1] > high[1]:
            low[3] = self._join(low[3], high)
            return low
        high[2] = self._join(low, high[2])
        return high


def best_fit(classes: list[tuple[int, int]], bins: int, capacity: int) -> list[tuple[int, int, int, int]] | None:
    """Place ``classes`` (size, number of groups) into bins; (size, first, past last, bin), or None if they don't fit.

    Sizes go in falling order, each group into the tightest bin that takes it. Groups of one size are
    alike: once one has entered a bin that bin stays the tightest, so as many follow as it takes.
    """
    tree, placed = _Bins([capacity] * bins), []
    for size, count in sorted(classes, reverse=True):
        at = 0
        while at < count:
            found = tree.take(size)
            if found is None:
                return None
            remaining, to = found
            n = min(count - at, remaining // size)
            placed.append((size, at, at + n, to))
            tree.put(remaining - n * size, to)
            at += n
    return placed


def pack(classes: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int, int]]:
    """:func:`best_fit` at the smallest capacity, to one part in 4096, that needs no more than ``bins``."""
    if not classes:
        return []
    total = sum(size * count for size, count in classes)
    low = max(-(-total // bins), max(size for size, _ in classes))
    step = max(1, low >> 12)
    best, reach = best_fit(classes, bins, low), 1
    if best is not None:
        return best
    while best is None:
        best = best_fit(classes, bins, low + reach * step)
        reach *= 2
    fails, fits = reach // 4, reach // 2
    while fits - fails > 1:
        middle = (fits + fails) // 2
        tried = best_fit(classes, bins, low + middle * step)
        if tried is None:
            fails = middle
        else:
            best, fits = tried, middle
    return best


def assign_shards(docs: DataFrame, shards: int, id_column: str = "doc_id") -> DataFrame:
    """(id, size, text_crc32, shard, slot) for every row of ``docs``; shards have nearly equal bytes.

    A row's size is its text's UTF-8 bytes (null: none) plus 16. Rows with equal texts are a group and
    go to one shard; only a group that no shard can hold, larger than a shard's share of all bytes, is cut, by a key of
    its rows, into pieces of about a quarter of a share. Groups enter the bins in falling order of size, each the bin with the
    least room that takes it, and the capacity is the least at which they all fit.

    The driver packs a histogram of group sizes, kept to one part in 1024 and so at most 65,536
    classes whatever the number of groups. Ranks inside a class and slots inside a shard are numbered by
    hash parts, so no class and no shard is sorted in one task. Slots run without gaps from 0 in a
    shard. Null texts are one group, null ids are allowed, repeated rows each get a slot, an empty table gives no
    rows, and only ``id_column`` and ``text`` are read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.col("text").cast("binary")
    rows = docs.select(
        F.col(id_column).alias("id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0).cast("long")).alias("text_crc32"),
        F.coalesce(digest(F.col("text")), F.lit(b"")).alias("content"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = scratch.save(rows, "rows")
    total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    if not total["n"]:
        return rows.select(
            F.col("id").alias(id_column), "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")
        )
    share = max(1, total["bytes"] // shards)
    groups = rows.groupBy("content").agg(F.sum("size").alias("bytes"), F.max("size").alias("most"))
    # Groups above a share: fewer than there are shards, whatever the input.
    large = groups.where((F.col("bytes") > share) & (F.col("bytes") > F.col("most")))
    large = F.broadcast(large.select("content", F.ceil(F.col("bytes") * 4 / share).alias("pieces")))
    piece = F.coalesce(F.pmod(F.xxhash64("row"), "pieces"), F.lit(0).cast("long"))  # ids may repeat or be null
    rows = rows.join(large, "content", "left").withColumn("piece", piece).drop("pieces")
    units = rows.groupBy("content", "piece").agg(F.sum("size").alias("bytes"))
    step = F.expr(f"bigint(power(2, greatest(0, floor(log2(bytes)) - {SIZE_BITS})))")
    units = scratch.save(units.withColumn("class", (F.ceil(F.col("bytes") / step) * step).cast("long")), "units")
    classes = [(row["class"], row["n"]) for row in units.groupBy("class").agg(F.count("*").alias("n")).collect()]
    plan = spark.createDataFrame(pack(classes, shards), "class long, first long, past long, shard int")

    sizes = F.broadcast(spark.createDataFrame(classes, "class long, n long"))  # at most 65,536 rows
    salt = F.pmod(F.xxhash64("content", "piece"), F.ceil(F.col("n") / ROWS_PER_TASK))
    units = units.join(sizes, "class").withColumn("salt", salt)
    ranked = _number(units, ["class"], ["content", "piece"], "rank")
    fits = (ranked["class"] == plan["class"]) & ranked["rank"].between(plan["first"], plan["past"] - 1)
    placed = ranked.join(F.broadcast(plan), fits).select("content", "piece", "shard")
    placed = scratch.save(placed, "placed")

    parts = max(1, math.ceil(total["n"] / shards / ROWS_PER_TASK))
    out = rows.join(placed, ["content", "piece"])
    out = out.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(parts)))
    out = _number(out, ["shard"], ["id", "content", "row"], "slot")
    return out.select(F.col("id").alias(id_column), "size", "text_crc32", "shard", "slot")


def _number(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Number the rows of each key from 0 by (``salt``, ``order``), one task for each salt."""
    counts = df.groupBy(*keys, "salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*keys, "salt").orderBy(*order)) - 1
    return df.withColumn(name, place).join(counts, [*keys, "salt"]).withColumn(name, F.col(name) + F.col("_before")).drop("_before")


SHARDS = 40


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shard and a slot for every document; the law is equal bytes."""
    out = assign_shards(table(spark, sf_dir, "documents"), SHARDS)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
