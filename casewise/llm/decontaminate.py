"""Benchmark decontamination by a prefix-filtered set join of word windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewise.llm.common import Scratch, Words, bitmap_of, digest, in_bitmap, list_array, table, text_slices

WINDOW_WORDS = 10
SHINGLE_WORDS = 5


def _item_windows(window: int, shingle: int):
    """(item, window key, its words, shingle length, shingle hashes in order) for every window of the items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column("item")
            for at, to, data, bounds in text_slices(batch.column("text")):
                words = Words(data, bounds)
                counts = np.diff(words.first)
                hashes = {k: words.shingles(k)[0] for k in range(1, shingle + 1)}
                of, sizes, kinds, lists = [], [], [], []
                for i in np.flatnonzero(counts):
                    n, first = int(counts[i]), int(words.first[i])
                    size, kind = min(n, window), min(n, shingle)
                    for start in range(first, first + n - size + 1):
                        of.append(at + i)
                        sizes.append(size)
                        kinds.append(kind)
                        lists.append(hashes[kind][start : start + size - kind + 1].view(np.int64))
                if of:
                    flat = np.concatenate(lists)
                    shingles = list_array(flat, np.array([len(x) for x in lists]), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [items.take(pa.array(of)), pa.array(sizes, pa.int32()), pa.array(kinds, pa.int32()), shingles],
                        ["item", "size", "kind", "shingles"],
                    )

    return cut


def _found_shingles(bits, kinds: list[int], reach: int):
    """Per document its word count and, for each run of words whose bit is set, place, hash and the neighbours' hashes.

    A neighbour whose bit is not set counts as 0: no window holds it.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.arange(-reach, reach + 1)
        for batch in batches:
            for at, to, data, bounds in text_slices(batch.column("text")):
                words = Words(data, bounds)
                n = len(words.hash)
                doc = np.repeat(np.arange(to - at), np.diff(words.first))
                places, owners, found, around, which = [], [], [], [], []
                for kind in kinds:
                    hashes, whole = words.shingles(kind)
                    hit = whole & in_bitmap(bits.value, hashes)
                    where = np.flatnonzero(hit)
                    known = np.where(hit, hashes, np.uint64(0)).view(np.int64)
                    side = where[:, None] + near
                    inside = (side >= 0) & (side < n)
                    side = np.clip(side, 0, max(n - 1, 0))
                    if n:
                        inside &= doc[side] == doc[where][:, None]
                    places.append(where)
                    owners.append(doc[where])
                    found.append(hashes[where].view(np.int64))
                    around.append(np.where(inside, known[side], 0))
                    which.append(np.full(len(where), kind, np.int32))
                owner = np.concatenate(owners)
                order = np.argsort(owner, kind="stable")
                counts = np.bincount(owner, minlength=to - at)
                place = np.concatenate(places)[order] - words.first[owner[order]]
                context = np.concatenate(around)[order]
                inner = list_array(context.ravel(), np.full(len(order), 2 * reach + 1), pa.int64())
                fields = [
                    pa.array(place, pa.int64()),
                    pa.array(np.concatenate(which)[order], pa.int32()),
                    pa.array(np.concatenate(found)[order], pa.int64()),
                    inner,
                ]
                struct = pa.StructArray.from_arrays(fields, ["place", "kind", "hash", "near"])
                ends = np.zeros(to - at + 1, np.int32)
                np.cumsum(counts, out=ends[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(at, to - at),
                        batch.column("content").slice(at, to - at),
                        pa.array(np.diff(words.first), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), struct),
                    ],
                    ["id", "content", "n_words", "found"],
                )

    return find


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    item_column: str = "item_id",
    window: int = WINDOW_WORDS,
    shingle: int = SHINGLE_WORDS,
) -> DataFrame:
    """Per row of ``docs``: (id, content, n_words, n_hit, n_items, items sorted as strings, contaminated).

    Words are runs of ASCII letters and digits and of characters above 7F, with A-Z lowered. An item
    is cut into windows of ``window`` words (one window if it is shorter; none without words). A window
    is a set of shingles of ``shingle`` words; containment must be whole, so its necessary prefix is one shingle,
    the one rarest in the documents. That one is joined with the documents' shingles; the document
    then must have the window's length around the match (length and positional bounds), and every
    other shingle of the window must stand at its own place (verification). ``n_hit`` counts the words
    under any such window.

    The documents' shingles first pass a bitmap of the benchmark's shingles, of 8 MB whatever the
    benchmark's size, so that only shared shingles are written and joined. Equal texts are matched once.
    A null or empty text has no words and no hits; a null item id is left out of the items but its
    windows count; repeated rows each get their result; no rows of ``docs`` give none, and no items no hits.
    Of ``docs`` only ``id_column`` and ``text`` are read, so other columns may have any name.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    kind = dict(items.dtypes)[item_column]
    cut = items.select(F.col(item_column).alias("item"), "text").mapInArrow(
        _item_windows(window, shingle), f"item {kind}, size int, kind int, shingles array<long>"
    )
    cut = scratch.save(cut.withColumn("window", F.xxhash64("size", "shingles")), "windows")
    windows = cut.dropDuplicates(["window"]).select("window", "size", "kind", "shingles")
    spread = windows.select("window", "size", "kind", "shingles", F.posexplode("shingles").alias("offset", "hash"))
    kinds = sorted(row["kind"] for row in cut.select("kind").distinct().collect())  # at most ``shingle`` numbers
    bits = docs.sparkSession.sparkContext.broadcast(bitmap_of(spread, "hash"))

    kind = dict(docs.dtypes)[id_column]
    texts = docs.select(F.col(id_column).alias("id"), digest(F.col("text")).alias("content"), "text")
    reach = max(window - shingle, 0)  # a shorter run is a window of its own
    found = texts.mapInArrow(
        _found_shingles(bits, kinds or [1], reach),
        f"id {kind}, content binary, n_words long, found array<struct<place:long,kind:int,hash:long,near:array<long>>>",
    )
    found = scratch.save(found, "found")

    # Rarity is counted over all documents, copies included.
    common = found.select(F.explode("found").alias("f")).groupBy("f.hash").agg(F.count("*").alias("times"))
    ranked = spread.join(common, "hash")  # a shingle that no document has cannot be part of a match
    whole = ranked.groupBy("window").agg(
        F.count("*").alias("present"),
        F.min(F.struct("times", "offset", "hash")).alias("rarest"),
        F.first("size").alias("size"),
        F.first("kind").alias("kind"),
        F.first("shingles").alias("shingles"),
    ).where(F.col("present") == F.size("shingles"))
    prefixes = scratch.save(
        whole.select("window", "size", "kind", "shingles", F.col("rarest.offset").alias("offset"), F.col("rarest.hash").alias("hash")),
        "prefixes",
    )

    # One copy of each text goes on.
    once = found.where(F.size("found") > 0).dropDuplicates(["content"]).select("content", "n_words", F.explode("found").alias("f"))
    once = once.select("content", "n_words", "f.place", F.col("f.kind").alias("length"), "f.hash", "f.near")
    start = F.col("place") - F.col("offset")
    matched = once.join(prefixes, "hash").where(
        (F.col("length") == F.col("kind")) & (start >= 0) & (start + F.col("size") <= F.col("n_words"))
        & (F.slice("near", F.lit(reach + 1) - F.col("offset"), F.size("shingles")) == F.col("shingles"))
    )
    matched = scratch.save(matched.select("content", "window", start.alias("start"), (start + F.col("size")).alias("end")), "matched")

    before = Window.partitionBy("content").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = matched.groupBy("content", "start").agg(F.max("end").alias("end"))
    fresh = F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))
    covered = covered.withColumn("fresh", F.greatest(fresh, F.lit(0))).groupBy("content").agg(F.sum("fresh").alias("n_hit"))
    owners = cut.where("item IS NOT NULL").select("window", F.col("item").cast("string").alias("item")).distinct()
    named = matched.select("content", "window").distinct().join(owners, "window")
    named = named.groupBy("content").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = scratch.save(covered.join(named, "content", "left"), "hits")  # so that Spark can split a text with many copies

    key = F.coalesce("content", F.lit(b""))
    rows = found.select("id", "content", "n_words").withColumn("key", key)
    hits = hits.withColumnRenamed("content", "key")
    joined = rows.join(hits, "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    names = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        F.col("id").alias(id_column),
        "content",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        names.alias("items"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` (documents) whose text holds no window of any item; columns as they are."""
    judged = find_contamination(docs, items).where("contaminated").select("content").distinct()
    judged = Scratch(docs.sparkSession, "contaminated").save(judged, "texts")  # a small one is broadcast, and no text shuffled
    rows = docs.select(F.struct(F.col("*")).alias("row"), digest(F.col("text")).alias("content"))
    return rows.join(judged, "content", "left_anti").select("row.*")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document shares with the benchmark, over 10-word windows."""
    result = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return result.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated"
    )


OP4_SQL = r"""
WITH item_words AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
),
windows AS (
    SELECT DISTINCT item_id, words[i:i + least(len(words), 10) - 1] AS w
    FROM item_words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS t(i) WHERE len(words) > 0
),
sizes AS (SELECT DISTINCT len(w) AS size FROM windows),
doc_words AS (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents
),
runs AS (
    SELECT doc_id, i, size, words[i:i + size - 1] AS w
    FROM doc_words, sizes, unnest(range(1, len(words) - size + 2)) AS t(i) WHERE len(words) >= size
),
matched AS (SELECT doc_id, i, size, item_id FROM runs JOIN windows USING (w)),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM matched, unnest(range(0, size)) AS t(k) GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM matched) GROUP BY doc_id
)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
