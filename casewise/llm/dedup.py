"""Near-duplicates by BagMinHash signatures, bands and verified multiset overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewise.llm.common import Scratch, Words, bitmap_of, digest, in_bitmap, list_array, may_be_in, mix, table, text_slices
from casewise.llm.components import connected_components

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: A pair at the threshold shares one of 24 bands of 5 places with probability 0.99993.
BANDS, BAND_ROWS = 24, 5
#: Leaders of its buckets with which a text is compared first; what they leave apart is compared with the rest.
LEADERS = 2

_U = np.uint64


def bag_of_shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of each distinct shingle of each text, sorted; the weight is its count.

    A text of fewer words than ``k``, but not none, is one shingle.
    """
    counts = np.diff(words.first)
    hashes, whole = words.shingles(k)
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(whole)
    text, hashes = text[at], hashes[at]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        ones = np.empty(len(short), np.uint64)
        for i, t in enumerate(short):
            h = counts[t : t + 1].astype(np.uint64)
            for at_word in range(words.first[t], words.first[t + 1]):
                h = mix(h * _U(0xC2B2AE3D27D4EB4F) + words.hash[at_word : at_word + 1])
            ones[i] = h[0]
        text, hashes = np.concatenate([text, short]), np.concatenate([hashes, ones])
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    starts = np.flatnonzero(new)
    return text[starts], hashes[starts], np.diff(np.append(starts, len(text)))


def _uniform(bits: np.ndarray) -> np.ndarray:
    """Numbers above 0 and at most 1."""
    return ((bits >> _U(11)) + _U(1)).astype(np.float64) * 2.0**-53


def bag_min_hash(text, shingle, weight, texts: int, places: int) -> np.ndarray:
    """BagMinHash signatures, (texts, places) float32; texts without shingles keep infinity.

    The weight axis of a shingle is cut at 1, 2, 4, 8, ... Each interval below the weight has a Poisson
    process of points in time, seeded by (shingle, interval), whose rate is the interval's length; each point
    falls on one place, and a place keeps its earliest point. In the interval that the weight ends in, a
    point is followed down by halves and counts only if it comes out below the weight. Two texts keep the same
    point on a place with the probability of their weighted Jaccard similarity.

    Processes run only until a time by which all places are very likely filled; a text with an empty
    place runs on for twice as long, which changes no point that came before.
    """
    signature = np.full(texts * places, np.inf, np.float32)
    total = np.bincount(text, weights=weight, minlength=texts)
    limit = places * (np.log(places) + 4) / np.maximum(total, 1)
    # One process per interval: 0 is [0, 1), j is [2**(j-1), 2**j); the last may end above the weight.
    last = np.ceil(np.log2(weight)).astype(np.int64)
    level = np.arange(last.sum() + len(last)) - np.repeat(np.cumsum(last + 1) - last - 1, last + 1)
    of = np.repeat(np.arange(len(text)), last + 1)
    seed = mix(shingle[of] + level.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    length = np.where(level == 0, 1.0, 2.0 ** (level - 1))
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    share = (weight[of] - low) / length  # of the interval below the weight
    owner = text[of]
    open_ = np.unique(text)
    while len(open_):
        busy = np.zeros(texts, bool)
        busy[open_] = True
        _run(signature, places, np.flatnonzero(busy[owner]), owner, seed, length, share, limit)
        empty = np.isinf(signature.reshape(texts, places)[open_]).any(axis=1)
        open_ = open_[empty]
        limit[open_] *= 2
    return signature.reshape(texts, places)


def _run(signature, places, which, owner, seed, length, share, limit) -> None:
    expected = limit[owner[which]] * length[which]
    size = np.maximum(0, np.ceil(np.log2(expected))).astype(np.int64)
    for power in np.unique(size):
        alive = which[size == power]
        step = 1 << int(power)
        # Points per call: bounded blocks of processes.
        for block in np.array_split(alive, max(1, len(alive) * step >> 21)):
            _points(signature, places, block, step, owner, seed, length, share, limit)


def _points(signature, places, alive, step, owner, seed, length, share, limit) -> None:
    at = np.zeros(len(alive))
    counter = 0
    while len(alive):
        draw = np.arange(counter, counter + step, dtype=np.uint64) * _U(0xD1B54A32D192ED03)
        bits = mix(seed[alive][:, None] + draw)
        gaps = -np.log(_uniform(bits)) / length[alive][:, None]
        gaps[:, 0] += at
        times = np.cumsum(gaps, axis=1)
        other = mix(bits ^ _U(0xA0761D6478BD642F))
        below = (other >> _U(32)).astype(np.float64) * 2.0**-32 < share[alive][:, None]
        good = (times < limit[owner[alive]][:, None]) & below
        rows, columns = np.nonzero(good)
        slot = (other[rows, columns] & _U(0xFFFFFFFF)) % _U(places)
        np.minimum.at(signature, owner[alive[rows]] * places + slot.astype(np.int64), times[rows, columns].astype(np.float32))
        at = times[:, -1]
        going = at < limit[owner[alive]]
        alive, at = alive[going], at[going]
        counter += step


def _signatures(k: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, bounds in text_slices(batch.column("text")):
                text, shingle, weight = bag_of_shingles(Words(data, bounds), k)
                signature = bag_min_hash(text, shingle, weight, to - at, bands * rows)
                total = np.bincount(text, weights=weight, minlength=to - at).astype(np.int64)
                full = total > 0
                band = np.arange(bands, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
                h = np.broadcast_to(band, (int(full.sum()), bands)).copy()
                places = signature[full].view(np.uint32).reshape(-1, bands, rows)
                for j in range(rows):
                    h = mix(h + places[:, :, j].astype(np.uint64) + _U(j + 1))
                values = list_array(h.ravel().view(np.int64), np.where(full, bands, 0), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, to - at), batch.column("content").slice(at, to - at), pa.array(total), values],
                    ["id", "content", "shingles", "bands"],
                )

    return sign


def _bags(bits, k: int):
    """The sorted shingles and weights of the documents whose key has its bit."""

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
            kept = batch.take(pa.array(np.flatnonzero(in_bitmap(bits.value, keys))))
            for at, to, data, bounds in text_slices(kept.column("text")):
                text, shingle, weight = bag_of_shingles(Words(data, bounds), k)
                first = np.searchsorted(text, np.arange(to - at + 1))
                weight = weight.astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [
                        kept.column("content").slice(at, to - at),
                        pa.array([shingle[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary()),
                        pa.array([weight[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary()),
                    ],
                    ["content", "shingle", "weight"],
                )

    return bag


def _overlap(threshold: float):
    """Pairs whose multisets overlap by the threshold: sum of smaller weights over sum of larger ones."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            columns = [batch.column(c) for c in ("a_shingle", "a_weight", "b_shingle", "b_weight")]
            for i in range(batch.num_rows):
                x, p, y, q = (np.frombuffer(c[i].as_buffer(), k) for c, k in zip(columns, (np.uint64, np.uint32) * 2))
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                same = x[at] == y
                shared = int(np.minimum(p[at[same]], q[same]).sum())
                good.append(shared >= threshold * (int(p.sum()) + int(q.sum()) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return check


def near_duplicate_classes(
    docs: DataFrame,
    id_column: str = "doc_id",
    threshold: float = THRESHOLD,
    k: int = SHINGLE_WORDS,
    bands: int = BANDS,
    rows: int = BAND_ROWS,
) -> DataFrame:
    """(id, content, class_id, class_texts, kept) for every row of ``docs``.

    Two texts are linked when the multisets of their shingles of ``k`` words have a weighted Jaccard similarity of
    ``threshold`` or more; a class is a connected component of links and bears its smallest id. Words are
    those of ASCII letters, digits and characters above 7F, with A-Z lowered; a shorter text is
    one shingle. ``class_texts`` counts the different texts of a class; ``kept`` marks the rows with the class's id.

    Equal texts are one node from the start. Bands of BagMinHash signatures name candidate buckets. First, each
    text is compared with those most copied texts of its buckets that it meets most often, which brings most of
    a group under one label. Then only buckets that hold several labels are left. A text can be linked there only if enough
    of its shingles occur in other texts that are left; that bound, which loses no link, drops texts
    that share a passage or were edited too much. Those that it keeps are joined by their prefixes, the rarest
    shingles of which linked texts must share one: what stands outside the largest label of a shingle is compared
    with all texts of the shingle that have another label, so pairs under one label are never formed.

    A text without words is linked to equal texts only. A null text is a class of its own row id
    and always kept. Ids may be null; a class with null ids only has a null class_id. Repeated rows get equal
    results. An empty table gives no rows. Only ``id_column`` and ``text`` are read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "dedup")
    kind = dict(docs.dtypes)[id_column]
    texts = docs.select(F.col(id_column).alias("id"), digest(F.col("text")).alias("content"), "text")
    signed = texts.mapInArrow(_signatures(k, bands, rows), f"id {kind}, content binary, shingles long, bands array<long>")
    signed = scratch.save(signed, "signatures")

    known = signed.where("content IS NOT NULL")
    nodes = known.groupBy("content").agg(
        F.min("id").alias("id"), F.count("*").alias("copies"), F.first("shingles").alias("shingles"), F.first("bands").alias("bands")
    )
    nodes = scratch.save(nodes, "nodes")
    member = nodes.select("content", "copies", "shingles", F.explode("bands").alias("band"))
    first = member.groupBy("band").agg(
        F.max(F.struct("copies", "content", "shingles")).alias("first"), F.min("shingles").alias("least"), F.count("*").alias("n")
    )
    # Written, so that the join stands alone and Spark can split a large bucket.
    first = scratch.save(first.where("n > 1").select("band", "first", "least"), "first")
    buckets = scratch.save(member.join(first, "band").drop("copies"), "buckets")
    bags = _make_bags(scratch, texts, nodes.select("content", "id").join(buckets.select("content").distinct(), "content"), k)

    def able(x: str, y: str):
        return F.least(x, y) >= threshold * F.greatest(x, y)

    # The leaders that a text meets in most buckets are the likeliest to be similar to it.
    met = buckets.where((F.col("first.content") != F.col("content")) & able("first.shingles", "shingles"))
    met = met.groupBy(F.col("content").alias("b"), F.col("first.content").alias("a")).agg(
        F.count("*").alias("buckets"), F.max("first.copies").alias("copies")
    )
    order = Window.partitionBy("b").orderBy(F.desc("buckets"), F.desc("copies"), "a")
    chosen = scratch.save(met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LEADERS), "leaders")
    links = _verify(scratch, chosen.select("a", "b"), bags, threshold)
    # A first label is enough here: it only has to bring most of a group together.
    label = links.join(chosen, ["a", "b"]).groupBy(F.col("b").alias("content")).agg(F.max(F.struct("copies", "a"))["a"].alias("label"))
    label = scratch.save(label, "labels")
    named = buckets.join(label, "content", "left")
    named = scratch.save(named.select("band", "content", "shingles", "least", F.coalesce("label", "content").alias("class")), "named")
    left = _in_mixed_buckets(scratch, named)
    alone = _lone_weight(bags, left.select("content").distinct())
    left = left.join(alone, "content", "left").withColumn("shared", F.col("shingles") - F.coalesce("alone", F.lit(0)))
    # An overlap by the threshold is at least this part of both lengths together.
    part = threshold / (1 + threshold)
    partner = F.greatest(F.col("least"), F.ceil(F.col("shingles") * threshold - 1e-6))
    left = left.where(F.col("shared") >= part * (F.col("shingles") + partner) - 1e-6).groupBy("content")
    left = left.agg(*[F.min(c).alias(c) for c in ("class", "shingles", "least", "shared")])
    left = _in_mixed_buckets(scratch, _prefixes(scratch, bags, scratch.save(left, "able"), part * (F.col("shingles") + partner) - 1e-6))
    apart = left.where("class != main").select("band", *[F.col(c).alias(f"a_{c}") for c in ("content", "shingles", "class", "shared")])
    once = (F.col("class") == F.col("main")) | (F.col("a_content") < F.col("content"))
    enough = F.least("a_shared", "shared") >= part * (F.col("a_shingles") + F.col("shingles")) - 1e-6
    pairs = apart.join(left, "band").where((F.col("a_class") != F.col("class")) & able("a_shingles", "shingles") & enough & once)
    more = _verify(scratch, pairs.select(F.col("a_content").alias("a"), F.col("content").alias("b")).distinct(), bags, threshold)
    groups = scratch.save(connected_components(links.union(more), scratch), "components")
    classed = nodes.join(groups.withColumnRenamed("node", "content"), "content", "left")
    classed = classed.select("content", "id", F.coalesce("component", "content").alias("class"))
    least = classed.groupBy("class").agg(F.min("id").alias("class_id"), F.count("*").alias("class_texts"))
    found = scratch.save(classed.join(least, "class").select("content", "class_id", "class_texts"), "classes")
    out = signed.select("id", "content").join(found, "content", "left")
    lone = F.col("content").isNull()
    class_id = F.when(lone, F.col("id")).otherwise(F.col("class_id"))
    return out.select(
        F.col("id").alias(id_column),
        "content",
        class_id.alias("class_id"),
        F.when(lone, F.lit(1).cast("long")).otherwise(F.col("class_texts")).alias("class_texts"),
        F.col("id").eqNullSafe(class_id).alias("kept"),
    )


def _in_mixed_buckets(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """The rows of buckets with more than one class, with the largest class of the bucket as ``main``."""
    sizes = rows.groupBy("band", "class").agg(F.count("*").alias("n"))
    main = sizes.groupBy("band").agg(F.max(F.struct("n", "class"))["class"].alias("main"), F.count("*").alias("classes"))
    main = scratch.save(main.where("classes > 1").select("band", "main"), "mixed")
    return scratch.save(rows.drop("main").join(main, "band"), "left")


def _make_bags(scratch: Scratch, texts: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(content, shingle, weight) of the texts of ``asked`` (content, id), each once.

    A bitmap of 8 MB keeps the other texts from being shuffled; one text of each content is taken.
    """
    keys = asked.select("content", F.xxhash64("id", "content").alias("key"))
    bits = asked.sparkSession.sparkContext.broadcast(bitmap_of(keys, "key"))
    keyed = texts.select("content", "text", F.xxhash64("id", "content").alias("key")).where("content IS NOT NULL")
    bags = keyed.mapInArrow(_bags(bits, k), "content binary, shingle binary, weight binary")
    return scratch.save(bags.dropDuplicates(["content"]), "bags")


def _lone_weight(bags: DataFrame, contents: DataFrame) -> DataFrame:
    """(content, alone): the weight of the shingles that no other of the ``contents`` has; none if there is none."""
    rows = bags.join(contents, "content", "left_semi").mapInArrow(_unfold, "content binary, shingle long, weight long")
    single = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("content").alias("content"), F.min("weight").alias("weight"))
    return single.where("n = 1").groupBy("content").agg(F.sum("weight").alias("alone"))


def _prefixes(scratch: Scratch, bags: DataFrame, nodes: DataFrame, least_overlap: Column) -> DataFrame:
    """``nodes`` once for each shingle of their prefix, as ``band``.

    Shingles are ordered by the number of ``nodes`` that have them. Two texts that overlap by enough share one
    among the rarest of each, before what is left weighs less than ``least_overlap``; shingles that only one
    text has are in its prefix but lead nowhere.
    """
    rows = bags.join(nodes.select("content"), "content", "left_semi").mapInArrow(_unfold, "content binary, shingle long, weight long")
    rows = scratch.save(rows, "shingles")
    common = scratch.save(rows.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "common")
    rows = rows.join(common, "shingle", "left").join(nodes, "content")
    before = Window.partitionBy("content").orderBy(F.coalesce("n", F.lit(1)), "shingle").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    rows = rows.where((F.col("before") <= F.col("shingles") - least_overlap) & F.col("n").isNotNull())
    return scratch.save(rows.select(F.col("shingle").alias("band"), "content", "shingles", "class", "shared"), "prefixes")


def _unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each bag."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            shingles = [np.frombuffer(x.as_buffer(), np.int64) for x in some.column("shingle")]
            weights = [np.frombuffer(x.as_buffer(), np.uint32) for x in some.column("weight")]
            owner = np.repeat(np.arange(some.num_rows), [len(x) for x in shingles])
            yield pa.RecordBatch.from_arrays(
                [some.column("content").take(pa.array(owner)), pa.array(np.concatenate(shingles)), pa.array(np.concatenate(weights).astype(np.int64))],
                ["content", "shingle", "weight"],
            )


def _verify(scratch: Scratch, pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose multisets overlap by the threshold."""

    def side(name: str) -> DataFrame:
        return bags.select(F.col("content").alias(name), F.col("shingle").alias(f"{name}_shingle"), F.col("weight").alias(f"{name}_weight"))

    pairs = scratch.save(pairs, "pairs")
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return scratch.save(both.mapInArrow(_overlap(threshold), "a binary, b binary"), "links")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (documents) that stay: the one with the smallest id of each class; columns as they are.

    Of repeated rows of that id and text one stays; null texts all stay.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    classes = scratch.save(near_duplicate_classes(docs), "classes")  # so that its last join stands alone
    judged = classes.where("content IS NOT NULL").groupBy("doc_id", "content")
    judged = judged.agg(F.first("kept").alias("kept"), F.count("*").alias("n"))
    judged = scratch.save(judged.where("NOT kept OR n > 1").select(F.col("doc_id").alias("id"), "content", "kept"), "judged")
    rows = docs.select(F.struct(F.col("*")).alias("row"), F.col("doc_id").alias("id"), digest(F.col("text")).alias("content"))
    # Texts that are not judged are most of all; a bitmap of 8 MB keeps them from being shuffled.
    key = F.xxhash64("id", "content")
    asked = may_be_in(bitmap_of(judged.select(key.alias("key")), "key"), key, docs.sparkSession)
    rows = rows.withColumn("asked", asked)
    others, rows = rows.where("NOT asked"), rows.where("asked")

    def among(some: DataFrame, how: str, of: DataFrame) -> DataFrame:
        return of.join(some, of["id"].eqNullSafe(some["id"]) & (of["content"] == some["content"]), how)

    staying = among(judged.where("NOT kept"), "left_anti", rows)
    repeated = judged.where("kept")
    if repeated.isEmpty():
        return others.union(staying).select("row.*")
    once = among(repeated, "left_semi", staying).dropDuplicates(["id", "content"])
    return others.union(among(repeated, "left_anti", staying)).union(once).select("row.*")


def op1_bagminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_duplicate_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_texts", "kept")
