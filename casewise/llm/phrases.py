"""Phrase collocation mining: suffixes of the corpus dealt out by word prefix, a depth-truncated subtree per group.

The words of every piece are read from each position on, a few words deep. All suffixes that begin with a prefix go to
one group, so that a group builds its part of the suffix tree alone and reads the counts of its phrases from the totals
of its leaves. A prefix too frequent for a group's memory is made longer by a word, after one more count over the texts.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewise.llm.common import Scratch, _powers, bitmap_of, in_bitmap, mix, table, text_slices

LONGEST, MINIMUM, COVERED_PERCENT, KEPT, UNKNOWN = 4, 30, 80, 2000, "und"
#: Suffixes that a group may hold, about 10 MB; with few suffixes, groups are at least so many per shuffle partition.
GROUP_SUFFIXES, GROUPS_PER_PARTITION = 200_000, 4
#: Words and their bytes that a task counts before it hands them on.
HELD_WORDS, HELD_BYTES = 200_000, 32 << 20
#: Prefixes and suffixes that a task gathers before it counts or packs them.
HELD_PREFIXES, HELD_SUFFIXES = 2_000_000, 400_000

_KIND = np.zeros(256, np.uint8)  # 0: a word's byte, 1: blank, 2: end of a piece
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_NEXT = np.uint64(0x9FB21C651E98DF25)


class PieceWords:
    """Words of some texts: a 64-bit ``key`` per word and language, where it stands, and whether the next one continues its piece."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, languages: np.ndarray):
        self.low, kind = _LOWER[data], _KIND[data]
        word, n = kind == 0, len(kind)
        fresh = np.zeros(n + 1, bool)  # a text begins here
        fresh[bounds] = True
        fresh[-1] = True
        before = np.append(False, word[:-1]) & ~fresh[:-1]
        after = np.append(word[1:], False) & ~fresh[1:]
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        first = np.searchsorted(self.start, bounds)
        self.per_text = np.diff(first)
        self.text = np.repeat(np.arange(len(bounds) - 1), self.per_text)
        ends = np.cumsum(kind == 2, dtype=np.int64)
        self.goes_on = np.zeros(len(self.start), bool)
        if len(self.start) > 1:
            same = (self.text[1:] == self.text[:-1]) & (ends[self.start[1:]] == ends[self.end[:-1] - 1])
            self.goes_on[:-1] = same
        power, inverse = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.low * power[:n], out=total[1:])
        h = (total[self.end] - total[self.start]) * inverse[self.start]
        h = mix(h + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.key = np.maximum(mix(h ^ languages[self.text]), np.uint64(1))  # 0 stands for no word


def _language_key(language: str) -> int:
    return int.from_bytes(hashlib.blake2b(language.encode(), digest_size=8).digest(), "little")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], PieceWords]]:
    """Slices of a few megabytes of whole texts: the language of each text, and the words."""
    keys: dict[str, int] = {}
    for batch in batches:
        languages = batch.column("lang").to_pylist()
        for at, to, data, bounds in text_slices(batch.column("text")):
            some = languages[at:to]
            for language in set(some) - keys.keys():
                if len(keys) > 10_000:
                    keys.clear()
                keys[language] = _language_key(language)
            yield some, PieceWords(data, bounds, np.array([keys.get(x) or _language_key(x) for x in some], np.uint64))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, key, word, count) of the words; a row without a key holds the number of all words."""
    counts: dict[int, int] = {}
    names: dict[int, tuple[str, bytes]] = {}
    totals: Counter[str] = Counter()
    held = 0

    def flush() -> pa.RecordBatch:
        rows = [(*names[key], key, count) for key, count in counts.items()]
        columns = (
            [r[0] for r in rows] + list(totals),
            [r[2] - (1 << 64) if r[2] >> 63 else r[2] for r in rows] + [None] * len(totals),
            [r[1].decode() for r in rows] + [None] * len(totals),
            [r[3] for r in rows] + list(totals.values()),
        )
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "key", "word", "count"])

    for languages, words in _read(batches):
        for language, n in zip(languages, words.per_text.tolist()):
            if n:
                totals[language] += n
        keys, at, number = np.unique(words.key, return_index=True, return_counts=True)
        for key, place, n in zip(keys.tolist(), at.tolist(), number.tolist()):
            if key in counts:
                counts[key] += n
            else:
                counts[key] = n
                word = words.low[words.start[place] : words.end[place]].tobytes()
                names[key] = languages[words.text[place]], word
                held += len(word)
        if len(counts) > HELD_WORDS or held > HELD_BYTES:
            yield flush()
            counts, names, totals, held = {}, {}, Counter(), 0
    if totals:
        yield flush()


def _suffixes(words: PieceWords, frequent: np.ndarray, longest: int) -> list[np.ndarray]:
    """Columns of word keys, 0 behind the end: from each word on, up to the end of its piece or a word that is not frequent.

    Suffixes of a single word are left out: words are counted already.
    """
    ok, n = in_bitmap(frequent, words.key), len(words.key)
    if n < 2:
        return [np.zeros(0, np.uint64)] * longest
    pair = np.zeros(n, bool)
    pair[:-1] = words.goes_on[:-1] & ok[:-1] & ok[1:]
    rows = np.flatnonzero(pair)
    columns, alive = [words.key[rows]], np.ones(len(rows), bool)
    for d in range(1, longest):
        alive = alive & pair[np.minimum(rows + d - 1, n - 1)]
        columns.append(np.where(alive, words.key[np.minimum(rows + d, n - 1)], np.uint64(0)))
    return columns


def _follow(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of a prefix with one more word; it only decides on groups."""
    return mix(prefix * _NEXT + word)


def _deal(columns: list[np.ndarray], hot: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The prefix that decides each suffix's group, and how many words it has: one more after each that is too frequent."""
    prefix, deep = columns[0], np.ones(len(columns[0]), np.int64)
    for d, bits in enumerate(hot):
        longer = (deep == d + 1) & in_bitmap(bits, prefix)
        prefix = np.where(longer, _follow(prefix, columns[d + 1]), prefix)
        deep = deep + longer
    return prefix, deep


def _count_prefixes(frequent: np.ndarray, hot: list[np.ndarray], longest: int, share: float):
    """(prefix, count) of the prefixes one word longer than those that were too frequent last.

    Counts of less than a quarter of ``share`` of what a task has gathered stay behind. A prefix that makes up ``share`` of
    all words loses less than a quarter of its count so, and a task hands on at most ``4 / share`` rows at a time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            often = 4 * n >= share * size
            keys, n = keys[often], n[often]
            return pa.RecordBatch.from_arrays([_signed(keys), pa.array(n, pa.int64())], ["prefix", "count"])

        for _, words in _read(batches):
            prefix, deep = _deal(_suffixes(words, frequent, longest), hot)
            held.append(prefix[deep == len(hot) + 1])
            size += len(held[-1])
            if size > HELD_PREFIXES:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return count


def _distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows, where each distinct one starts in it, and their counts. A hash sorts, the columns decide."""
    key = columns[0]
    for column in columns[1:]:
        key = _follow(key, column)
    order = np.argsort(key, kind="stable")
    for attempt in (order, None):
        if attempt is None:  # two different rows share a hash
            order = np.lexsort(columns[::-1])
        change = np.ones(len(order), bool)
        change[1:] = False
        for column in columns:
            change[1:] |= column[order][1:] != column[order][:-1]
        if attempt is None or change.sum() == (np.diff(key[order]) != 0).sum() + 1:
            break
    first = np.flatnonzero(change)
    return order, first, np.diff(np.append(first, len(order)))


def _deal_suffixes(frequent: np.ndarray, hot: list[np.ndarray], longest: int, groups: int):
    """Distinct suffixes of a task's last texts with their number of occurrences, packed: a row for each group they go to.

    A pack holds the columns one after the other, in the order of the first word, which the shuffle compresses well.
    """

    def packs(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate(parts) for parts in zip(*held)]
        order, first, count = _distinct(columns)
        columns = [column[order[first]] for column in columns]
        prefix, deep = _deal(columns, hot)
        group = (prefix % np.uint64(groups)).astype(np.int64)
        order = np.lexsort((columns[0], group))
        group, parts = group[order], [c[order] for c in (*columns, count.astype("<i4"), deep.astype(np.uint8))]
        cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1])).tolist() + [len(group)]
        data = [b"".join([part[a:b].tobytes() for part in parts]) for a, b in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(group[cuts[:-1]]), pa.array(data, pa.binary())], ["group", "pack"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for _, words in _read(batches):
            columns = _suffixes(words, frequent, longest)
            if len(columns[0]):
                held.append(columns)
                size += len(columns[0])
            if size > HELD_SUFFIXES:
                yield packs(held)
                held, size = [], 0
        if held:
            yield packs(held)

    return deal


def _unpack(packs: list[bytes], longest: int) -> list[np.ndarray]:
    """The columns of all packs: words, counts, lengths of the prefixes."""
    kinds = [np.dtype("<i8")] * longest + [np.dtype("<i4"), np.dtype("u1")]
    width, parts = sum(kind.itemsize for kind in kinds), []
    for pack in packs:
        rows, at, columns = len(pack) // width, 0, []
        for kind in kinds:
            columns.append(np.frombuffer(pack, kind, rows, at))
            at += rows * kind.itemsize
        parts.append(columns)
    return [np.concatenate(column) for column in zip(*parts)]


def _subtree(longest: int, minimum: int):
    """The nodes of a group's subtree, two words deep at least, with their counts.

    In the order of the suffixes a node is a run of leaves. Its total is whole unless the group's prefix is longer than
    the node; then it is a part that other groups add to.
    """
    names = [f"h{d}" for d in range(1, longest + 1)]

    def build(group: pa.Table) -> pa.Table:
        *columns, count, deep = _unpack(group["pack"].to_pylist(), longest)
        order = np.lexsort(columns[::-1])
        count, deep = count[order].astype(np.int64), deep[order]
        new = np.zeros(len(order), bool)
        new[0] = True
        nodes = []
        for d, column in enumerate(columns, 1):
            column = column[order]
            new[1:] |= column[1:] != column[:-1]
            if d == 1:
                continue
            first = np.flatnonzero(new)
            total = np.add.reduceat(count, first)
            kept = (column[first] != 0) & ((total >= minimum) | (deep[first] > d))
            rows = order[first[kept]]
            path = [columns[e][rows] if e < d else np.zeros(len(rows), np.int64) for e in range(longest)]
            nodes.append(pa.table([*path, np.full(len(rows), d, np.int32), total[kept]], [*names, "depth", "a"]))
        return pa.concat_tables(nodes)

    return build


def _whole(column: Column, digits: int = 19) -> Column:
    return column.cast(f"decimal({digits},0)")


def _scores(phrases: DataFrame, parts: DataFrame, longest: int) -> DataFrame:
    """Add l, r and score of each phrase's lowest-scoring cut; ``parts`` has the counts of all words and phrases."""
    names = [f"h{d}" for d in range(1, longest + 1)]

    def part(number: int, side: int, words: list[str]) -> Column:
        padded = [F.col(w) for w in words] + [F.lit(0).cast("long")] * (longest - len(words))
        fields = [p.alias(f"p{d}") for d, p in enumerate(padded, 1)]
        return F.struct(F.lit(2 * number + side).alias("slot"), *fields)

    cuts = [(k, side, names[:k] if side == 0 else names[k:]) for k in range(1, longest) for side in (0, 1)]
    halves = phrases.select(*names, "depth", "a", F.inline(F.array(*[part(*cut) for cut in cuts]))).where(F.col("slot") < 2 * F.col("depth"))
    keyed = parts.select(*[F.col(n).alias(f"p{d}") for d, n in enumerate(names, 1)], F.col("a").alias("f"))
    found = halves.join(keyed, [f"p{d}" for d in range(1, longest + 1)])
    counts = [F.max(F.when(F.col("slot") == 2 * k + side, F.col("f"))).alias(f"c{2 * k + side}") for k, side, _ in cuts]
    counted = found.groupBy(*names, "depth", "a").agg(*counts)
    lowest = F.array_min(
        F.array(
            *[
                F.when(
                    F.lit(k) < F.col("depth"),
                    F.struct(
                        F.expr(
                            f"CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) div "
                            f"(CAST(c{2 * k} AS DECIMAL(19,0)) + CAST(c{2 * k + 1} AS DECIMAL(19,0)))"
                        ).alias("score"),
                        F.lit(k).alias("k"),
                        F.col(f"c{2 * k}").alias("l"),
                        F.col(f"c{2 * k + 1}").alias("r"),
                    ),
                )
                for k in range(1, longest)
            ]
        )
    )
    return counted.withColumn("cut", lowest).select(*names, "depth", "a", "cut.l", "cut.r", "cut.score")


def _drop_covered(scored: DataFrame, phrases: DataFrame, longest: int, percent: int) -> DataFrame:
    """Without phrases that a longer one holds in at least ``percent`` of their occurrences."""
    names = [f"h{d}" for d in range(1, longest + 1)]
    inside = [(at, size) for size in range(2, longest) for at in range(longest - size + 1)]

    def inner(at: int, size: int) -> Column:
        padded = [F.col(w) for w in names[at : at + size]] + [F.lit(0).cast("long")] * (longest - size)
        return F.struct(F.lit(at + size).alias("end"), F.lit(size).alias("size"), *[p.alias(f"p{d}") for d, p in enumerate(padded, 1)])

    if not inside:
        return scored
    held = phrases.where(F.col("depth") > 2).select("depth", "a", F.inline(F.array(*[inner(*i) for i in inside])))
    held = held.where((F.col("end") <= F.col("depth")) & (F.col("size") < F.col("depth")))
    most = held.groupBy(*[F.col(f"p{d}").alias(n) for d, n in enumerate(names, 1)]).agg(F.max("a").alias("longer"))
    covered = F.lit(100).cast("decimal(3,0)") * _whole(F.col("longer")) >= F.lit(percent).cast("decimal(3,0)") * _whole(F.col("a"))
    return scored.join(most, names, "left").where(~F.coalesce(covered, F.lit(False))).drop("longer")


def _first_of_each(rows: DataFrame, scratch: Scratch, keys: list[str], order: list[Column], first: int) -> DataFrame:
    """Rank rows per key and keep the first ones, by a sort over ranges of the whole order: no key meets in one task."""
    by = [F.col(key) for key in keys] + order
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = placed.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    placed = scratch.save(placed, "ordered")
    parts = placed.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("rows"), F.min("place").alias("start"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    parts = scratch.save(parts.where(F.col("before") < first).drop("rows"), "parts")
    ranked = placed.join(parts, [*keys, "part"]).withColumn("rank", F.col("place") - F.col("start") + F.col("before") + 1)
    return ranked.where(F.col("rank") <= first).drop("part", "place", "start", "before")


def mine_phrases(
    docs: DataFrame,
    longest: int = LONGEST,
    minimum: int = MINIMUM,
    covered_percent: int = COVERED_PERCENT,
    first: int = KEPT,
    group_suffixes: int = GROUP_SUFFIXES,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` collocations of each language.

    A-Z is lowered; ``.,;:!?`` and line ends (0A to 0D) end a piece, blanks and tabs a word. Phrases have 2 to
    ``longest`` words of one piece and occur at least ``minimum`` times (``a``, overlaps included) in their language; n
    counts all its words. A cut after k words gives the counts l and r of both parts and the score
    floor(2000000 a / (l + r)); the lowest-scoring cut counts, ties to the smallest k. A phrase that lies in a longer one
    which has at least ``covered_percent`` of its occurrences is dropped. Ranked by score, then a, both falling, then phrase.

    Words are told apart by 64-bit hashes of language and word. The texts are scanned once for the words, once for each
    length of prefixes that are too frequent for a group, and once for the suffixes. Words below ``minimum`` are cut
    out by a bitmap of 8 MB, which may let others through but never loses one. A task hands on the distinct suffixes of
    each 400,000 in a row, so a phrase that stands everywhere is sent once for those, not per occurrence. Groups hold about
    ``group_suffixes`` occurrences, fewer where that would leave shuffle partitions without work.

    A null text is empty, a null language is ``und``; repeated rows count each time; nothing frequent, or an empty
    table, gives no rows. Only ``lang`` and ``text`` are read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    names = [f"h{d}" for d in range(1, longest + 1)]
    keys = ", ".join(f"{name} long" for name in names)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))

    counted = rows.mapInArrow(_count_words, "lang string, key long, word string, count long")
    counted = counted.groupBy("lang", "key", "word").agg(F.sum("count").alias("a"))
    counted = scratch.save(counted.where(F.col("key").isNull() | (F.col("a") >= minimum)), "words")
    words, sizes = counted.where(F.col("key").isNotNull()), counted.where(F.col("key").isNull()).select("lang", F.col("a").alias("n"))
    whole = words.agg(F.sum("a")).first()[0] or 0
    frequent = bitmap_of(words, "key")

    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = max(math.ceil(whole / group_suffixes), GROUPS_PER_PARTITION * partitions)
    room = max(1, whole // groups)
    hot: list[np.ndarray] = []
    prefixes = words.select(F.col("key").alias("prefix"), F.col("a").alias("count"))
    while len(hot) < longest - 1:
        # Counts over the texts may miss less than a quarter, see there; which prefixes are longer changes no result.
        full = scratch.save(prefixes.where(F.col("count") > (0.75 * room if hot else room)), "full")
        if full.isEmpty():
            break
        hot.append(bitmap_of(full, "prefix"))
        prefixes = rows.mapInArrow(_count_prefixes(frequent, hot, longest, room / whole), "prefix long, count long")
        prefixes = prefixes.groupBy("prefix").agg(F.sum("count").alias("count"))

    suffixes = rows.mapInArrow(_deal_suffixes(frequent, hot, longest, groups), "group long, pack binary")
    nodes = suffixes.groupBy("group").applyInArrow(_subtree(longest, minimum), f"{keys}, depth int, a long")
    nodes = scratch.save(nodes, "nodes")
    phrases = nodes.groupBy(*names, "depth").agg(F.sum("a").alias("a")).where(F.col("a") >= minimum)
    phrases = scratch.save(phrases, "phrases")
    scratch.drop(nodes)

    zero = F.lit(0).cast("long")
    single = words.select(F.col("key").alias("h1"), *[zero.alias(name) for name in names[1:]], "a")
    parts = scratch.save(phrases.select(*names, "a").union(single), "parts")
    scored = _drop_covered(_scores(phrases, parts, longest), phrases, longest, covered_percent)
    scored = scratch.save(scored, "scored")

    at = [F.struct(F.lit(d).alias("at"), F.col(name).alias("key")) for d, name in enumerate(names)]
    spelled = scored.select(*names, F.inline(F.array(*at))).where(F.col("key") != 0).join(words.select("lang", "key", "word"), "key")
    phrase = F.array_join(F.sort_array(F.collect_list(F.struct("at", "word")))["word"], " ")
    spelled = spelled.groupBy(*names).agg(F.max("lang").alias("lang"), phrase.alias("phrase"))
    spelled = scored.join(spelled, names).drop(*names, "depth")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = _first_of_each(spelled, scratch, ["lang"], order, first).join(sizes, "lang")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_suffix_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language of ``documents``."""
    return mine_phrases(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS w FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece
        FROM documents
    )
),
counts AS MATERIALIZED (
    SELECT lang, m, phrase, count(*) AS a FROM (
        SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
        FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces CROSS JOIN range(1, 5) t(m))
    ) GROUP BY lang, m, phrase
),
sizes AS (SELECT lang, sum(a)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY lang),
frequent AS MATERIALIZED (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM counts WHERE a >= 30),
candidates AS (SELECT * FROM frequent WHERE m >= 2),
cuts AS (
    SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a // (x.a + y.a))::BIGINT AS score
    FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c
    JOIN frequent x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
    JOIN frequent y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:c.m], ' ')
),
best AS (
    SELECT lang, phrase, a, l, r, score FROM cuts
    QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
),
inside AS (
    SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer
    FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM candidates))
    GROUP BY 1, 2
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM best b LEFT JOIN inside i USING (lang, phrase) JOIN sizes USING (lang)
WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
QUALIFY rank <= 2000
"""
