"""Exact counts of the most frequent terms of each scope, without shuffling every term.

A corpus has far more different terms than a vocabulary keeps. Each task therefore counts in a bounded
summary (Misra and Gries): when it holds too many terms of a scope, the count of the first term too many is taken off
all of them, and what is left at zero goes. A term has then occurred at least as often as the summary says, and at
most as often plus what was taken off, its *loss*. Both add up over tasks, so per scope:

* nothing lost: the counts are exact;
* the loss is below the N-th largest count: no term outside the summaries can be among the first N. Those that can
  (count plus loss reaches the N-th count) are counted again, exactly, and nothing else is;
* else nothing is proved, and all terms of the scope are counted.

The result is the same in all three cases.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewise.session import materialize

#: The term that stands for the document itself.
DOCUMENT = ""

#: Terms a task holds when it hands on its summary; up to twice as many and one Arrow batch before that.
COUNTERS = 1 << 19

#: Terms counted at a time; an Arrow batch may hold many times more.
SLICE_TERMS = 250_000

#: Terms looked up at a time when candidates are counted again.
LOOKUP_SLICE = 1_000_000

#: Candidates (scope and term) that may travel to the tasks; more are joined.
MAX_CARRIED = 1_000_000

SUMMARY = "scope string, term string, total bigint, df bigint, lost bigint"

_COUNTED = pa.schema([("scope", pa.string()), ("term", pa.string()), ("total", pa.int64()), ("df", pa.int64())])


def _count_batch(scopes: pa.Array, terms: pa.Array, overall: str | None) -> pa.Table:
    """Occurrences and documents of the terms of one batch, per scope and over all."""
    flat, parents = pc.list_flatten(terms), pc.list_parent_indices(terms)
    present = pc.fill_null(pc.not_equal(flat, DOCUMENT), False)
    coded = flat.filter(present).dictionary_encode()
    width = max(len(coded.dictionary), 1)
    row = parents.filter(present).to_numpy().astype(np.int64)
    places, count = np.unique(row * width + coded.indices.to_numpy().astype(np.int64), return_counts=True)
    code, scope = places % width, scopes.dictionary_encode("encode")
    group, where = np.unique(
        scope.indices.to_numpy().astype(np.int64)[places // width] * width + code, return_inverse=True
    )

    def summed(of: np.ndarray, size: int) -> list[pa.Array]:
        total = np.bincount(of, weights=count, minlength=size).astype(np.int64)
        return [pa.array(total), pa.array(np.bincount(of, minlength=size).astype(np.int64))]

    parts = [
        pa.table(
            [
                scope.dictionary.take(pa.array(group // width)).cast(pa.string()),
                coded.dictionary.take(pa.array(group % width)).cast(pa.string()),
                *summed(where, len(group)),
            ],
            schema=_COUNTED,
        )
    ]
    if overall is not None:
        every = coded.dictionary.cast(pa.string())
        parts.append(
            pa.table([pa.array([overall] * len(every), pa.string()), every, *summed(code, len(every))], schema=_COUNTED)
        )
    return pa.concat_tables(parts)


def _slices(batch: pa.RecordBatch, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Runs of rows that begin within the same ``most`` terms, ``SLICE_TERMS`` if not given."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.list_value_length(batch.column("terms")), 0).to_numpy().astype(np.int64)
    run = (np.cumsum(size) - size) // (most or SLICE_TERMS)
    cuts = [*np.flatnonzero(np.append(True, run[1:] != run[:-1])).tolist(), batch.num_rows]
    for low, high in zip(cuts, cuts[1:]):
        yield batch.slice(low, high - low)


def _even_share(sizes: np.ndarray, room: int) -> int:
    """The largest number of terms per scope for which all scopes fit; what small scopes leave goes to the others."""
    taken = 0
    for at, size in enumerate(np.sort(sizes)):
        left = len(sizes) - at
        if taken + size * left > room:
            return max((room - taken) // left, 1)
        taken += size
    return int(sizes.max(initial=1))


class Summary:
    """What one task holds: counts per scope and term, and how much each scope has lost."""

    def __init__(self, counters: int, overall: str | None):
        self.counters, self.overall = counters, overall
        self.held, self.waiting, self.rows_waiting = _COUNTED.empty_table(), [], 0
        self.documents: dict[str | None, int] = {}
        self.lost: dict[str | None, int] = {}

    def add(self, scopes: pa.Array, terms: pa.Array) -> None:
        for found in pc.value_counts(scopes).to_pylist():
            self.documents[found["values"]] = self.documents.get(found["values"], 0) + found["counts"]
        if self.overall is not None:
            self.documents[self.overall] = self.documents.get(self.overall, 0) + len(scopes)
        counted = _count_batch(scopes, terms, self.overall)
        self.waiting.append(counted)
        self.rows_waiting += len(counted)
        if self.rows_waiting > self.counters:
            self.settle()

    def settle(self) -> None:
        merged = pa.concat_tables([self.held, *self.waiting]).group_by(["scope", "term"])
        merged = merged.aggregate([("total", "sum"), ("df", "sum")]).select(["scope", "term", "total_sum", "df_sum"])
        self.held, self.waiting, self.rows_waiting = merged.rename_columns(_COUNTED.names), [], 0
        if len(self.held) > self.counters:
            self._cut()

    def _cut(self) -> None:
        coded = self.held["scope"].combine_chunks().dictionary_encode("encode")
        scope, total = coded.indices.to_numpy(), self.held["total"].to_numpy()
        sizes = np.bincount(scope, minlength=len(coded.dictionary))
        share = _even_share(sizes, self.counters)
        order = np.lexsort((-total, scope))
        over = np.flatnonzero(sizes > share)
        starts = np.cumsum(sizes) - sizes
        off = np.zeros(len(sizes), np.int64)
        off[over] = total[order[starts[over] + share]]
        for at in over:
            name = coded.dictionary[int(at)].as_py()
            self.lost[name] = self.lost.get(name, 0) + int(off[at])
        left = total - off[scope]
        held = self.held.set_column(2, "total", pa.array(left))
        self.held = held.filter(pa.array(left > 0))

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        held = self.held.append_column("lost", pa.array(np.zeros(len(self.held), np.int64)))
        names = list(self.documents)
        marks = [self.documents[name] for name in names]
        lost = [self.lost.get(name, 0) for name in names]
        schema = held.schema
        yield from held.to_batches(max_chunksize=50_000)
        yield pa.record_batch([names, [DOCUMENT] * len(names), marks, marks, lost], schema=schema)


def summaries(docs: DataFrame, overall: str | None = None, counters: int = COUNTERS) -> DataFrame:
    """One bounded summary per task; the row of the empty term bears the documents and the loss of a scope."""

    def summarise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(counters, overall)
        for batch in batches:
            for part in _slices(batch):
                summary.add(part.column("scope"), part.column("terms"))
        if summary.documents:
            yield from summary.rows()

    return docs.select("scope", "terms").where(F.col("terms").isNotNull()).mapInArrow(summarise, SUMMARY)


class KnownTerms:
    """Chosen terms of each scope, looked up for the terms of whole Arrow batches."""

    def __init__(self, scopes: pa.Array, terms: pa.Array):
        self.scopes, self.terms = scopes.unique(), terms.unique()
        pairs = self._keys(codes(scopes, self.scopes), codes(terms, self.terms))
        self.order = np.argsort(pairs)
        self.pairs = pairs[self.order]

    def _keys(self, scope: np.ndarray, term: np.ndarray) -> np.ndarray:
        return scope * max(len(self.terms), 1) + term

    def counted(self, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, count) of the chosen terms in rows of terms."""
        term = codes(pc.list_flatten(terms), self.terms)
        here = term >= 0
        row = pc.list_parent_indices(terms).to_numpy().astype(np.int64)[here]
        places, count = np.unique(self._keys(row, term[here]), return_counts=True)
        return *np.divmod(places, max(len(self.terms), 1)), count

    def places(self, scope: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Where the pairs stand in the order of the chosen ones, -1 for others; a scope below 0 has none."""
        asked = self._keys(scope, term)
        at = np.minimum(np.searchsorted(self.pairs, asked), max(len(self.pairs) - 1, 0))
        known = (scope >= 0) & (self.pairs[at] == asked) if len(self.pairs) else np.zeros(len(asked), bool)
        return np.where(known, at, -1)


def codes(values: pa.Array, known: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(values, value_set=known, skip_nulls=True), -1).to_numpy().astype(np.int64)


def recounted(docs: DataFrame, candidates: DataFrame, overall: str | None = None) -> DataFrame:
    """Exact total and document counts of some terms of some scopes, which travel to the texts; no other term is shuffled."""
    chosen = candidates.select("scope", "term").toArrow().combine_chunks()
    carried = docs.sparkSession.sparkContext.broadcast(chosen)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scopes, terms = (one_array(carried.value[name]) for name in ("scope", "term"))
        known = KnownTerms(scopes, terms)
        total, df = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        over = int(codes(pa.array([overall], pa.string()), known.scopes)[0])
        for batch in batches:
            for part in _slices(batch, LOOKUP_SLICE):
                row, term, times = known.counted(part.column("terms"))
                own = codes(part.column("scope"), known.scopes)[row]
                for scope in (own, np.full(len(row), over)):
                    at = known.places(scope, term)
                    found = at >= 0
                    np.add.at(total, at[found], times[found])
                    np.add.at(df, at[found], 1)
        some = np.flatnonzero(total)
        place = pa.array(known.order[some])
        columns = [scopes.take(place), terms.take(place), pa.array(total[some]), pa.array(df[some])]
        yield from pa.table(columns, schema=_COUNTED).to_batches(max_chunksize=50_000)

    rows = docs.select("scope", "terms").where(F.col("terms").isNotNull())
    found = rows.mapInArrow(count, "scope string, term string, total bigint, df bigint").groupBy("scope", "term")
    return found.agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def one_array(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def term_counts(docs: DataFrame) -> DataFrame:
    """Total count and document count of every term in every scope.

    Terms are sorted inside each row, so one explode yields both counts: every occurrence adds to
    the total, and only the first of a document to the document count. An empty term marks the
    document itself, which makes the number of documents per scope come out of the same pass.
    """
    ordered = docs.select(
        "scope", F.sort_array(F.concat(F.array(F.lit(DOCUMENT)), F.col("terms"))).alias("terms")
    )
    marked = F.transform(
        "terms",
        lambda term, at: F.struct(
            term.alias("term"),
            F.when(F.get("terms", at - 1) == term, F.lit(0)).otherwise(F.lit(1)).alias("first"),
        ),
    )
    return (
        ordered.select("scope", F.inline(marked))
        .groupBy("scope", "term")
        .agg(F.count(F.lit(1)).alias("total"), F.sum("first").alias("df"))
    )


def least_counts(counts: DataFrame, size: int) -> DataFrame:
    """How often a term must occur to be among the first ``size`` of its scope, from the number of terms of each total.

    ``full`` tells if the scope has that many terms.
    """
    sizes = counts.where(F.col("term") != DOCUMENT).groupBy("scope", "total").agg(F.count(F.lit(1)).alias("_terms"))
    upto = F.sum("_terms").over(Window.partitionBy("scope").orderBy(F.desc("total")))
    placed = sizes.withColumn("_upto", upto).where(F.col("_upto") - F.col("_terms") < size)
    return placed.groupBy("scope").agg(F.min("total").alias("least"), (F.max("_upto") >= size).alias("full"))


def frequent_terms(docs: DataFrame, size: int, overall: str | None = None, counters: int = COUNTERS) -> DataFrame:
    """Exact total and document counts of terms that hold at least the first ``size`` of every scope.

    ``docs`` has ``scope`` and ``terms``; with ``overall`` a further scope covers all documents. A document
    without a scope counts for ``overall`` only, one whose terms are null not at all. The row of the empty term
    has the number of documents.
    """
    found = summaries(docs, overall, counters).groupBy("scope", "term")
    counts = found.agg(*[F.sum(name).alias(name) for name in ("total", "df", "lost")]).where(F.col("scope").isNotNull())
    counts = materialize(counts, "term-summaries")
    exact = counts.drop("lost")
    marks = counts.where(F.col("term") == DOCUMENT).select("scope", "lost")
    if marks.where(F.col("lost") > 0).isEmpty():
        return exact
    known = F.when(F.col("lost") == 0, F.lit("exact")).when(
        F.coalesce(F.col("full") & (F.col("lost") < F.col("least")), F.lit(False)), F.lit("proved")
    )
    bounds = marks.join(least_counts(counts, size), "scope", "left")
    bounds = materialize(bounds.withColumn("kind", known.otherwise(F.lit("open"))), "term-bounds")
    kinds = {row["kind"] for row in bounds.select("kind").distinct().collect()}

    def of(kind: str) -> DataFrame:
        return bounds.where(F.col("kind") == kind).select("scope", "least", F.col("lost").alias("_lost"))

    parts = [exact.join(of("exact").select("scope"), "scope", "left_semi")]
    if "proved" in kinds:
        is_document = F.col("term") == DOCUMENT
        reaches = is_document | (F.col("total") + F.col("_lost") >= F.col("least"))
        candidates = counts.join(of("proved"), "scope").where(reaches).select("scope", "term")
        candidates = materialize(candidates, "term-candidates")
        if candidates.count() <= MAX_CARRIED:
            parts.append(exact.where(is_document).join(of("proved").select("scope"), "scope", "left_semi"))
            parts.append(recounted(docs, candidates.where(~is_document), overall))
        else:
            # Spark moves this semi join below the aggregation when the candidates can be broadcast, and counts first if not.
            parts.append(term_counts(_scoped(docs, overall)).join(candidates, ["scope", "term"], "left_semi"))
    if "open" in kinds:
        parts.append(term_counts(_scoped(docs, overall).join(of("open").select("scope"), "scope", "left_semi")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return materialize(whole, "term-counts")


def _scoped(docs: DataFrame, overall: str | None) -> DataFrame:
    """Every document in its own scope and, if asked for, in the one over all."""
    scopes: Column = F.array("scope") if overall is None else F.array("scope", F.lit(overall))
    return docs.select(F.explode(scopes).alias("scope"), "terms").where(F.col("scope").isNotNull())
