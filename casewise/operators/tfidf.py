"""TF-IDF vocabularies and weights, fitted separately per scope.

A *scope* is the set of documents a vocabulary is fitted on: all of them, or one macro class.
Every table carries its scope, so any number of vocabularies is fitted in one job.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewise.functions.text import WORD, with_once
from casewise.functions.unicode import strip_accents
from casewise.operators.frequent import (
    COUNTERS,
    DOCUMENT,
    LOOKUP_SLICE,
    KnownTerms,
    _slices,
    codes,
    frequent_terms,
    least_counts,
    one_array,
)
from casewise.session import materialize

EVERYTHING = "all"
_ROW = "_row_key"
_VECTOR = pa.struct([("idx", pa.list_(pa.int32())), ("weight", pa.list_(pa.float64()))])

# Vocabulary entries the driver may hold; larger vocabularies are joined instead.
MAX_ENTRIES = 500_000
# First-level groups when ranking the terms that are frequent enough, in case very many are equally frequent.
RANK_SALTS = 64


def macro_scope(macro: Column) -> Column:
    return F.concat(F.lit("macro:"), macro)


def vector_tokens(text: Column) -> Column:
    """Lowercase, unaccented runs of at least two word characters."""
    return F.regexp_extract_all(strip_accents(F.lower(text)), F.lit(rf"[{WORD}]{{2,}}"), F.lit(0))


def with_ngrams(tokens: Column) -> Column:
    """Tokens followed by the pairs of neighbouring tokens."""
    pairs = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.concat(
        tokens,
        F.zip_with(
            F.slice(tokens, F.lit(1), pairs),
            F.slice(tokens, F.lit(2), pairs),
            lambda left, right: F.concat(left, F.lit(" "), right),
        ),
    )


def with_terms(docs: DataFrame, text_column: str, output: str = "terms") -> DataFrame:
    """Add the vectoriser's terms of a text column."""
    return with_term_pairs(with_once(docs, output, vector_tokens(F.col(text_column))), output)


def with_term_pairs(docs: DataFrame, tokens_column: str, output: str | None = None) -> DataFrame:
    """Add the vectoriser's terms of a column of tokens."""
    return with_once(docs, output or tokens_column, with_ngrams(F.col(tokens_column)))


def fit_vocabulary(
    docs: DataFrame, max_features: int, overall: str | None = None, counters: int = COUNTERS
) -> DataFrame:
    """The ``max_features`` most frequent terms per scope, with their idf; ties go by term.

    ``docs`` has ``scope`` and ``terms``. With ``overall``, a further scope over all documents comes from the
    same pass over the texts. ``counters`` bounds what a task counts with and hands on, never the result.
    """
    counts = frequent_terms(docs, max_features, overall, counters)
    is_document = F.col("term") == DOCUMENT
    bounds = materialize(least_counts(counts, max_features).drop("full"), "term-bounds")
    enough = counts.join(bounds, "scope").where(is_document | (F.col("total") >= F.col("least"))).drop("least")
    order = [F.desc(is_document), F.desc("total"), F.asc("term")]
    salted = enough.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(RANK_SALTS)))
    # Very many terms may share the least total. A term among the first N of its scope is among the first N
    # of its salt as well. The row that counts the documents sorts first, so both levels keep it.
    by_salt = Window.partitionBy("scope", "salt").orderBy(*order)
    shortlist = salted.withColumn("place", F.row_number().over(by_salt)).where(F.col("place") <= max_features + 1)
    by_scope = Window.partitionBy("scope").orderBy(*order)
    ranked = shortlist.withColumns(
        {"place": F.row_number().over(by_scope) - 1, "n": F.first("total").over(by_scope)}
    ).where((F.col("place") <= max_features) & ~is_document)
    return ranked.select(
        "scope", "term", "place", "total", "df", "n", idf(F.col("n"), F.col("df")).alias("idf")
    )


def idf(documents: Column, containing: Column) -> Column:
    """Smoothed inverse document frequency plus one."""
    return F.log((F.lit(1.0) + documents) / (F.lit(1.0) + containing)) + F.lit(1.0)


def damped(count: Column, sublinear: bool) -> Column:
    return F.lit(1.0) + F.log(count) if sublinear else count.cast("double")


def weights_long(
    docs: DataFrame, vocabulary: DataFrame, id_column: str = "id", sublinear: bool = True
) -> DataFrame:
    """L2-normalised weights as (document, scope, term, place, weight) rows.

    The relational form: term counts joined to the vocabulary on (scope, term). It needs nothing
    on the driver, at the price of a shuffle of the postings by document.
    """
    counted = (
        docs.select(id_column, "scope", F.explode("terms").alias("term"))
        .groupBy(id_column, "scope", "term")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    known = counted.join(vocabulary.select("scope", "term", "place", "idf"), ["scope", "term"])
    raw = known.withColumn("weight", damped(F.col("count"), sublinear) * F.col("idf"))
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(id_column, "scope")))
    return raw.select(id_column, "scope", "term", "place", (F.col("weight") / length).alias("weight"))


class TermSpace:
    """Turns terms into sparse TF-IDF vectors inside each row, without a shuffle.

    The vocabularies of all scopes travel to the tasks as one table, in which the terms of whole Arrow batches are
    looked up. Its size is bounded by ``scopes x max_features``, which is checked before it is used.
    """

    def __init__(self, vocabulary: DataFrame):
        entries = vocabulary.select("scope", "term", "place", "idf").toArrow()
        self._tables = vocabulary.sparkSession.sparkContext.broadcast(entries) if len(entries) else None

    def _weigh(self, sublinear: bool):
        tables, opened = self._tables, []

        @F.arrow_udf("idx array<int>, weight array<double>")
        def weigh(scopes: pa.Array, terms: pa.Array) -> pa.Array:
            if not opened:
                columns = {name: one_array(tables.value[name]) for name in ("scope", "term", "place", "idf")}
                known = KnownTerms(columns["scope"], columns["term"])
                place_of = columns["place"].to_numpy().astype(np.int32)[known.order] - 1
                opened.append((known, place_of, columns["idf"].to_numpy()[known.order]))
            known, place_of, idf_of = opened[0]
            parts = [pa.array([], _VECTOR)]
            for part in _slices(pa.record_batch([scopes, terms], ["scope", "terms"]), LOOKUP_SLICE):
                row, term, count = known.counted(part.column("terms"))
                entry = known.places(codes(part.column("scope"), known.scopes)[row], term)
                inside = entry >= 0
                row, entry, count = row[inside], entry[inside], count[inside]
                weight = (1.0 + np.log(count) if sublinear else count) * idf_of[entry]
                length = np.sqrt(np.bincount(row, weights=weight * weight, minlength=part.num_rows))
                place = place_of[entry]
                order = np.lexsort((place, row))
                ends = np.cumsum(np.bincount(row, minlength=part.num_rows))
                offsets = pa.array(np.append(0, ends).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v[order])) for v in (place, weight / length[row])]
                parts.append(pa.StructArray.from_arrays(lists, ["idx", "weight"]).cast(_VECTOR))
            return pa.concat_arrays(parts)

        return weigh

    def vectorize(self, docs: DataFrame, sublinear: bool = True) -> DataFrame:
        """Add ``idx`` and ``weight``; a row without known terms gets empty arrays."""
        if self._tables is None:
            return docs.withColumns(
                {"idx": F.array().cast("array<int>"), "weight": F.array().cast("array<double>")}
            )
        weighed = docs.withColumn("_vector", self._weigh(sublinear)("scope", "terms"))
        return weighed.select(*docs.columns, "_vector.idx", "_vector.weight")


def vectorize(
    docs: DataFrame, vocabulary: DataFrame, sublinear: bool = True, max_entries: int = MAX_ENTRIES
) -> DataFrame:
    """Sparse vectors of ``docs``, by lookup for a vocabulary of bounded size, else by join.

    ``vocabulary`` should be a written table: it is counted, then read again. Both ways give every row
    its own vector: the join goes by a row key of its own, so ids may repeat or be null.
    """
    if vocabulary.count() <= max_entries:
        return TermSpace(vocabulary).vectorize(docs, sublinear)
    columns = docs.columns
    docs = materialize(docs.withColumn(_ROW, F.monotonically_increasing_id()), "vector-rows")
    long = weights_long(docs, vocabulary, _ROW, sublinear)
    vectors = long.groupBy(_ROW).agg(
        F.sort_array(F.collect_list(F.struct((F.col("place") - 1).alias("place"), "weight"))).alias("_raw")
    )
    empty = F.array().cast("array<struct<place:int,weight:double>>")
    raw = F.coalesce("_raw", empty)
    return docs.join(vectors, _ROW, "left").select(*columns, raw["place"].alias("idx"), raw["weight"].alias("weight"))


def explode_vectors(vectors: DataFrame, id_column: str = "id") -> DataFrame:
    """Vectors as (document, scope, place, weight) rows."""
    pairs = F.arrays_zip("idx", "weight")
    return vectors.select(id_column, "scope", F.inline(pairs)).select(
        id_column, "scope", (F.col("idx") + 1).alias("place"), "weight"
    )

