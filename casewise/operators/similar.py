"""Similar past cases: TF-IDF cosine top-k against a history of any size.

The history is never joined to the queries pair by pair. It is cut into blocks of postings (see
``postings``), each block that a query can't rule out keeps only its best ``k`` distinct cases for it, and
a window picks the final ``k``. That is exact: a case that is among the best overall is among the best of its
block, and no bound on a skipped block or term reaches the k-th score known by then.
"""

from __future__ import annotations

import json
import math
from functools import cached_property, reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewise.config import HISTORY_FEATURES, TOP_K, CasewiseError, TextOptions
from casewise.functions.labels import history_priority
from casewise.functions.numbers import percent, round_exact
from casewise.functions.text import strip, stripped_or_blank
from casewise.operators.postings import (
    CASE_KEY,
    QueryVectors,
    build_blocks,
    match_carried,
)
from casewise.operators.prepare import modeling_table, prepare_texts
from casewise.operators.tfidf import (
    EVERYTHING,
    MAX_ENTRIES,
    TermSpace,
    fit_vocabulary,
    macro_scope,
    vector_tokens,
    vectorize,
    with_term_pairs,
)
from casewise.session import materialize

# Bytes of query vectors a broadcast may carry; more travel in waves.
MAX_BROADCAST_BYTES = 64 << 20
# History rows that a task searches at a time, and queries that a wave has at least.
GRID_HISTORY_ROWS = 20_000
GRID_QUERY_ROWS = 5_000


def known_macros(records: DataFrame) -> DataFrame:
    """Macro classes that occur in the history, as a written table of a few rows."""
    macros = records.select(stripped_or_blank(F.col("classe_macro")).alias("_macro")).distinct()
    return materialize(macros, "history-macros")


def retrieval_scope(queries: DataFrame, macros: DataFrame, restrict_to_macro: bool = True) -> DataFrame:
    """Add the history scope of each query: its macro where the history knows it, else global.

    The macro only has to occur in the history; whether its records are usable comes later.
    """
    if not restrict_to_macro:
        return queries.withColumn("scope", F.lit("global"))
    wanted = queries.withColumn("_macro", stripped_or_blank(F.col("macro")))
    return (
        wanted.join(macros.withColumn("scope", F.lit("macro")), "_macro", "left")
        .withColumn("scope", F.coalesce("scope", F.lit("global")))
        .drop("_macro")
    )


def history_table(records: DataFrame, options: TextOptions | None = None) -> DataFrame:
    """The usable history: processed text, what a match shows, and a signature equal for repeated cases.

    Records are told apart by ``history_key``, not by their ids, which may repeat or be null.
    """
    options = options or TextOptions()
    usable = modeling_table(records, options)
    signature = F.concat(
        *[F.md5(strip(F.col(name))) for name in (options.original_column, "classe_macro", "classe_detalhada")]
    )
    return usable.select(
        F.col("id_registro").alias("history_id"),
        F.coalesce(F.col("id_registro").try_cast("bigint"), F.lit((1 << 63) - 1)).alias("number"),
        F.md5(signature).alias("signature"),
        macro_scope(F.col("classe_macro")).alias("scope"),
        F.col(options.processed_column).alias("processed"),
        F.monotonically_increasing_id().alias("history_key"),
        F.col(options.original_column).alias("text"),
        F.col("classe_macro").alias("macro_class"),
        F.col("classe_detalhada").alias("detailed_class"),
    )


def fit_history(history: DataFrame, max_features: int = HISTORY_FEATURES) -> DataFrame:
    """Vocabulary of every macro scope and of the whole history."""
    return _fit_words(history_words(history), max_features)


def history_words(history: DataFrame) -> DataFrame:
    """The history's words, one string a case, as a written table: cut out once, for the vocabulary and all vectors."""
    words = F.array_join(vector_tokens(F.col("processed")), " ")
    cases = history.select("history_id", "number", "signature", "scope", "history_key", words.alias("words"))
    return materialize(cases, "history-words")


def _fit_words(words: DataFrame, max_features: int) -> DataFrame:
    return fit_vocabulary(_word_terms(words).select("scope", "terms"), max_features, EVERYTHING)


def _word_terms(rows: DataFrame) -> DataFrame:
    """The terms of words that are joined by spaces."""
    none = F.array().cast("array<string>")
    split = F.when(F.col("words") == "", none).otherwise(F.split("words", " "))
    return with_term_pairs(rows.withColumn("_words", split), "_words", "terms").drop("_words", "words")


def _best(found: DataFrame, k: int) -> DataFrame:
    """Merge the matches of all tasks: the first ``k`` per query."""
    place = Window.partitionBy(CASE_KEY).orderBy(F.desc("score"), F.asc("number"), F.asc("history_id"), F.asc("signature"))
    return (
        found.withColumn("rank", F.row_number().over(place))
        .where(F.col("rank") <= k)
        .select(CASE_KEY, "rank", "history_key", "history_id", "score")
    )


def _match_wave(queries: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Queries that travel to the history blocks; the history is never shuffled."""
    carried = queries.sparkSession.sparkContext.broadcast(QueryVectors.by_scope(queries.toArrow().to_pandas()))
    return _best(match_carried(blocks, carried, k, GRID_HISTORY_ROWS), k)


def _match_waves(queries: DataFrame, blocks: DataFrame, k: int, waves: int) -> DataFrame:
    """Many queries: one wave after the other, so neither side is ever copied for the other."""
    numbered = queries.withColumn("wave", F.pmod(F.xxhash64(CASE_KEY), F.lit(waves)).cast("int"))
    cut = materialize(numbered, "query-waves", partition_by="wave")
    found = [
        materialize(_match_wave(cut.where(F.col("wave") == wave).drop("wave"), blocks, k), "wave-matches")
        for wave in range(waves)
    ]
    return reduce(DataFrame.unionByName, found)


def similar_cases(
    queries: DataFrame,
    records: DataFrame,
    k: int = TOP_K,
    options: TextOptions | None = None,
    restrict_to_macro: bool = True,
    max_features: int = HISTORY_FEATURES,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Similar past cases of each query, one row per case.

    ``queries`` has id, texto and macro (the predicted class). Queries that are blank, before or
    after preprocessing, and scopes without usable history give no rows. Queries that share an id,
    or have none, are searched each on its own.
    """
    options = options or TextOptions()
    index = HistoryIndex.build(records, options, max_features)
    return index.search(queries, k, restrict_to_macro, max_broadcast_bytes).drop(CASE_KEY)


class HistoryIndex:
    """A prepared history: processed cases, vocabularies and vectors as written tables.

    It is built once and searched any number of times, by every micro-batch of a stream for one;
    a search then reads vectors and never touches the texts before the final matches.
    """

    def __init__(
        self, history: DataFrame, vocabulary: DataFrame, macros: DataFrame, options: TextOptions
    ):
        self.history = history
        self.vocabulary = vocabulary
        self.macros = macros
        self.options = options

    @classmethod
    def build(
        cls, records: DataFrame, options: TextOptions | None = None, max_features: int = HISTORY_FEATURES
    ) -> "HistoryIndex":
        options = options or TextOptions()
        history = materialize(history_table(records, options), "history")
        words = history_words(history)
        vocabulary = materialize(_fit_words(words, max_features), "history-vocabulary")
        index = cls(history, vocabulary, known_macros(records), options)
        index._words = words
        return index

    def save(self, folder: str) -> None:
        """Write the history, its vocabulary and its options, to be searched by :meth:`load` without the records."""
        root = folder.rstrip("/")
        self.history.write.mode("errorifexists").parquet(f"{root}/history")
        self.vocabulary.write.mode("errorifexists").parquet(f"{root}/vocabulary")
        self.macros.write.mode("errorifexists").parquet(f"{root}/macros")
        document = json.dumps(self.options.to_dict(), ensure_ascii=False)
        options = self.history.sparkSession.createDataFrame([(document,)], "document string")
        options.write.mode("errorifexists").parquet(f"{root}/options")  # written last: it marks a complete index

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> "HistoryIndex":
        root = folder.rstrip("/")
        try:
            document = spark.read.parquet(f"{root}/options").first()["document"]
        except AnalysisException as error:
            raise CasewiseError(f"O histórico ainda não foi gerado em '{folder}'.") from error
        history, vocabulary, macros = (spark.read.parquet(f"{root}/{part}") for part in ("history", "vocabulary", "macros"))
        return cls(history, vocabulary, macros, TextOptions.from_dict(json.loads(document)))

    @cached_property
    def _space(self) -> TermSpace | None:
        return TermSpace(self.vocabulary) if self.vocabulary.count() <= MAX_ENTRIES else None

    def _vectors(self, docs: DataFrame) -> DataFrame:
        rows = _word_terms(docs)
        if self._space is not None:
            return self._space.vectorize(rows).drop("terms")
        return vectorize(rows, self.vocabulary, max_entries=0).drop("terms")

    def prepare(self) -> None:
        """Make the vectors of both scopes now, for searches that follow."""
        _ = self._space, self._macro_blocks, self._all_blocks

    @cached_property
    def _words(self) -> DataFrame:
        return history_words(self.history)

    @cached_property
    def _cases(self) -> DataFrame:
        """Words of the distinct cases: of repeated ones, which have one text and class, the first."""
        first = F.min_by("history_key", F.struct("number", "history_id", "history_key")).alias("history_key")
        chosen = materialize(self._words.groupBy("signature").agg(first).select("history_key"), "distinct-cases")
        return self._words.join(chosen, "history_key", "left_semi")

    @cached_property
    def _macro_blocks(self) -> DataFrame:
        return build_blocks(self._vectors(self._cases))

    @cached_property
    def _all_blocks(self) -> DataFrame:
        """Blocks of the global scope, made when the first query asks for them."""
        return build_blocks(self._vectors(self._cases.withColumn("scope", F.lit(EVERYTHING))))

    def match(self, queries: DataFrame, k: int = TOP_K, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
        """Best ``k`` distinct history cases per query, as (case_key, rank, history_key, history_id, score).

        ``queries`` has case_key, scope (``macro``/``global``), macro and processed. Cases with no term in
        common count with score 0, so a query gets ``min(k, distinct cases in scope)`` rows.
        """
        in_macro = F.col("scope") == "macro"
        scoped = queries.select(
            CASE_KEY,
            F.when(in_macro, macro_scope(stripped_or_blank(F.col("macro")))).otherwise(F.lit(EVERYTHING)).alias("scope"),
            F.array_join(vector_tokens(F.col("processed")), " ").alias("words"),
        )
        asked = materialize(self._vectors(scoped), "query-vectors")
        scopes = materialize(asked.select("scope").distinct(), "query-scopes")
        # Only the blocks of the scopes asked for are made and read.
        everywhere = F.col("scope") == EVERYTHING
        of = scopes.agg(F.max(everywhere).alias("all"), F.max(~everywhere).alias("own")).first()
        parts = [self._all_blocks] if of["all"] else []
        if of["own"] or not parts:
            parts.append(self._macro_blocks)
        blocks = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        blocks = blocks.join(scopes, "scope", "left_semi")
        size, rows = asked.agg(F.sum(F.size("idx") * 12 + 64), F.count(F.lit(1))).first()
        waves = math.ceil(min((size or 0) / max(1, max_broadcast_bytes), rows / GRID_QUERY_ROWS))
        return _match_wave(asked, blocks, k) if waves <= 1 else _match_waves(asked, blocks, k, waves)

    def search(
        self,
        queries: DataFrame,
        k: int = TOP_K,
        restrict_to_macro: bool = True,
        max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    ) -> DataFrame:
        """Similar past cases of each query (id, texto, macro), one row per case.

        A query is known by its ``case_key`` where it brings one, else by its row.
        """
        options = self.options
        key = F.col(CASE_KEY) if CASE_KEY in queries.columns else F.monotonically_increasing_id()
        keyed = queries.select("id", "texto", "macro", key.cast("bigint").alias(CASE_KEY))
        scoped = retrieval_scope(keyed, self.macros, restrict_to_macro)
        asked = (
            prepare_texts(scoped.withColumnRenamed("texto", options.source_column), options)
            .select("id", CASE_KEY, "scope", "macro", F.col(options.processed_column).alias("processed"))
            .where(F.col("processed") != "")
        )
        asked = materialize(asked, "queries")
        matches = self.match(asked, k, max_broadcast_bytes).join(asked.select("id", CASE_KEY, "scope"), CASE_KEY)
        return describe_matches(materialize(matches, "matches"), self.history)


def describe_matches(matches: DataFrame, history: DataFrame) -> DataFrame:
    """Join the matched cases to their texts, by the key of the history's row.

    The written matches are small next to the history. The texts are first reduced to the keys that
    were matched, so no more than those is shuffled when the matches are too many to broadcast.
    """
    texts = history.select("history_key", "text", "macro_class", "detailed_class")
    texts = texts.join(matches.select("history_key").distinct(), "history_key", "left_semi")
    described = matches.join(texts, "history_key")
    similarity = round_exact(F.col("score"), 4)
    return described.select(
        "id",
        CASE_KEY,
        "scope",
        "rank",
        "history_id",
        "text",
        "macro_class",
        "detailed_class",
        similarity.alias("similarity"),
        percent(similarity).alias("similarity_percent"),
    )


def few_shot_examples(cases: DataFrame) -> DataFrame:
    """Similar cases as one ordered array of few-shot structs per query (at most ``k`` each).

    Queries are told apart by ``case_key`` where there is one, else by id.
    """
    example = F.struct(
        "rank",
        "text",
        "macro_class",
        "detailed_class",
        F.concat(
            F.lit("Caso historico com similaridade TF-IDF de "),
            F.col("similarity_percent"),
            F.lit(" em relacao ao texto atual."),
        ).alias("justification"),
        history_priority(F.col("text")).alias("priority"),
        F.lit(False).alias("ambiguous_case"),
        "similarity",
        "similarity_percent",
    )
    keys = ["id", CASE_KEY] if CASE_KEY in cases.columns else ["id"]
    return cases.groupBy(*keys).agg(
        F.first("scope").alias("scope"),
        F.count(F.lit(1)).alias("used_count"),
        F.sort_array(F.collect_list(example)).alias("few_shot_examples"),
    )
