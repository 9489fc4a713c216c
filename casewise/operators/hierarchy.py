"""Two-level classifier: macro class, then detailed class inside the macro."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewise.config import CasewiseError, TextOptions, TrainOptions
from casewise.operators.linear import LinearScorer
from casewise.operators.solver import fit_models
from casewise.operators.tfidf import (
    EVERYTHING,
    MAX_ENTRIES,
    TermSpace,
    fit_vocabulary,
    macro_scope,
    vectorize,
    with_terms,
)
from casewise.session import materialize

MACRO_MODEL = "macro"
GLOBAL_DETAIL_MODEL = "detail:all"


def taxonomy(train: DataFrame) -> DataFrame:
    """Records, detail count and sorted detailed classes of each macro class."""
    pairs = (
        train.where(F.col("classe_detalhada") != "")
        .groupBy("classe_macro", "classe_detalhada")
        .agg(F.count(F.lit(1)).alias("records"))
    )
    return pairs.groupBy(F.col("classe_macro").alias("macro_class")).agg(
        F.sum("records").alias("record_count"),
        F.count(F.lit(1)).alias("detail_count"),
        F.sort_array(F.collect_list("classe_detalhada")).alias("detail_options"),
    )


def fallback_label(train: DataFrame) -> DataFrame:
    """Most frequent detailed class, the first label winning ties (one row)."""
    sizes = train.groupBy(F.col("classe_detalhada").alias("label")).agg(F.count(F.lit(1)).alias("records"))
    return sizes.orderBy(F.desc("records"), "label").limit(1)


def valid_details(predicted: DataFrame, taxonomy_table: DataFrame, macro: str = "macro") -> DataFrame:
    """Add the detailed classes allowed for the predicted macro; null where the macro is unknown.

    The taxonomy is a written table of a few rows, so its size decides on a broadcast.
    """
    options = taxonomy_table.select(F.col("macro_class").alias(macro), F.col("detail_options").alias("valid_classes"))
    return predicted.join(options, macro, "left")


@dataclass
class HierarchyModel:
    """Fitted vocabularies and linear models of both levels, as tables."""

    vocabulary: DataFrame
    macro_linear: DataFrame
    detailed_linear: DataFrame
    taxonomy: DataFrame
    fallback: str
    options: TextOptions

    @cached_property
    def _space(self) -> TermSpace | None:
        return TermSpace(self.vocabulary) if self.vocabulary.count() <= MAX_ENTRIES else None

    @cached_property
    def _macro(self) -> LinearScorer:
        return LinearScorer(self.macro_linear)

    @cached_property
    def _detailed(self) -> LinearScorer:
        return LinearScorer(self.detailed_linear)

    def with_terms(self, cases: DataFrame) -> DataFrame:
        """Add the vectoriser's terms; predictions work them out themselves where they are missing."""
        return with_terms(cases, self.options.processed_column)

    def _predict(
        self, cases: DataFrame, scorer: LinearScorer, scope: Column, model: Column, label: str, probability: str | None
    ) -> DataFrame:
        given = "terms" in cases.columns
        rows = (cases if given else self.with_terms(cases)).withColumns({"scope": scope, "model": model})
        if self._space is not None:
            vectors = self._space.vectorize(rows)
        else:
            vectors = vectorize(rows, self.vocabulary, max_entries=0)
        scored = scorer.predict(vectors, label, probability)
        return scored.drop("scope", *([] if given else ["terms"]))

    def predict_macro(self, cases: DataFrame, label: str = "macro", confidence: str | None = None) -> DataFrame:
        """Add the macro class; ``cases`` has id and the processed text."""
        return self._predict(cases, self._macro, F.lit(EVERYTHING), F.lit(MACRO_MODEL), label, confidence)

    def predict_detailed(
        self, cases: DataFrame, macro: str = "macro", label: str = "detail", use_macro_filter: bool = True
    ) -> DataFrame:
        """Add the detailed class given a macro column, in one pass over all macros.

        A macro without a model of its own goes to the global model, as does every row when
        ``use_macro_filter`` is off.
        """
        scope, model = F.lit(EVERYTHING), F.lit(GLOBAL_DETAIL_MODEL)
        if use_macro_filter:
            own = F.concat(F.lit("detail:"), macro_scope(F.col(macro)))
            known = own.isin(sorted(self._detailed.names - {GLOBAL_DETAIL_MODEL}))
            scope = F.when(known, macro_scope(F.col(macro))).otherwise(scope)
            model = F.when(known, own).otherwise(model)
        scored = self._predict(cases, self._detailed, scope, model, label, None)
        return scored.withColumn(label, F.coalesce(F.col(label), F.lit(self.fallback)))


def train_hierarchy(
    train: DataFrame, options: TextOptions | None = None, settings: TrainOptions | None = None
) -> HierarchyModel:
    """Fit the macro model, one detailed model per macro and the global detailed model.

    All vocabularies are fitted in one job, all vectors are written once, and all models are fitted together,
    in a number of jobs that does not grow with the macros.
    """
    options, settings = options or TextOptions(), settings or TrainOptions()
    docs = with_terms(
        train.select(
            F.col("id_registro").alias("id"),
            macro_scope(F.col("classe_macro")).alias("scope"),
            "classe_macro",
            "classe_detalhada",
            options.processed_column,
        ),
        options.processed_column,
    ).drop(options.processed_column)
    docs = materialize(docs, "terms")  # tokenised once, for the vocabularies and the vectors of both scopes
    vocabulary = materialize(
        fit_vocabulary(docs.select("scope", "terms"), settings.max_features, EVERYTHING), "vocabulary"
    )
    classes = materialize(taxonomy(train), "taxonomy")
    if classes.isEmpty():
        raise CasewiseError("Não foi possível treinar a camada detalhada com o dataset atual.")
    both = docs.withColumn("scope", F.explode(F.array("scope", F.lit(EVERYTHING))))
    vectors = materialize(vectorize(both, vocabulary).drop("terms"), "vectors")
    linear = fit_models(_examples(vectors, vocabulary), settings)
    return HierarchyModel(
        vocabulary=vocabulary,
        macro_linear=linear.where(F.col("model") == MACRO_MODEL),
        detailed_linear=linear.where(F.col("model") != MACRO_MODEL),
        taxonomy=classes,
        fallback=fallback_label(train).first()["label"],
        options=options,
    )


def _examples(vectors: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """What each vector is an example of: its macro and its detail over all macros, or its detail inside its macro."""

    def example(model: Column, label: str) -> Column:
        return F.struct(model.alias("model"), F.col(label).alias("label"))

    shared = F.array(
        example(F.lit(MACRO_MODEL), "classe_macro"), example(F.lit(GLOBAL_DETAIL_MODEL), "classe_detalhada")
    )
    own = F.array(example(F.concat(F.lit("detail:"), F.col("scope")), "classe_detalhada"))
    blank = (F.col("scope") != EVERYTHING) & (F.col("classe_detalhada") == "")
    dimensions = vocabulary.groupBy("scope").agg(F.max("place").alias("dimension"))
    return (
        vectors.where(~F.coalesce(blank, F.lit(False)))
        .join(dimensions, "scope", "left")
        .withColumn("dimension", F.coalesce("dimension", F.lit(1)))
        .select("dimension", "idx", "weight", F.inline(F.when(F.col("scope") == EVERYTHING, shared).otherwise(own)))
    )
