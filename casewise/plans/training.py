"""Training job: split, fit, predict, evaluate and store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.config import CasewiseError, TextOptions, TrainOptions
from casewise.operators import evaluate
from casewise.operators.hierarchy import HierarchyModel, train_hierarchy
from casewise.operators.prepare import modeling_table
from casewise.operators.similar import HistoryIndex
from casewise.operators.split import Split, train_test_split
from casewise.session import materialize
from casewise.sources.model_store import save_model
from casewise.sources.records import require_columns


@dataclass
class TrainingResult:
    model: HierarchyModel
    split: Split
    predictions: DataFrame
    reports: dict[str, DataFrame]
    metadata: dict
    paths: dict[str, str]


def predict_test(model: HierarchyModel, test: DataFrame) -> DataFrame:
    """Test predictions of all three levels, as evaluation rows."""
    rows = model.with_terms(test.withColumn("id", F.col("id_registro")))
    scored = model.predict_macro(rows, "_macro")
    scored = model.predict_detailed(scored, "_macro", "_detail")
    scored = model.predict_detailed(scored, "classe_macro", "_oracle")

    def pair(level: str, expected: str, predicted: str):
        return F.struct(
            F.lit(level).alias("level"), F.col(expected).alias("expected"), F.col(predicted).alias("predicted")
        )

    levels = F.array(
        pair(evaluate.MACRO, "classe_macro", "_macro"),
        pair(evaluate.DETAILED, "classe_detalhada", "_detail"),
        pair(evaluate.DETAILED_ORACLE, "classe_detalhada", "_oracle"),
    )
    return scored.select("id_registro", F.col(model.options.original_column).alias("texto"), F.inline(levels))


def train_job(
    records: DataFrame,
    folder: str | None = None,
    options: TextOptions | None = None,
    settings: TrainOptions | None = None,
    dataset: dict | None = None,
    keep_history: bool = False,
) -> TrainingResult:
    """The whole training job; the model is stored when a folder is given.

    With ``keep_history`` an index of the same records is stored with the model, for scoring against exactly the
    history that the model was trained on. ``dataset`` (source, batch) says in the metadata which that was.
    """
    options, settings = options or TextOptions(), settings or TrainOptions()
    require_columns(records)
    columns = ["id_registro", "classe_macro", "classe_detalhada", options.original_column, options.processed_column]
    modeling = materialize(modeling_table(records, options).select(*columns), "modeling")
    if modeling.isEmpty():
        raise CasewiseError("Não há registros válidos após o pré-processamento para treinar o baseline.")
    split = train_test_split(modeling, "classe_macro", settings.test_size, settings.seed)
    split.table = materialize(split.table, "split", partition_by="split")
    model = train_hierarchy(split.train, options, settings)

    predictions = materialize(predict_test(model, split.test), "predictions")
    counts = materialize(evaluate.confusion_counts(predictions), "confusion")
    metrics = evaluate.weighted_metrics(counts)
    report = evaluate.class_report(counts)
    reports = {
        "metrics": metrics,
        "class_report": report,
        "confusion_matrix": evaluate.confusion_matrix(counts),
        "examples": evaluate.prediction_examples(predictions),
        "error_propagation": evaluate.error_propagation(metrics),
        "risk_classes": evaluate.risk_classes(report),
        "taxonomy": model.taxonomy,
    }
    spark = records.sparkSession
    metadata = {
        "trained_at": spark.range(1).select(F.current_timestamp().cast("string")).first()[0],
        "dataset": dataset or {},
        "test_size": settings.test_size,
        "random_state": settings.seed,
        "split": {
            "train_size": split.train_size,
            "test_size": split.test_size,
            "stratified": split.stratified,
            "warnings": split.warnings,
        },
        "metrics": {row["level"]: row.asDict() for row in metrics.collect()},
        "steps": options.active_steps(),
    }
    history = HistoryIndex.build(records, options) if folder and keep_history else None
    paths = save_model(model, folder, metadata, history) if folder else {}
    return TrainingResult(model, split, predictions, reports, metadata, paths)
