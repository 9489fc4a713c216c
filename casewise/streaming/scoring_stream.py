"""Scoring texts as they arrive."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from casewise.config import TOP_K
from casewise.operators.hierarchy import HierarchyModel
from casewise.operators.refine import KEYWORDS
from casewise.operators.similar import HistoryIndex
from casewise.plans.scoring import score_batch
from casewise.session import temporary_tables

CASE_SCHEMA = "id string, texto string, canal_origem string"


def read_case_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """New CSV files of a folder as a stream; columns are matched by header name."""
    reader = spark.readStream.schema(CASE_SCHEMA).option("header", True).option("multiLine", True)
    reader = reader.option("escape", '"').option("enforceSchema", False)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.csv(folder)


def score_stream(
    cases: DataFrame,
    model: HierarchyModel,
    index: HistoryIndex | None,
    target: str,
    checkpoint: str,
    requested_provider: str = "mock",
    responses: DataFrame | None = None,
    k: int = TOP_K,
    keywords: Mapping[str, Sequence[str]] = KEYWORDS,
    processing_time: str | None = None,
) -> StreamingQuery:
    """Score a stream of cases into Parquet, with the options of :func:`score_batch`.

    By default the stream ends when the available input is used up; with ``processing_time`` (such as
    ``"1 minute"``) it runs on and takes new input at that interval.

    Grouping for top-k would need unbounded state on a stream, so each micro-batch is scored as
    a plain table against the static model and history. A replayed batch overwrites its own
    folder, which makes the output exactly-once. What a micro-batch wrote in between is removed once its
    output is there.
    """
    if index is not None:
        index.prepare()  # its vectors outlive the micro-batches

    def write(batch: DataFrame, batch_id: int) -> None:
        with temporary_tables(batch.sparkSession):
            scored, rejected = score_batch(batch, model, index, responses, requested_provider, k, keywords)
            scored.write.mode("overwrite").parquet(f"{target}/scored/batch_id={batch_id}")
            rejected.write.mode("overwrite").parquet(f"{target}/rejected/batch_id={batch_id}")

    trigger = {"processingTime": processing_time} if processing_time else {"availableNow": True}
    return cases.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
