"""Mergeable sketches of the label columns: approximate distinct counts that never read old batches again.

A HyperLogLog sketch of 2**12 registers takes about 4 KB whatever the number of values. Sketches of batches unite to
the sketch of all their rows, so an overview of a landing zone reads one small row per batch. The standard
error is 1.04 / 64 (1.6 %); below some hundred values counts are exact.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = ("classe_macro", "classe_detalhada", "canal_origem")
REGISTERS_LOG2 = 12


def _marked(name: str) -> Column:
    """The value behind a mark: the sketch would leave out empty strings. Nulls don't count, as in an exact count."""
    return F.concat(F.lit("="), F.col(name))


def sketch_labels(records: DataFrame, *by: str) -> DataFrame:
    """Rows and one sketch per label column, over all ``records`` or for each group of ``by``."""
    sketches = [F.hll_sketch_agg(_marked(name), F.lit(REGISTERS_LOG2)).alias(name) for name in LABELS]
    return records.groupBy(*by).agg(F.count(F.lit(1)).alias("total_registros"), *sketches)


def unite(sketches: DataFrame) -> DataFrame:
    """The sketch row of the union of the rows that ``sketches`` stand for."""
    return sketches.agg(
        F.coalesce(F.sum("total_registros"), F.lit(0)).alias("total_registros"),
        *[F.hll_union_agg(name).alias(name) for name in LABELS],
    )


def estimates(united: DataFrame) -> DataFrame:
    """Rows and estimated distinct labels of a sketch row."""
    counted = [F.coalesce(F.hll_sketch_estimate(name), F.lit(0)).cast("bigint").alias(name) for name in LABELS]
    return united.select("total_registros", *counted)


def folder_of(landing: str) -> str:
    """The table of sketches beside a landing zone."""
    return f"{landing.rstrip('/')}-sketches"


def store_sketch(records: DataFrame, landing: str, source: str, batch: str) -> None:
    sketch_labels(records).write.mode("errorifexists").parquet(f"{folder_of(landing)}/source={source}/batch={batch}")


def landed_sketches(spark: SparkSession, landing: str, landed: DataFrame) -> DataFrame:
    """One sketch row per batch of ``landed``: the stored one, or one made from its records if there is none."""
    batches = landed.select("source", "batch").distinct()
    schema = sketch_labels(landed).schema.add("source", "string").add("batch", "string")
    folder = folder_of(landing)
    try:
        stored = spark.read.schema(schema).option("basePath", folder).parquet(folder)
    except AnalysisException:
        return sketch_labels(landed, "source", "batch")
    stored = stored.join(batches, ["source", "batch"], "left_semi")
    without = batches.join(stored.select("source", "batch"), ["source", "batch"], "left_anti")
    names = [(row["source"], row["batch"]) for row in without.collect()]  # batches, not records
    if not names:
        return stored
    # As literals, so that only the folders of these batches are read.
    of = F.lit(False)
    for source, batch in names:
        of = of | ((F.col("source") == source) & (F.col("batch") == batch))
    return stored.unionByName(sketch_labels(landed.where(of), "source", "batch"))
