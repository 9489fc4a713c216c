"""Exploratory profile of a records table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewise.config import MISSING_LABEL
from casewise.functions.numbers import round_exact
from casewise.functions.text import stripped_or_blank, summarize, word_count
from casewise.sources.records import ARRIVED, order_key, read_landing, record_order
from casewise.sources.sketches import LABELS, estimates, landed_sketches, sketch_labels, unite


def _measured(records: DataFrame) -> DataFrame:
    return records.withColumn("texto", stripped_or_blank(F.col("texto"))).withColumns(
        {
            "qtd_caracteres": F.char_length("texto").cast("bigint"),
            "qtd_palavras": word_count(F.col("texto")).cast("bigint"),
        }
    )


def text_stats(records: DataFrame) -> DataFrame:
    """Mean sizes and the shortest and longest text; the first record wins ties.

    Only the winning ids are aggregated with the measures; their texts come along as
    ``min_by`` values and are shortened once, after the aggregation.
    """
    size = F.col("qtd_caracteres")
    stats = _measured(records).agg(
        F.avg(size).alias("avg_chars"),
        F.avg("qtd_palavras").alias("avg_words"),
        F.min(size).alias("shortest_size"),
        F.max(size).alias("longest_size"),
        F.min_by("texto", F.struct(size, order_key())).alias("shortest_text"),
        F.min_by("texto", F.struct(-size, order_key())).alias("longest_text"),
    )
    return stats.select(
        round_exact(F.col("avg_chars"), 2).alias("avg_chars"),
        round_exact(F.col("avg_words"), 2).alias("avg_words"),
        "shortest_size",
        summarize(F.col("shortest_text")).alias("shortest_preview"),
        "longest_size",
        summarize(F.col("longest_text")).alias("longest_preview"),
    )


def distribution(records: DataFrame, column: str, missing: str | None = MISSING_LABEL) -> DataFrame:
    """Records per label, most frequent first. With ``missing=None`` nulls are left out."""
    if missing is None:
        labelled = records.where(F.col(column).isNotNull()).select(F.col(column).alias("label"))
    else:
        labelled = records.select(F.coalesce(F.col(column), F.lit(missing)).alias("label"))
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("value")).orderBy(F.desc("value"), "label")


def top_distribution(records: DataFrame, column: str, k: int = 8, missing: str | None = MISSING_LABEL) -> DataFrame:
    return distribution(records, column, missing).limit(k)


def overview(records: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows, columns and distinct labels, as (indicator, value) rows.

    The label combinations are counted first: one map-side combined pass over the records, after
    which the distinct counts run over the few combinations instead of over every record. With
    ``approximate`` the distinct counts come from sketches of fixed size, for labels of very many values.
    """
    if approximate:
        return _indicators(estimates(sketch_labels(records)), len(records.columns))
    combinations = records.groupBy(*LABELS).agg(F.count(F.lit(1)).alias("records"))
    totals = combinations.agg(
        F.coalesce(F.sum("records"), F.lit(0)).alias("total_registros"),
        *[F.count_distinct(name).alias(name) for name in LABELS],
    )
    return _indicators(totals, len(records.columns))


def landed_overview(spark: SparkSession, landing: str, source: str | None = None) -> DataFrame:
    """The approximate overview over all landed batches, or those of one source, from their united sketches."""
    landed = read_landing(spark, landing)
    if source is not None:
        landed = landed.where(F.col("source") == source)
    columns = [name for name in landed.columns if name not in (ARRIVED, "source", "batch")]
    return _indicators(estimates(unite(landed_sketches(spark, landing, landed))), len(columns))


def _indicators(totals: DataFrame, columns: int) -> DataFrame:
    indicators = {
        "total_registros": F.col("total_registros"),
        "total_colunas": F.lit(columns),
        "macroclasses": F.col("classe_macro"),
        "classes_detalhadas": F.col("classe_detalhada"),
        "canais_origem": F.col("canal_origem"),
    }
    return totals.select(_unpivot(indicators, "bigint"))


def text_metrics(records: DataFrame) -> DataFrame:
    """Mean, smallest and largest text sizes, as (indicator, value) rows."""
    size = F.col("qtd_caracteres")
    totals = _measured(records).agg(
        round_exact(F.avg(size), 2).alias("media_caracteres"),
        round_exact(F.avg("qtd_palavras"), 2).alias("media_palavras"),
        F.min(size).alias("menor_texto"),
        F.max(size).alias("maior_texto"),
    )
    return totals.select(_unpivot({name: F.col(name) for name in totals.columns}, "double"))


def _unpivot(indicators: dict[str, Column], kind: str) -> Column:
    return F.inline(
        F.array(
            *[
                F.struct(F.lit(name).alias("indicador"), value.cast(kind).alias("valor"))
                for name, value in indicators.items()
            ]
        )
    )


def _by_macro(measured: DataFrame, *sums: str) -> DataFrame:
    """Per-macro totals by way of (macro, detail) totals.

    Two small-key aggregations, both combined map-side, replace a distinct count and a
    ``collect_set`` over every record of a possibly very large macro class.
    """
    per_detail = (
        measured.where(F.col("classe_macro").isNotNull())
        .groupBy("classe_macro", "classe_detalhada")
        .agg(
            F.count("id_registro").alias("registros"),
            F.count(F.lit(1)).alias("linhas"),
            *[F.sum(name).alias(name) for name in sums],
        )
    )
    return per_detail.groupBy("classe_macro").agg(
        F.sum("registros").alias("registros"),
        F.count("classe_detalhada").alias("classes_detalhadas"),
        F.sum("linhas").alias("linhas"),
        F.sort_array(F.collect_list("classe_detalhada")).alias("detalhes"),
        *[F.sum(name).alias(name) for name in sums],
    )


def macro_profile(records: DataFrame) -> DataFrame:
    """Records, detail count and mean text sizes per macro class."""
    totals = _by_macro(_measured(records), "qtd_palavras", "qtd_caracteres")
    return totals.select(
        "classe_macro",
        "registros",
        "classes_detalhadas",
        round_exact(F.col("qtd_palavras") / F.col("linhas"), 2).alias("media_palavras"),
        round_exact(F.col("qtd_caracteres") / F.col("linhas"), 2).alias("media_caracteres"),
    ).orderBy(F.desc("classes_detalhadas"), F.desc("registros"), "classe_macro")


def hierarchy_summary(records: DataFrame, shown: int = 6) -> DataFrame:
    """Macro summary with a comma list of its first detailed classes.

    The summary and the list come from the same aggregation, so no join is left to do.
    """
    return (
        _by_macro(records)
        .select(
            "classe_macro",
            "registros",
            "classes_detalhadas",
            F.array_join(F.slice("detalhes", 1, shown), ", ").alias("exemplos_de_classes"),
        )
        .orderBy(F.desc("classes_detalhadas"), F.desc("registros"), "classe_macro")
    )


def first_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "posicao") -> DataFrame:
    """The first ``n`` rows of every group.

    Filtering a ``row_number`` lets Spark keep only ``n`` rows per group and input partition
    before the shuffle, so a group of any size stays cheap.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def examples_by_macro(records: DataFrame, n: int = 2) -> DataFrame:
    """First records of each macro class with a shortened text."""
    labelled = records.select(
        F.coalesce("classe_macro", F.lit(MISSING_LABEL)).alias("macro_class"),
        F.coalesce("id_registro", F.lit("")).alias("id_registro"),
        F.coalesce("texto", F.lit("")).alias("texto"),
    )
    return first_per_group(labelled, ["macro_class"], record_order(), n).select(
        "macro_class",
        "posicao",
        F.when(F.col("id_registro") == "", "-").otherwise(F.col("id_registro")).alias("id_registro"),
        summarize(F.col("texto"), 220).alias("texto"),
    )


def sample_by_macro(records: DataFrame, n: int = 2) -> DataFrame:
    """First records of each non-null macro class, with the stripped full text."""
    present = records.where(F.col("classe_macro").isNotNull())
    kept = first_per_group(present, ["classe_macro"], record_order(), n)
    return kept.select(
        "classe_macro",
        "classe_detalhada",
        "canal_origem",
        stripped_or_blank(F.col("texto")).alias("texto"),
    )
