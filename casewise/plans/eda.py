"""Exploratory report over one data set."""

from __future__ import annotations

from pyspark.sql import DataFrame

from casewise.config import CasewiseError
from casewise.operators import profile
from casewise.sources.records import dataset_summary, require_columns


def eda_report(records: DataFrame, example_limit: int = 2, top_detailed: int = 8) -> dict[str, DataFrame]:
    """The tables of the report by name. ``records`` is best a landed batch: each table scans
    only the columns it needs."""
    require_columns(records)
    if records.isEmpty():
        raise CasewiseError("O dataset mais recente não possui linhas para análise.")
    return {
        "dataset": dataset_summary(records),
        "overview": profile.overview(records),
        "text_stats": profile.text_stats(records),
        "macro": profile.distribution(records, "classe_macro"),
        "detailed_top": profile.top_distribution(records, "classe_detalhada", top_detailed),
        "channel": profile.distribution(records, "canal_origem"),
        "examples_by_macro": profile.examples_by_macro(records, example_limit),
    }
