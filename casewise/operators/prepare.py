"""Preprocessing and the tables it feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.config import CasewiseError, TextOptions
from casewise.functions import text as T


def prepare_texts(df: DataFrame, options: TextOptions | None = None) -> DataFrame:
    """Add the original, processed and token columns; every row is kept."""
    options = options or TextOptions()
    if options.source_column not in df.columns:
        raise CasewiseError(
            f"O DataFrame informado nao possui a coluna '{options.source_column}' para processamento."
        )
    original = T.text_or_blank(F.col(options.source_column))
    cleaned = F.col(options.original_column)
    if options.normalize_text:
        cleaned = T.normalize_text(cleaned)
    if options.clean_whitespace:
        cleaned = T.clean_whitespace(cleaned)
    tokens = T.tokenize(cleaned)
    if options.lowercase:
        tokens = T.lower_tokens(tokens)
    if options.remove_stopwords:
        tokens = T.remove_stopwords(tokens)
    if options.remove_punctuation:
        tokens = T.strip_punctuation(tokens)
    return (
        T.with_once(df.withColumn(options.original_column, original), options.tokens_column, tokens)
        .withColumn(options.processed_column, F.array_join(options.tokens_column, " "))
    )


def modeling_table(records: DataFrame, options: TextOptions | None = None) -> DataFrame:
    """Records usable for modelling: stripped labels, none of macro, detail and text blank.

    The label filters do not depend on the text, so Catalyst runs them below the tokeniser and
    unlabelled rows are never tokenised.
    """
    options = options or TextOptions()
    labelled = records.withColumns(
        {
            "classe_macro": T.stripped_or_blank(F.col("classe_macro")),
            "classe_detalhada": T.stripped_or_blank(F.col("classe_detalhada")),
        }
    ).where((F.col("classe_macro") != "") & (F.col("classe_detalhada") != ""))
    return prepare_texts(labelled, options).where(F.col(options.processed_column) != "")


def macro_table(records: DataFrame) -> DataFrame:
    """Raw stripped text and macro class, blanks dropped."""
    cleaned = records.select(
        "id_registro",
        T.stripped_or_blank(F.col("texto")).alias("texto"),
        T.stripped_or_blank(F.col("classe_macro")).alias("classe_macro"),
    )
    return cleaned.where((F.col("classe_macro") != "") & (F.col("texto") != ""))


def split_blank(cases: DataFrame, text_column: str = "texto", id_column: str = "id") -> tuple[DataFrame, DataFrame]:
    """Cases with a usable text, and the rejected ones with a reason."""
    stripped = T.stripped_or_blank(F.col(text_column))
    valid = cases.where(stripped != "").withColumn(text_column, stripped)
    rejected = cases.where(stripped == "").select(
        id_column, F.lit("Informe um texto para executar a inferência.").alias("reason")
    )
    return valid, rejected
