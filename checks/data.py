"""Adapter from the given tables to ``records`` and to the texts that are scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.functions.numbers import round_exact
from casewise.operators.prepare import prepare_texts

# Function words of the four languages of the documents. Counting them gives a predicted macro
# class that SQL can compute too, so everything behind the classifier has an exact SQL check.
LANGUAGE_WORDS = {
    "de": ("der", "die", "das", "und", "ist", "nicht", "mit", "ein", "zu", "von"),
    "en": ("the", "and", "of", "to", "is", "that", "with", "for", "this", "it"),
    "es": ("el", "los", "las", "una", "por", "con", "para", "del", "se", "como"),
    "fr": ("le", "les", "des", "et", "est", "dans", "pour", "du", "qui", "sur"),
}

# Keywords of the detailed classes of the adapter, in the role of the refiner's keyword table.
DETAIL_KEYWORDS = {
    "q0_t0": ("worthless", "|"),
    "q0_t1": ("nicht", "hate"),
    "q1_t0": ("the ", "les ", "und ", "los "),
    "q1_t1": ("with", "pour"),
}

HIGH_TERMS = ("worthless", "nicht", "pour")
MEDIUM_TERMS = ("with", "dans", "para")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. A scan with fewer splits than cores is spread over them: the files here
    have one row group each, while a large table brings its own splits and is left alone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    detail = F.concat(F.lit("q"), F.col("quality"), F.lit("_t"), F.col("toxic"))
    return documents.join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id_registro"),
        F.col("text").alias("texto"),
        F.col("source").alias("canal_origem"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 366).cast("int"))
        .cast("string")
        .alias("data"),
        F.col("lang").alias("classe_macro"),
        detail.alias("classe_detalhada"),
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns as new cases: id, texto, canal_origem."""
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.col("conv_id"), F.col("turn")).alias("id"),
        F.col("text").alias("texto"),
        F.col("role").alias("canal_origem"),
    )


def _hits(tokens: Column, words: tuple[str, ...]) -> Column:
    return F.size(F.filter(tokens, lambda token: token.isin(*words)))


def with_language(df: DataFrame, prefix: str = "") -> DataFrame:
    """Add the language whose function words occur most often, and its share of all such words."""
    langs = sorted(LANGUAGE_WORDS)
    hits = prepare_texts(df).withColumn(
        "_hits", F.array(*[_hits(F.col("texto_tokens"), LANGUAGE_WORDS[lang]) for lang in langs])
    )
    best = F.array_max("_hits")
    total = F.aggregate("_hits", F.lit(0), lambda a, b: a + b)
    share = F.when(total > 0, best / total).otherwise(F.lit(0.0))
    return hits.withColumns(
        {
            f"{prefix}macro": F.get(F.array(*map(F.lit, langs)), F.array_position("_hits", best).cast("int") - 1),
            f"{prefix}confidence": round_exact(share, 4),
        }
    ).drop("_hits", "texto_original", "texto_tokens", "texto_processado")


def predicted_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New cases with a predicted macro class and its confidence."""
    return with_language(cases(spark, sf_dir))


def responses(contexts: DataFrame) -> DataFrame:
    """Answers of an outside service, made from the cases: usable ones, broken ones, failures."""
    kind = F.length("texto") % 8
    first, last = F.get("valid_classes", F.lit(0)), F.element_at("valid_classes", -1)

    def body(*parts) -> Column:
        return F.concat(*[part if isinstance(part, Column) else F.lit(part) for part in parts])

    answer = (
        F.when(kind == 0, body('{"detailed_class": "', first, '", "ambiguous_case": "false"}'))
        .when(
            kind == 1,
            body(
                '{"detailed_class": " ', last, ' ", "justification": "', F.col("macro"),
                '", "priority": "alta", "ambiguous_case": false}',
            ),
        )
        .when(kind == 2, body("resposta: ", first))
        .when(kind == 3, body('{"detailed_class": "', F.col("macro"), '", "priority": "media"}'))
        .when(kind == 6, F.lit(""))
        .when(kind == 7, body('{"detailed_class": "', first, '", "justification": null, "ambiguous_case": 2}'))
    )
    error = F.when(kind == 4, F.lit("timeout")).when(kind == 5, F.lit("authentication"))
    return contexts.select("id", answer.alias("body"), error.alias("error"))
