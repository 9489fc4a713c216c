"""The ``records`` table: reading, validating, landing and picking the active batch."""

from __future__ import annotations

import csv
import uuid
from collections.abc import Iterable, Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from casewise.config import NA_TOKENS, REQUIRED_COLUMNS, CasewiseError
from casewise.sources.sketches import store_sketch


#: When a batch was landed.
ARRIVED = "arrived_at"


def record_order(id_column: str = "id_registro") -> list[Column]:
    """Sort key that stands in for file order: numeric ids first by value, then the rest as text."""
    return [F.col(id_column).try_cast("bigint").asc_nulls_last(), F.col(id_column).asc()]


def order_key(id_column: str = "id_registro") -> Column:
    """The same order as one comparable struct, for ``min_by`` and friends."""
    number = F.coalesce(F.col(id_column).try_cast("bigint"), F.lit((1 << 63) - 1))
    return F.struct(number.alias("number"), F.col(id_column).alias("text"))


def missing_columns(columns: Iterable[str]) -> list[str]:
    present = set(columns)
    return [name for name in REQUIRED_COLUMNS if name not in present]


def require_columns(df: DataFrame) -> DataFrame:
    missing = missing_columns(df.columns)
    if missing:
        raise CasewiseError(
            f"O dataset não possui todas as colunas obrigatórias. Faltam: {', '.join(missing)}."
        )
    return df


def schema_check(df: DataFrame) -> DataFrame:
    """One row per required column: is it there, and how many records fill it."""
    present = set(df.columns)
    filled = [
        F.count(F.col(name) if name in present else F.lit(None)).alias(name) for name in REQUIRED_COLUMNS
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("coluna_esperada"),
                F.lit(name in present).alias("presente_no_dataset"),
                F.col(name).alias("registros_preenchidos"),
            )
            for name in REQUIRED_COLUMNS
        ]
    )
    return df.agg(*filled).select(F.inline(rows))


_EXTRA = "_extra_field"


def _headers(spark: SparkSession, path: str | Sequence[str]) -> dict[str, list[str]]:
    """Files by their first line. Only the first split of a file is looked at, each in one task and in order."""
    lines = spark.read.text(path if isinstance(path, str) else list(path))
    first = lines.where("_metadata.file_block_start = 0").groupBy(F.col("_metadata.file_path").alias("file"))
    files: dict[str, list[str]] = {}
    for row in first.agg(F.first("value").alias("header")).orderBy("file").collect():
        files.setdefault(row["header"].lstrip("\ufeff"), []).append(row["file"])
    return files


def read_csv(spark: SparkSession, path: str | Sequence[str], multiline: bool = True) -> DataFrame:
    """Read CSV records: quoted line breaks, stripped headers, pandas-style missing values.

    Everything stays a string. Columns are addressed by name: files with different headers are read
    each with its own and joined by name. Short rows are filled with nulls; a row with more fields
    than its header, or bytes that are not UTF-8, refuse the whole input, as does U+FFFD, which stands for
    such bytes. Without quoted line breaks (``multiline=False``) large files are split among tasks.
    """
    invalid = f"Não foi possível ler o arquivo como CSV válido: {path}"
    try:
        files = _headers(spark, path)
    except AnalysisException as error:
        raise CasewiseError(invalid) from error
    if not files or not any(header.strip() for header in files):
        raise CasewiseError("O arquivo CSV não possui registros para processar.")
    parts = []
    for header, paths in files.items():
        names = [name.strip() for name in next(csv.reader([header]))]
        if len(set(names)) < len(names):
            raise CasewiseError(invalid)
        schema = ST.StructType([ST.StructField(name, ST.StringType()) for name in [*names, _EXTRA]])
        reader = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", multiline)
        parts.append(reader.csv([unquote(p) for p in paths]))
    raw = parts[0]
    for part in parts[1:]:
        raw = raw.unionByName(part, allowMissingColumns=True)
    named = raw.drop(_EXTRA)
    broken = F.exists(F.array(*named.columns), lambda value: F.coalesce(value.contains("\ufffd"), F.lit(False)))
    seen = raw.agg(F.count(F.lit(1)).alias("rows"), F.max(F.col(_EXTRA).isNotNull() | broken).alias("invalid")).first()
    if seen["invalid"]:
        raise CasewiseError(invalid)
    if not seen["rows"]:
        raise CasewiseError("O arquivo CSV foi lido, mas não possui linhas de dados.")
    return named.select(
        *[F.when(~F.col(name).isin(*NA_TOKENS), F.col(name)).alias(name) for name in named.columns]
    )


def load_records(spark: SparkSession, path: str | Sequence[str], multiline: bool = True) -> DataFrame:
    """Read and validate one CSV data set."""
    return require_columns(read_csv(spark, path, multiline))


def land_batch(
    records: DataFrame, landing: str, source: str = "upload", batch: str | None = None, sketch: bool = False
) -> str:
    """Write a validated batch into the landing zone; an existing batch is never overwritten.

    Every row bears the time at which its batch was landed, by which batches are ordered. With ``sketch`` the
    batch's label sketches are written beside the landing zone, from the landed rows, once these are there.
    """
    require_columns(records)
    spark = records.sparkSession
    now = spark.range(1).select(F.current_timestamp().alias("now")).first()["now"]
    if batch is None:
        batch = f"{now:%Y%m%dT%H%M%S}{now.microsecond // 1000:03d}-{uuid.uuid4().hex[:8]}"
    path = f"{landing.rstrip('/')}/source={source}/batch={batch}"
    records.withColumn(ARRIVED, F.lit(now)).write.mode("errorifexists").parquet(path)
    if sketch:
        store_sketch(spark.read.schema(records.schema).parquet(path), landing, source, batch)
    return batch


def read_landing(spark: SparkSession, landing: str) -> DataFrame:
    """All landed batches, with ``source`` and ``batch`` as partition columns, both text as written."""
    reader = spark.read.option("basePath", landing)
    try:
        found = reader.parquet(landing)
    except AnalysisException as error:
        raise CasewiseError("Nenhum dataset disponível para processamento.") from error
    fields = [field for field in found.schema if field.name not in ("source", "batch")]
    names = [ST.StructField(name, ST.StringType()) for name in ("source", "batch")]
    return reader.schema(ST.StructType([*fields, *names])).parquet(landing)


def resolve_source(requested: str | None, current: str | None = None, demo_by_default: bool = False) -> str:
    """Requested source, else the current one, else the default."""
    for candidate in (requested, current):
        cleaned = (candidate or "").strip().lower()
        if cleaned in ("upload", "demo"):
            return cleaned
    return "demo" if demo_by_default else "upload"


def latest_batch(landed: DataFrame, source: str = "upload", preferred: str | None = None) -> DataFrame:
    """Records of the preferred batch if it exists, else of the one of the source that arrived last.

    The batch name is looked up first and then used as a literal, so that the scan of the
    records themselves is pruned to a single partition folder. Tables without an arrival time are
    ordered by batch name.
    """
    candidates = landed.where(F.col("source") == source)
    wanted = F.max(F.when(F.col("batch") == F.lit(preferred), F.col("batch")))
    order = F.struct(ARRIVED, "batch") if ARRIVED in landed.columns else F.struct("batch")
    found = candidates.agg(F.coalesce(wanted, F.max(order)["batch"]).alias("batch")).first()[0]
    if found is None:
        raise CasewiseError(f"Nenhum dataset disponível para a fonte '{source}'.")
    return candidates.where(F.col("batch") == found).drop(ARRIVED)


def newest_files(spark: SparkSession, folder: str) -> DataFrame:
    """CSV files of a raw folder, newest first, for folders that were never landed.

    ``binaryFile`` lists path and modification time without opening the files.
    """
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)
    return listing.select("path", "modificationTime").orderBy(F.desc("modificationTime"), "path")


def load_newest(spark: SparkSession, folder: str, multiline: bool = True) -> DataFrame:
    """The records of the newest CSV file of a raw folder."""
    newest = newest_files(spark, folder).first()
    if newest is None:
        raise CasewiseError("Nenhum dataset disponível para processamento.")
    return load_records(spark, unquote(newest["path"]), multiline)


def dataset_summary(df: DataFrame) -> DataFrame:
    """Row count, column count and column names, as one row."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count",
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.lit(", ".join(df.columns)).alias("columns"),
    )


def dataset_preview(df: DataFrame, rows: int = 10) -> DataFrame:
    """First rows of the data set with every value as text."""
    shown = [F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name) for name in df.columns]
    return df.orderBy(*record_order()).limit(rows).select(*shown)
