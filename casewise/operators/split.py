"""Reproducible train/test split and class weights."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewise.config import CasewiseError
from casewise.functions.numbers import balanced_weight
from casewise.session import materialize


_ROW = "_row_key"


@dataclass
class Split:
    """The modelling table with a ``split`` column, and how it came about."""

    table: DataFrame
    train_size: int
    test_size: int
    stratified: bool
    warnings: list[str] = field(default_factory=list)

    @property
    def train(self) -> DataFrame:
        return self.table.where(F.col("split") == "train").drop("split")

    @property
    def test(self) -> DataFrame:
        return self.table.where(F.col("split") == "test").drop("split")


def class_sizes(df: DataFrame, label: str) -> dict[str, int]:
    """Rows per class; as small as the taxonomy, whatever the size of the table."""
    return {row[0]: row[1] for row in df.groupBy(label).agg(F.count(F.lit(1))).collect()}


def check_trainable(sizes: dict[str, int]) -> None:
    if sum(sizes.values()) < 6:
        raise CasewiseError("São necessários ao menos 6 registros válidos para treinar o baseline hierárquico.")
    if len(sizes) < 2:
        raise CasewiseError("O nível macro exige pelo menos duas classes distintas para treinamento.")


def stratification_warning(sizes: dict[str, int], test_rows: int) -> str | None:
    """Why the split cannot be stratified, or None when it can."""
    if min(sizes.values()) < 2:
        return "Nem todas as classes macro possuem ao menos 2 exemplos. O split foi feito sem estratificação."
    if test_rows < len(sizes):
        return (
            "O conjunto de teste seria menor que o número de macroclasses. "
            "O split foi ajustado sem estratificação."
        )
    return None


def test_quotas(sizes: dict[str, int], test_rows: int) -> dict[str, int]:
    """Test rows per class in proportion to its size: largest remainder, ties by label."""
    total = sum(sizes.values())
    shares = {label: divmod(size * test_rows, total) for label, size in sizes.items()}
    quotas = {label: whole for label, (whole, _) in shares.items()}
    open_rows = test_rows - sum(quotas.values())
    for label in sorted(shares, key=lambda name: (-shares[name][1], name))[:open_rows]:
        quotas[label] += 1
    return quotas


def split_hash(seed: int, id_column: str = "id_registro") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column)))


def train_test_split(
    modeling: DataFrame, target: str = "classe_macro", test_size: float = 0.2, seed: int = 42
) -> Split:
    """Put the records with the smallest id hashes of each class into the test set.

    Each class gets an exact quota without ever being sorted as a whole: histograms over ever longer
    prefixes of the hash find the place at which the quota is reached, only the records of that place are
    ranked, and the key found there is compared row by row. A hash of the whole record and a row key stand
    behind the id's hash, so records that share an id, or have none, are split one by one and
    the sizes are those reported. ``modeling`` may be any table; it is written with its keys first.
    """
    modeling = materialize(modeling.withColumn(_ROW, F.monotonically_increasing_id()), "split-rows")
    sizes = class_sizes(modeling, target)
    check_trainable(sizes)
    total = sum(sizes.values())
    test_rows = math.ceil(total * test_size)
    warning = stratification_warning(sizes, test_rows)
    if warning is None:
        group, quotas = F.col(target), test_quotas(sizes, test_rows)
    else:
        group, quotas = F.lit("all"), {"all": test_rows}
    others = [F.coalesce(F.col(name).cast("string"), F.lit("")) for name in sorted(modeling.columns) if name != _ROW]
    content = F.md5(F.concat_ws("\u001f", F.lit(str(seed)), *others, F.col(_ROW)))
    hashed = modeling.withColumns({"_group": group, "_hash": F.coalesce(split_hash(seed), F.lit("")), "_content": content})
    bounds = materialize(_quota_bounds(hashed, quotas), "split-bounds")
    inside = F.struct("_hash", "_content", _ROW) <= F.col("_bound")
    table = (
        hashed.join(bounds, "_group", "left")
        .withColumn("split", F.when(inside, "test").otherwise("train"))
        .drop("_group", "_hash", "_content", "_bound", _ROW)
    )
    return Split(table, total - test_rows, test_rows, warning is None, [warning] if warning else [])


def _quota_bounds(hashed: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """The largest key inside the quota of each group, as (_group, _bound).

    A step counts the rows of each value of the next part of the key, and keeps those of the one value at
    which the quota is reached. Many different hashes share their first four characters with few others;
    rows with one and the same hash are told apart by the record's hash.
    """
    spark = hashed.sparkSession
    left = spark.createDataFrame(sorted(quotas.items()), "_group string, _left bigint").where("_left > 0")
    steps = (F.substring("_hash", 1, 4), F.col("_hash"), F.substring("_content", 1, 4))
    rows = hashed.select("_group", "_hash", "_content", _ROW)
    for at, step in enumerate(steps):
        keyed = rows.withColumn("_part", step)
        upto = Window.partitionBy("_group").orderBy("_part")
        reached = (
            keyed.groupBy("_group", "_part")
            .agg(F.count(F.lit(1)).alias("_rows"))
            .withColumn("_before", F.sum("_rows").over(upto) - F.col("_rows"))
            .join(left, "_group")
            .where((F.col("_before") < F.col("_left")) & (F.col("_before") + F.col("_rows") >= F.col("_left")))
            .select("_group", "_part", (F.col("_left") - F.col("_before")).alias("_left"))
        )
        reached = materialize(reached, f"split-part-{at}")
        rows = keyed.join(reached.select("_group", "_part"), ["_group", "_part"]).drop("_part")
        left = reached.drop("_part")
    place = F.row_number().over(Window.partitionBy("_group").orderBy("_hash", "_content", _ROW))
    return (
        rows.withColumn("_place", place)
        .join(left, "_group")
        .where(F.col("_place") == F.col("_left"))
        .select("_group", F.struct("_hash", "_content", _ROW).alias("_bound"))
    )


def class_weights(train: DataFrame, label: str) -> DataFrame:
    """Rows and balanced weight of each class."""
    sizes = train.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n_class"))
    everything = Window.partitionBy()
    return sizes.select(
        "label",
        "n_class",
        balanced_weight(
            F.sum("n_class").over(everything), F.count(F.lit(1)).over(everything), F.col("n_class")
        ).alias("weight"),
    )
