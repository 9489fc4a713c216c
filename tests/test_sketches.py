"""Approximate overviews: sketches of batches against the sketch of all rows, and against exact counts."""

import pytest
from pyspark.sql import functions as F

from casewise.operators import profile
from casewise.sources import records as source
from casewise.sources import sketches


def values(table):
    return {row["indicador"]: row["valor"] for row in table.collect()}


@pytest.fixture(scope="module")
def many(spark):
    """60,000 records with 20,000 detailed classes; a third of the rows share one."""
    at = F.col("id")
    detail = F.when(at % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("d"), (at % 20_000).cast("string")))
    return spark.range(60_000).select(
        at.cast("string").alias("id_registro"),
        F.lit("t").alias("texto"),
        F.when(at % 2 == 0, "").otherwise("chat").alias("canal_origem"),
        F.lit("2026-01-01").alias("data"),
        F.when(at % 7 > 0, F.concat(F.lit("m"), (at % 7).cast("string"))).alias("classe_macro"),
        detail.alias("classe_detalhada"),
    )


def test_error_of_the_approximate_overview(many):
    exact, found = values(profile.overview(many)), values(profile.overview(many, approximate=True))
    assert abs(found.pop("classes_detalhadas") / exact.pop("classes_detalhadas") - 1) < 0.05
    assert found == exact and exact["canais_origem"] == 2 and exact["macroclasses"] == 6


def test_batches_unite_to_the_sketch_of_all_rows(spark, many, tmp_path):
    landing = str(tmp_path / "landing")
    number = F.col("id_registro").cast("int")
    for batch, cut in (("1", number < 20_000), ("2", (number >= 20_000) & (number < 50_000)), ("3", number >= 50_000)):
        source.land_batch(many.where(cut), landing, batch=batch, sketch=batch != "2")
    whole = values(profile.overview(many, approximate=True))
    assert values(profile.landed_overview(spark, landing)) == whole  # batch 2 is sketched from its records
    source.land_batch(many.limit(10), landing, source="demo", batch="1", sketch=True)
    assert values(profile.landed_overview(spark, landing, "upload")) == whole
    assert values(profile.landed_overview(spark, landing, "demo"))["total_registros"] == 10
    assert source.read_landing(spark, landing).count() == 60_010  # the sketches are no records


def test_stored_sketches_stand_for_their_records(spark, many, tmp_path):
    landing = str(tmp_path / "landing")
    source.land_batch(many.limit(100), landing, batch="1", sketch=True)
    landed = source.read_landing(spark, landing)
    read = sketches.landed_sketches(spark, landing, landed.where("false"))
    assert read.count() == 0  # a sketch without its batch does not count
    plan = sketches.landed_sketches(spark, landing, landed)._jdf.queryExecution().executedPlan().toString()
    assert "hll_sketch_agg" not in plan


def test_empty_records(spark, many, tmp_path):
    nothing = many.limit(0)
    expected = {"total_registros": 0, "total_colunas": 6, "macroclasses": 0, "classes_detalhadas": 0, "canais_origem": 0}
    assert values(profile.overview(nothing, approximate=True)) == expected
    source.land_batch(nothing, str(tmp_path / "landing"), batch="1", sketch=True)
    assert values(profile.landed_overview(spark, str(tmp_path / "landing"))) == expected
