from types import SimpleNamespace

from checks import queries

ROW = "id_registro string, texto_original string, texto_processado string, classe_macro string, classe_detalhada string"


def test_test_rows_without_a_training_class_stay(spark, monkeypatch):
    """No training row has the language fr, and the class xx has its only record in the test part."""
    train = [(str(i), "the end of it", "x", "en", "a" if i else "b") for i in range(3)]
    test = [("7", "the end of it", "x", "en", "a"), ("8", "les mots et le vent", "x", "en", "b"), ("9", "the end of it", "x", "xx", "c")]
    parts = SimpleNamespace(train=spark.createDataFrame(train, ROW), test=spark.createDataFrame(test, ROW))
    monkeypatch.setattr(queries, "_split", lambda spark, sf: parts)
    got = {(r["id_registro"], r["level"]): (r["expected"], r["predicted"]) for r in queries._predictions(spark, "")[1].collect()}
    assert got == {
        ("7", "macro"): ("en", "en"), ("7", "detailed"): ("a", "a"), ("7", "detailed_oracle"): ("a", "a"),
        ("8", "macro"): ("en", "fr"), ("8", "detailed"): ("b", "a"), ("8", "detailed_oracle"): ("b", "a"),
        ("9", "macro"): ("xx", "en"), ("9", "detailed"): ("c", "a"), ("9", "detailed_oracle"): ("c", "a"),
    }
