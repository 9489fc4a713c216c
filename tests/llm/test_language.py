import random
import zlib

import numpy as np

from casewise.llm import language as L

LETTERS = {"en": "etaoinshrd", "de": "enirstudhß", "fr": "esaitnrulé", "es": "eaosrnidlñ"}


def corpus(n=160, seed=3):
    draw = random.Random(seed)
    rows = []
    for at in range(n):
        lang = draw.choice(list(LETTERS))
        words = ["".join(draw.choice(LETTERS[lang]) for _ in range(draw.randrange(2, 8))) for _ in range(draw.randrange(20, 80))]
        rows.append((at, " ".join(words), lang, "s", 1))
    return rows


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = docs_of(spark, rows)
    model = L.fit_documents(docs)
    got = {r["doc_id"]: r for r in L.identify_languages(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(got) == len(rows) and held
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_only_learned_rows_and_texts_count(spark):
    rows = corpus()
    other = [(i, t, lang if zlib.crc32(str(i).encode()) % 5 else "xx", "other", 9) for i, t, lang, _, _ in rows]
    asked = docs_of(spark, rows[:20])
    a, b = (L.identify_languages(asked, L.fit_documents(docs_of(spark, r))).orderBy("doc_id").collect() for r in (rows, other))
    assert a == b


def test_edge_cases(spark):
    odd = [(900, None, None, None, None), (901, "", "en", "s", 0), (902, "123 !?", "en", "s", 1), (None, "the of and", "en", "s", 1), (3, "x" * 300000, None, "s", 1)]
    docs = docs_of(spark, corpus(60) + odd + odd)
    model = L.fit_documents(docs)
    got = L.identify_languages(docs_of(spark, odd + odd), model).collect()
    assert len(got) == 10
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in got if r["doc_id"] in (900, 901, 902))
    assert all(r["lang_pred"] in LETTERS for r in got if r["doc_id"] in (None, 3))
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == 64
    empty = docs_of(spark, [])
    assert L.fit_documents(empty) is None and L.keep_identified(empty).collect() == []
    assert L.identify_languages(empty, None).collect() == []
    one = docs_of(spark, [(i, "only one", "en", "s", 1) for i in range(9)])
    assert {r["lang_pred"] for r in L.identify_languages(one, L.fit_documents(one)).collect()} == {"en"}


def test_features_ignore_what_is_around():
    alone = L.features(np.frombuffer(b"The cat", np.uint8), np.array([0, 7]))
    both = L.features(np.frombuffer(b"xyz 12 THE  cat", np.uint8), np.array([0, 6, 6, 15]))
    assert np.allclose(alone[0], both[2]) and not both[1].any() and np.isclose((both[0] ** 2).sum(), 1)
