import random
import re
from collections import Counter

import numpy as np
import pytest

from casewise.llm import phrases as P

SCHEMA = "doc_id long, text string, lang string, key string, h1 string, phrase int"


def plain(rows, longest=4, minimum=30, covered=80, first=2000):
    """Collocations by counting every phrase of every piece."""
    counts, sizes = {}, Counter()
    for text, lang in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            for m in range(1, longest + 1):
                for at in range(len(words) - m + 1):
                    of = counts.setdefault(lang if lang is not None else "und", Counter())
                    of[tuple(words[at : at + m])] += 1
            if words:
                sizes[lang if lang is not None else "und"] += len(words)
    out = []
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= minimum}
        longer = Counter()
        for p, a in frequent.items():
            for m in range(2, len(p)):
                for at in range(len(p) - m + 1):
                    longer[p[at : at + m]] = max(longer[p[at : at + m]], a)
        found = []
        for p, a in frequent.items():
            if 100 * longer[p] >= covered * a and longer[p]:
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def mined(spark, rows, **settings):
    full = [(1, text, lang, "k", "h", 1) for text, lang in rows]
    return sorted(tuple(r) for r in P.mine_phrases(spark.createDataFrame(full, SCHEMA), **settings).collect())


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "b\0", "é", "ÉCOLE", "x-y", "42", "|", "日本", "zq", "w1", "w2", "w3", "q" * 300]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!", "\r", "\x0b", "\x85 ", " "]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words[: rng.randint(2, len(words))]) + rng.choice(marks) for _ in range(rng.randint(0, 60)))
        rows.append((text, rng.choice(["en", "en", "en", "de", None, "und", ""])))
    return rows + [("the the the the the of the", "en")] * 40 + [("one two three four five", "fr")] * 30 + [(None, "fr"), ("", None)]


@pytest.mark.parametrize("room", [200_000, 40])
def test_equals_plain_counting(spark, room):
    rows = corpus(1, 1200)
    want = plain(rows)
    assert len(want) > 50
    assert mined(spark, rows, group_suffixes=room) == want  # 40: prefixes of one to three words are too frequent for a group


def test_other_settings(spark):
    rows = corpus(2, 150)
    for settings in ({"longest": 3, "minimum": 10, "first": 5}, {"longest": 5, "minimum": 25, "covered": 50}, {"longest": 2, "minimum": 30}):
        given = {"covered_percent" if k == "covered" else k: v for k, v in settings.items()}
        assert mined(spark, rows, **given) == plain(rows, **settings), settings


def test_nothing_frequent(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(None, None), ("", "en"), ("a b c", "en")]) == []


def test_long_text_and_repeated_rows(spark):
    rows = [("alpha beta gamma. " * 60_000, "en")] + [("alpha beta", "en")] * 50
    assert mined(spark, rows) == plain(rows)


def test_distinct_rows_that_share_a_hash(monkeypatch):
    columns = [np.array([1, 2, 1, 3], np.uint64), np.array([5, 5, 5, 5], np.uint64)]
    for follow in (P._follow, lambda prefix, word: np.zeros(len(word), np.uint64)):
        monkeypatch.setattr(P, "_follow", follow)
        order, first, count = P._distinct(columns)
        got = sorted((int(columns[0][order[at]]), int(n)) for at, n in zip(first, count))
        assert got == [(1, 2), (2, 1), (3, 1)]


def test_query_equals_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(at, text.replace("\0", ""), lang) for at, (text, lang) in enumerate(corpus(3)) if text is not None]
    spark.createDataFrame(rows + [(9999, None, None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in P.op13_suffix_collocations(spark, str(tmp_path)).collect())
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        assert got and got == sorted(db.execute(P.OP13_SQL).fetchall())
