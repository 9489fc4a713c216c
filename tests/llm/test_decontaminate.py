import random
import re

import pytest

from casewise.llm import decontaminate as D

WORDS = [f"w{i}" for i in range(40)]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(docs, items, window=10):
    cut = [(item, tuple(w[i : i + window])) for item, text in items for w in [words_of(text)] if w for i in range(max(1, len(w) - window + 1))]
    out = []
    for doc, text in docs:
        words, hit, names = words_of(text), set(), set()
        for item, win in cut:
            for i in range(len(words) - len(win) + 1):
                if tuple(words[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    if item is not None:
                        names.add(str(item))
        out.append((doc, len(words), len(hit), sorted(names), bool(hit)))
    return sorted(out, key=repr)


def found(docs, items):
    rows = D.find_contamination(docs, items).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in rows), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, make_docs, seed):
    draw = random.Random(seed)
    some = lambda n: " ".join(draw.choice(WORDS) for _ in range(n))
    items = [(i, some(draw.choice([1, 2, 3, 4, 5, 7, 9, 10, 11, 25]))) for i in range(12)] + [(100, ""), (101, None), (None, some(12)), (3, some(11))]
    docs = []
    for at in range(40):
        parts = [some(draw.randrange(30))]
        for _ in range(draw.randrange(3)):
            text = draw.choice(items)[1] or ""
            words = text.split()
            low = draw.randrange(max(1, len(words) - 12))
            parts += [draw.choice([" ", ", ", "\n"]).join(words[low : low + draw.choice([9, 10, 14, 40])]).title(), some(draw.randrange(8))]
        docs.append((at, " ".join(parts)))
    docs += [(900, None), (901, ""), (None, items[3][1]), (7, docs[7][1]), (7, docs[7][1]), (902, some(3000))]
    table = spark.createDataFrame(items, "item_id long, text string")
    assert found(make_docs(docs, clashes=True), table) == plain(docs, items)


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    item = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert found(make_docs([]), item) == []
    assert found(make_docs(["a b c", None]), none) == [(0, 3, 0, [], False), (1, 0, 0, [], False)]
    kept = D.drop_contaminated(make_docs(["x a, b C y", "a b", None], clashes=True), item)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2] and "content" in kept.columns
