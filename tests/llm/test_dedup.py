import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from casewise.llm import dedup as D
from casewise.llm.common import Words, text_slices

WORDS = [f"w{i}" for i in range(300)]


def plain_bag(text, k=5):
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else Counter([tuple(words)] if words else [])


def plain_classes(rows, threshold=0.8):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [plain_bag(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            a, b = bags[i], bags[j]
            shared, whole = sum((a & b).values()), sum((a | b).values())
            if rows[i][1] is not None and rows[j][1] is not None and (rows[i][1] == rows[j][1] or whole and shared >= threshold * whole):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min([x for x in (least.get(find(i)), doc) if x is not None], default=None)
    return sorted(((doc, least[find(i)]) for i, (doc, _) in enumerate(rows)), key=repr)


def corpus(seed=1):
    draw = random.Random(seed)
    texts = []
    for _ in range(25):
        base = [draw.choice(WORDS) for _ in range(draw.choice([3, 12, 60, 200]))]
        texts.append(" ".join(base))
        for _ in range(draw.randrange(6)):
            copy = list(base)
            for _ in range(draw.randrange(5)):
                copy[draw.randrange(len(copy))] = draw.choice(WORDS)
            texts.append(draw.choice([" ", ", ", "\n"]).join(copy).upper() if draw.random() < 0.3 else " ".join(copy))
    line = " ".join(draw.choice(WORDS) for _ in range(9))
    texts += [f"{line}\n" * n for n in (40, 45, 50, 3)]  # weights tell these apart
    draw.shuffle(texts)
    return list(enumerate(texts, 100))


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, make_docs, seed):
    rows = corpus(seed)
    got = D.near_duplicate_classes(make_docs(rows, clashes=True)).collect()
    assert sorted(((r["doc_id"], r["class_id"]) for r in got), key=repr) == plain_classes(rows)


def test_edge_cases(make_docs):
    long = " ".join(WORDS * 60)
    rows = [(5, None), (6, None), (7, ""), (8, ""), (9, "!!! ..."), (10, "one two"), (11, "One, two!"), (12, long), (13, long + " end"),
            (None, "one two"), (14, "dup"), (14, "dup"), (None, "lonely words here")]
    got = D.near_duplicate_classes(make_docs(rows)).collect()
    assert sorted(((r["doc_id"], r["class_id"]) for r in got), key=repr) == plain_classes(rows)
    assert {r["doc_id"] for r in got if r["kept"]} >= {5, 6, 7, 9, 10, 12, 14}
    kept = D.keep_one(make_docs(rows, clashes=True)).collect()
    assert sorted((r["doc_id"] for r in kept), key=repr) == sorted([5, 6, 7, 9, 10, 12, 14, None], key=repr)
    assert D.near_duplicate_classes(make_docs([])).collect() == []
    assert D.keep_one(make_docs([])).collect() == []


def test_large_group_keeps_one(make_docs):
    base = WORDS[:200]
    rows = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(150)] + ["other text of its own kind"]
    got = D.near_duplicate_classes(make_docs(rows)).collect()
    assert len({r["class_id"] for r in got}) == 2


def test_group_edited_to_every_degree(make_docs):
    draw = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = [" ".join(base)] * 5
    for _ in range(70):
        copy = list(draw.choice(rows[-20:]).split()) if draw.random() < 0.4 else list(base)
        for _ in range(draw.randrange(12)):
            at = draw.randrange(len(copy))
            copy[at : at + 1] = draw.choice([[], ["new"], [f"n{draw.randrange(9)}"], [copy[at], "more"]])
        rows.append(" ".join(copy))
    rows = list(enumerate(rows))
    got = D.near_duplicate_classes(make_docs(rows)).collect()
    assert sorted(((r["doc_id"], r["class_id"]) for r in got), key=repr) == plain_classes(rows)


def bag(texts, k=1):
    (_, _, data, bounds) = next(text_slices(pa.array(texts)))
    return D.bag_of_shingles(Words(data, bounds), k)


def test_signatures_estimate_weighted_jaccard_without_bias():
    draw = np.random.default_rng(5)
    a = [w for w in WORDS[:80] for _ in range(draw.integers(1, 8))]
    b = [w for w in WORDS[20:110] for _ in range(draw.integers(1, 8))]
    x, y = Counter(a), Counter(b)
    want = sum((x & y).values()) / sum((x | y).values())
    signature = D.bag_min_hash(*bag([" ".join(a), " ".join(b)]), 2, 6000)
    assert abs((signature[0] == signature[1]).mean() - want) < 4 * (want * (1 - want) / 6000) ** 0.5


def test_signature_does_not_depend_on_neighbours():
    texts = ["a b c d e f g", "x " * 500, "a b c d e f g", "q"]
    signature = D.bag_min_hash(*bag(texts, 5), 4, 120)
    assert (signature[0] == signature[2]).all() and np.isfinite(signature).all()
    assert (D.bag_min_hash(*bag(texts[:1], 5), 1, 120)[0] == signature[0]).all()


def test_texts_without_copies_are_not_shuffled_with_their_judgement(make_docs, spark):
    """Also where the judgement is too large for a broadcast."""
    long = [" ".join(f"w{at}x{i}" for i in range(40)) for at in range(30)]
    rows = [(at, text) for at, text in enumerate(long)] + [(100 + at, text) for at, text in enumerate(long[:5])]
    rows += [(7, long[7]), (None, long[8]), (None, None), (200, None), (200, None), (201, "")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = D.keep_one(make_docs(rows, clashes=True))
        first = [line for line in kept._jdf.queryExecution().executedPlan().toString().split("\n") if line.lstrip().startswith(":")]
        got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == sorted([*enumerate(long), (None, None), (200, None), (200, None), (201, "")], key=repr)
    branch = first[: next((at for at, line in enumerate(first) if at and line.strip().startswith(":- ") and line.index(":") == first[0].index(":")), None)]
    assert branch and "has_bit" in "".join(branch) and not any(word in "".join(branch) for word in ("Exchange", "Join"))
