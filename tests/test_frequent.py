"""Vocabularies from bounded summaries: equal to plain counts, whatever a task may hold."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from casewise.operators import frequent, tfidf

SCHEMA = "scope string, terms array<string>"


def corpus(documents, seed, words=400):
    """Skewed words; scope ``hot`` holds a third of the documents, ``flat`` has no frequent word, one row has no scope."""
    pick = random.Random(seed)
    rows = [(None, ["w1", "w2", "w2"]), ("hot", []), ("small", ["only"]), ("gone", None), ("empty", [])]
    for at in range(documents):
        scope = ("hot", "cold", "flat")[at % 3]
        length = pick.randrange(30)
        if scope == "flat":
            rows.append((scope, [f"f{pick.randrange(10 * words)}" for _ in range(length)]))
        else:
            rows.append((scope, [f"w{int(words * pick.random() ** 4)}" for _ in range(length)]))
    return rows


def plain(rows, size, overall):
    """The first terms of each scope by sorting all counts."""
    total, df, documents = Counter(), Counter(), Counter()
    for scope, terms in rows:
        if terms is None:
            continue
        for name in {scope, overall} - {None}:
            documents[name] += 1
            total.update((name, term) for term in terms)
            df.update((name, term) for term in set(terms))
    out = set()
    for name in documents:
        ranked = sorted((-count, term) for (scope, term), count in total.items() if scope == name)[:size]
        out |= {(name, t, at + 1, -c, df[name, t], documents[name]) for at, (c, t) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("counters", [1 << 19, 900, 120, 3])
@pytest.mark.parametrize("overall", ["all", None])
def test_equals_plain_counts(spark, counters, overall):
    rows = corpus(900, 7)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).cache()
    found = tfidf.fit_vocabulary(docs, 12, overall, counters)
    got = [tuple(r) for r in found.select("scope", "term", "place", "total", "df", "n").collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, 12, overall)


def test_every_way_of_proof_is_taken(spark, monkeypatch):
    """With room for part of the terms: ``small`` is exact, ``hot`` is proved, ``flat`` is counted in full."""
    kinds = {}
    write = frequent.materialize

    def spy(table, label):
        written = write(table, label)
        if label == "term-bounds":
            kinds.update({row["scope"]: row["kind"] for row in written.collect()})
        if label == "term-candidates":
            kinds["candidates"] = written.where("scope = 'hot'").count()
        return written

    monkeypatch.setattr(frequent, "materialize", spy)
    docs = spark.createDataFrame(corpus(3000, 11), SCHEMA).repartition(3)
    frequent.frequent_terms(docs, 8, None, 500).count()
    assert (kinds["small"], kinds["hot"], kinds["flat"]) == ("exact", "proved", "open")
    assert 8 < kinds["candidates"] < 200


def test_summaries_are_bounded_and_their_bounds_hold(spark):
    rows = corpus(1500, 3)
    docs, partitions, counters = spark.createDataFrame(rows, SCHEMA).repartition(4), 4, 150
    found = frequent.summaries(docs, "all", counters).collect()
    assert len([r for r in found if r.term]) <= counters * partitions
    assert len([r for r in found if not r.term]) <= 7 * partitions
    lower, lost, true = Counter(), Counter(), Counter()
    for row in found:
        lower[row.scope, row.term] += row.total
        lost[row.scope] += row.lost
    for scope, terms in rows:
        for term in terms or []:
            true.update([("all", term)] if scope is None else [(scope, term), ("all", term)])
    assert lost["hot"] > 0 and lost["small"] == 0
    assert all(lower[key] <= count <= lower[key] + lost[key[0]] for key, count in true.items())
    assert lower["all", ""] == sum(terms is not None for _, terms in rows)


def test_small_scopes_leave_their_room_to_large_ones():
    assert frequent._even_share(np.array([1, 2, 1000]), 100) == 97
    assert frequent._even_share(np.array([5, 5]), 100) == 5
    assert frequent._even_share(np.array([9] * 50), 10) == 1
    summary = frequent.Summary(10, None)
    scopes = ["big"] * 40 + ["tiny"]
    terms = [[f"t{at}"] * (at % 3 + 1) for at in range(40)] + [["x"]]
    summary.add(pa.array(scopes), pa.array(terms))
    summary.settle()
    assert "tiny" not in summary.lost and summary.held.num_rows <= 10


def test_empty_tables_and_terms_without_value(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert tfidf.fit_vocabulary(nothing, 5, "all").count() == 0
    docs = spark.createDataFrame([("a", ["x", None, "x"]), ("a", [None]), ("a", ["y" * 100_000])], SCHEMA)
    got = {(r.term[:1], r.total, r.df, r.n) for r in tfidf.fit_vocabulary(docs, 5).collect()}
    assert got == {("x", 2, 1, 3), ("y", 1, 1, 3)}


def test_a_batch_is_counted_in_slices(monkeypatch):
    """However many terms a batch holds, what is counted at a time is bounded, and no row is lost."""
    rows = [("a", ["x", "y"] * 5), (None, ["z"]), ("b", None), ("b", [])] * 40
    batch = pa.RecordBatch.from_pylist([{"scope": s, "terms": t} for s, t in rows], pa.schema([("scope", pa.string()), ("terms", pa.list_(pa.string()))]))
    monkeypatch.setattr(frequent, "SLICE_TERMS", 30)
    parts = list(frequent._slices(batch))
    assert [row for part in parts for row in part.to_pylist()] == batch.to_pylist()
    assert max(sum(len(row["terms"] or []) for row in part.to_pylist()) for part in parts) <= 30 + 10
    whole, cut = frequent.Summary(1000, "all"), frequent.Summary(1000, "all")
    kept = batch.filter(pa.array([t is not None for _, t in rows]))
    whole.add(kept.column("scope"), kept.column("terms"))
    for part in frequent._slices(kept):
        cut.add(part.column("scope"), part.column("terms"))

    def counted(summary):
        return sorted((tuple(row.values()) for part in summary.rows() for row in part.to_pylist()), key=repr)

    assert counted(whole) == counted(cut)


@pytest.mark.parametrize("carried", [1 << 20, 0])
def test_candidates_are_counted_again_without_a_shuffle_of_all_terms(spark, monkeypatch, carried):
    """Both ways to count candidates again; only the join may count terms that are none."""
    rows = [row for row in corpus(900, 7) if row[0] != "flat"]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).cache()
    all_terms, looked_up = [], []
    joined, carry = frequent.term_counts, frequent.recounted
    monkeypatch.setattr(frequent, "MAX_CARRIED", carried)
    monkeypatch.setattr(frequent, "LOOKUP_SLICE", 100)
    monkeypatch.setattr(frequent, "term_counts", lambda *given: all_terms.append(1) or joined(*given))
    monkeypatch.setattr(frequent, "recounted", lambda *given: looked_up.append(1) or carry(*given))
    found = tfidf.fit_vocabulary(docs, 5, "all", 120).select("scope", "term", "place", "total", "df", "n")
    assert {tuple(row) for row in found.collect()} == plain(rows, 5, "all")
    assert bool(all_terms) == (not carried) and bool(looked_up) == bool(carried)


def test_vectors_by_lookup_are_those_of_the_join(spark, monkeypatch):
    """Rows of several scopes in one batch, cut into slices; nulls and unknown scopes have empty vectors."""
    monkeypatch.setattr(tfidf, "LOOKUP_SLICE", 60)
    rows = [(str(at), *row) for at, row in enumerate(corpus(300, 5))] + [("n", "hot", ["w1", None, "w0", "w1"])]
    docs = spark.createDataFrame(rows, "id string, " + SCHEMA).repartition(2)
    fitted = tfidf.fit_vocabulary(docs, 50, "all").cache()
    found = {row["id"]: row for row in tfidf.TermSpace(fitted).vectorize(docs).collect()}
    assert len(found) == len(rows) and found["0"]["idx"] == [] and found["3"]["weight"] == []
    want = {}
    known = docs.where("scope is not null and terms is not null")
    for row in tfidf.weights_long(known, fitted).collect():
        want.setdefault(row["id"], {})[row["place"] - 1] = row["weight"]
    for key, row in found.items():
        assert row["idx"] == sorted(want.get(key, {}))
        assert row["weight"] == pytest.approx([want[key][at] for at in row["idx"]])
