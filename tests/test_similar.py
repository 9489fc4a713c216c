import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from casewise.operators import similar, tfidf
from casewise.session import materialize

HISTORY_3 = [
    (1, "Preciso emitir segunda via do boleto vencido.", "Financeiro", "Boleto"),
    (2, "Fui cobrado duas vezes na fatura.", "Financeiro", "Cobranca"),
    (3, "Nao consigo redefinir minha senha.", "Suporte", "Senha"),
]
HISTORY_DUP = [
    (1, "Paguei ontem e o pagamento continua pendente no sistema.", "Financeiro", "Pagamento"),
    (2, "Paguei ontem e o pagamento continua pendente no sistema.", "Financeiro", "Pagamento"),
    (3, "Preciso da segunda via do boleto.", "Financeiro", "Boleto"),
    (4, "Recebi uma cobranca indevida no sistema.", "Financeiro", "Cobranca"),
]


def ask(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, texto string, macro string")


def test_two_results_in_macro_scope(spark, make_records):
    found = similar.similar_cases(
        ask(spark, ("q", "Preciso emitir um novo boleto hoje.", "Financeiro")), make_records(HISTORY_3), k=2
    ).orderBy("rank").collect()
    assert [r.rank for r in found] == [1, 2] and {r.scope for r in found} == {"macro"}
    assert {r.macro_class for r in found} == {"Financeiro"}
    assert found[0].detailed_class == "Boleto" and found[0].similarity > found[1].similarity


def test_blank_queries_find_nothing(spark, make_records):
    queries = ask(spark, ("a", "", "Financeiro"), ("b", " ?! ", "Financeiro"))
    assert similar.similar_cases(queries, make_records(HISTORY_3[:1])).count() == 0


def test_repeated_cases_count_once(spark, make_records):
    query = ("q", "Efetuei o pagamento ontem, mas segue pendente no sistema.", "Financeiro")
    found = similar.similar_cases(ask(spark, query), make_records(HISTORY_DUP), k=3).collect()
    assert len(found) == 3 and len({r.text for r in found}) == 3
    assert "1" in {r.history_id for r in found}


def test_scope_falls_back_to_everything_only_for_unknown_macros(spark, make_records):
    history = make_records(HISTORY_3 + [(4, "texto", "Vazia", None)])
    queries = ask(spark, ("a", "senha", "Outra"), ("b", "senha", "Vazia"), ("c", "senha", " Suporte "))
    found = similar.similar_cases(queries, history, k=5).collect()
    by_query = Counter((r.id, r.scope) for r in found)
    # "Vazia" occurs in the history, so its scope is not widened although no record is usable.
    assert by_query == {("a", "global"): 3, ("c", "macro"): 1}


def test_few_shot_examples(spark, make_records):
    found = similar.similar_cases(ask(spark, ("q", "boleto vencido", "Financeiro")), make_records(HISTORY_3))
    row = similar.few_shot_examples(found).first()
    shot = row.few_shot_examples[0]
    assert row.used_count == 2 and shot["rank"] == 1 and shot["priority"] == "media"
    assert shot["justification"] == (
        f"Caso historico com similaridade TF-IDF de {shot['similarity'] * 100:.1f}% em relacao ao texto atual."
    )


# --- brute force ---------------------------------------------------------------------------


def brute_terms(text):
    tokens = re.findall(r"\w\w+", text)
    return tokens + [" ".join(pair) for pair in zip(tokens, tokens[1:])]


def brute_force(queries, history, k, size):
    """Top-k by plain loops over all pairs of one scope."""
    docs = [Counter(brute_terms(text)) for _, text, _, _ in history]
    total, df = Counter(), Counter()
    for doc in docs:
        total.update(doc)
        df.update(doc.keys())
    vocabulary = sorted(total, key=lambda t: (-total[t], t))[:size]
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in vocabulary}

    def vector(counts):
        raw = {t: (1 + math.log(c)) * idf[t] for t, c in counts.items() if t in idf}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        return {t: v / norm for t, v in raw.items()}

    vectors = [vector(doc) for doc in docs]
    result = {}
    for qid, text, _ in queries:
        asked = vector(Counter(brute_terms(text)))
        scored = [
            (-round(sum(w * v.get(t, 0) for t, w in asked.items()), 6), row[0], row[1:])
            for row, v in zip(history, vectors)
        ]
        taken, seen = [], set()
        for score, at, signature in sorted(scored):
            if signature not in seen and len(taken) < k:
                seen.add(signature)
                taken.append((str(at), round(-score, 4)))
        result[qid] = taken
    return result


@pytest.fixture(scope="module")
def crowd():
    """A history in which one text makes up a third of all rows, and queries for it."""
    rng = random.Random(11)
    words = [f"w{at}" for at in range(40)]

    def sentence(n):
        return " ".join(rng.choice(words) for _ in range(n))

    copy = sentence(6)
    history = [(at, copy if at % 3 == 0 else sentence(rng.randint(1, 12)), "M", "D") for at in range(240)]
    queries = [(f"q{at}", sentence(rng.randint(1, 8)), "M") for at in range(30)] + [("none", "zzz yyy", "M")]
    return history, queries


@pytest.mark.parametrize("way", ["broadcast", "grid"])
def test_top_k_equals_brute_force(spark, make_records, crowd, way, monkeypatch):
    history, queries = crowd
    monkeypatch.setattr(similar, "GRID_HISTORY_ROWS", 50)
    monkeypatch.setattr(similar, "GRID_QUERY_ROWS", 8)
    found = similar.similar_cases(
        ask(spark, *queries), make_records(history).repartition(5), k=4, max_features=60,
        max_broadcast_bytes=1 << 20 if way == "broadcast" else 0,
    )
    got = {}
    for row in found.orderBy("id", "rank").collect():
        got.setdefault(row.id, []).append((row.history_id, row.similarity))
    assert got == brute_force(queries, history, 4, 60)


def test_lookup_and_join_give_the_same_vectors(spark, crowd):
    history, _ = crowd
    docs = spark.createDataFrame([(str(r[0]), "all", r[1]) for r in history] + [("x", "all", "?")], "id string, scope string, t string")
    docs = tfidf.with_terms(docs, "t").drop("t")
    vocabulary = materialize(tfidf.fit_vocabulary(docs, 50), "test-vocabulary")

    def vectors(limit):
        rows = tfidf.vectorize(docs, vocabulary, max_entries=limit).collect()
        return {r.id: (r.idx, [round(w, 9) for w in r.weight]) for r in rows}

    joined = vectors(0)
    assert joined == vectors(10_000) and joined["x"] == ([], [])


def test_rows_with_one_id_or_none_keep_their_own_vectors(spark):
    rows = [("1", "all", ["a", "b"]), ("1", "all", ["c"]), (None, "all", ["a", "c", "c"]), (None, "all", ["q"])]
    docs = spark.createDataFrame(rows, "id string, scope string, terms array<string>")
    vocabulary = materialize(tfidf.fit_vocabulary(docs, 9), "test-vocabulary")

    def vectors(limit):
        found = tfidf.vectorize(docs, vocabulary, max_entries=limit).collect()
        return sorted((r.id or "", r.terms, r.idx, [round(w, 9) for w in r.weight]) for r in found)

    assert vectors(0) == vectors(100) and len(vectors(0)) == 4


def test_repeated_and_null_ids_are_cases_of_their_own(spark):
    from casewise.config import REQUIRED_COLUMNS

    texts = ["boleto vencido hoje", "cobranca duplicada no cartao", "senha bloqueada", "boleto pago"]
    ids = ["1", "1", None, None]
    full = [(i, t, "email", "2026-04-04", "M", "D") for i, t in zip(ids, texts)]
    records = spark.createDataFrame(full, ", ".join(f"{name} string" for name in REQUIRED_COLUMNS))
    asked = ask(spark, ("q", "boleto vencido", "M"), ("q", "cobranca duplicada", "M"), (None, "senha", "M"))
    found = similar.similar_cases(asked, records, k=4).collect()
    assert len(found) == 12
    firsts = sorted(r.text for r in found if r["rank"] == 1)
    assert firsts == ["boleto vencido hoje", "cobranca duplicada no cartao", "senha bloqueada"]
    assert all(len({r.text for r in found if r["rank"] == n}) >= 1 for n in range(1, 5))


def test_saved_index_finds_the_same(spark, make_records, crowd, tmp_path):
    history, queries = crowd
    index = similar.HistoryIndex.build(make_records(history), max_features=60)
    index.save(f"{tmp_path}/index")
    again = similar.HistoryIndex.load(spark, f"{tmp_path}/index")
    columns = ["id", "rank", "history_id", "similarity", "text"]
    want, got = (sorted(map(tuple, i.search(ask(spark, *queries)).select(*columns).collect())) for i in (index, again))
    assert got == want and again.options == index.options


def test_vocabulary_counts(spark):
    docs = spark.createDataFrame(
        [("a", ["x", "x", "y"]), ("a", ["x"]), ("a", []), ("b", ["y"])], "scope string, terms array<string>"
    )
    rows = tfidf.fit_vocabulary(docs, 1, overall="all").collect()
    got = {(r.scope, r.term): (r.place, r.total, r.df, r.n, r.idf) for r in rows}
    assert got == {
        ("a", "x"): (1, 3, 2, 3, math.log(4 / 3) + 1),
        ("b", "y"): (1, 1, 1, 1, math.log(2 / 2) + 1),
        ("all", "x"): (1, 3, 2, 4, math.log(5 / 3) + 1),
    }


def test_history_is_not_shuffled_for_few_queries(spark, make_records, crowd):
    history, queries = crowd
    records = make_records(history)
    index = similar.HistoryIndex.build(records)
    rows = [(at, "macro", m, t) for at, (_, t, m) in enumerate(queries)]
    asked = spark.createDataFrame(rows, "case_key long, scope string, macro string, processed string")
    plan = index.match(asked)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInPandas"):]
    assert "Exchange hashpartitioning" not in below
    assert index.match(asked, k=0).count() == 0


def test_history_is_not_copied_for_many_queries(spark, make_records, crowd, monkeypatch):
    """More queries than a broadcast carries come in waves; neither side is copied for the other."""
    history, queries = crowd
    monkeypatch.setattr(similar, "GRID_QUERY_ROWS", 8)
    index = similar.HistoryIndex.build(make_records(history))
    rows = [(at, "macro", m, t) for at, (_, t, m) in enumerate(queries)]
    asked = spark.createDataFrame(rows, "case_key long, scope string, macro string, processed string")
    plan = index.match(asked, max_broadcast_bytes=0)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "Generate" not in plan


def test_words_are_cut_out_once_a_row(spark):
    """A filter on the terms does not repeat the tokeniser's work."""
    docs = tfidf.with_terms(spark.createDataFrame([("um dois",)], "processed string"), "processed")
    plan = docs.where(F.col("terms").isNotNull())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
