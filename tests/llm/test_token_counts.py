import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from casewise.llm import token_counts as T

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")

PIECES = [
    " ", " ", "\n", "\t", "\r\n", " ", " ", "'", "'s", "'r", "'re", "'l", "'ll", "'ve", "don't", "s", "v", "re", " the", "hello", "Reoush",
    "123", "²", "Ⅷ", ".", "!!", "=", "-" * 33, "é", "ß", "日本", "😀", "́", "՘", "֋", "꟎", "\U00032000",
    "<|endoftext|>", "<|endof", "text|>",
]


@pytest.fixture(scope="module")
def count():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_every_prefix_equals_the_library(count):
    counter, rng = T.PrefixCounter(PATH), random.Random(11)
    for _ in range(400):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12)))
        deltas = counter.deltas(text)
        got = [int(deltas[: n + 1].sum()) for n in range(len(text))]
        assert got == [count(text[: n + 1]) for n in range(len(text))], text


def test_small_stores_change_nothing(count, monkeypatch):
    monkeypatch.setattr(T, "KEPT_UNITS", 3)
    monkeypatch.setattr(T, "KEPT_PAIRS", 5)
    counter, text = T.PrefixCounter(PATH), "one two three four five one two six seven's 88 " * 3
    assert int(counter.deltas(text).sum()) == count(text)
    assert len(counter) <= 3 and len(counter.pairs) <= 5


def test_classes_of_characters_as_the_library_has_them(count):
    counter = T.PrefixCounter(PATH)
    for low in range(0x500, 0x30000, 0x35):  # a part of all characters in each of the four surroundings
        text = "".join(f"a{c}a1{c}1.{c}. {c} {c}{c}b" for c in map(chr, range(low, low + 3)) if not 0xD800 <= ord(c) < 0xE000)
        assert int(counter.deltas(text).sum()) == count(text), hex(low)


def test_long_texts(count):
    for text in ("abc" * 20_000, " " * 5_000 + "x", "=" * 3_000, "word " * 30_000, "日本" * 3_000):
        assert int(T.PrefixCounter(PATH).deltas(text).sum()) == count(text)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        T.PrefixCounter(public_tokenizers.path("word_bpe_49k.json"))


def test_documents(make_docs, count):
    texts = [None, "", "Hello  world", "the " * 600, "<|endoftext|>", "Hello  world"]
    rows = T.count_tokens(make_docs([(at if at != 3 else None, text) for at, text in enumerate(texts)], clashes=True), PATH, 5).collect()
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["budget_chars"]) for r in rows))

    def within(text):
        return max((n for n in range(len(text) + 1) if count(text[:n]) <= 5), default=0)

    want = sorted((at == 3, at if at != 3 else 0, len((t or "").encode()), count(t or ""), within((t or "")[:100])) for at, t in enumerate(texts))
    assert got == want
    assert T.count_tokens(make_docs([]), PATH).collect() == []


def test_index_answers_without_texts(make_docs, count):
    texts = ["Hello  world's end", "a\n\nb <|endoftext|> c", "", None]
    index = T.prefix_index(make_docs(texts), PATH)
    for n in (0, 3, 7, 8, 500):
        asked = T.fit_budget(T.tokens_at(index, F.lit(n)), F.lit(n)).collect()
        for row in asked:
            text = texts[row["doc_id"]] or ""
            assert row["tokens"] == count(text[:n])
            assert row["chars"] == max(m for m in range(len(text) + 1) if count(text[:m]) <= n)
    unbounded = T.fit_budget(T.tokens_at(index, F.lit(None)), F.lit(None)).collect()
    assert all(r["tokens"] == r["n_tokens"] and r["chars"] == len(texts[r["doc_id"]] or "") for r in unbounded)


def test_query_counts_whole_documents(spark, tmp_path, make_docs, count):
    texts = ["the " * n for n in (510, 511, 512, 513, 600)] + [None]
    make_docs(texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in T.op11_prefix_token_counts(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for at, text in enumerate(texts):
        n = count(text or "")
        assert (got[at]["n_bytes"], got[at]["n_tokens"], got[at]["over_limit"]) == (len(text or ""), n, n > 512)
