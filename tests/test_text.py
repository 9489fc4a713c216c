import random
import re
import string
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casewise.config import STOPWORDS, CasewiseError, TextOptions
from casewise.functions import text as T
from casewise.functions.numbers import percent, round_exact
from casewise.functions.unicode import nfkc, strip_accents
from casewise.operators.prepare import prepare_texts, split_blank
from casewise.operators.tfidf import vector_tokens, with_ngrams

TRICKY = [
    "", "  ", "Olá, Mundo!", "a b", "ﬁm ½ ² ª º ™ …", "İstanbul ΑΣ ΑΣΑ", "é café", "日本語 テスト １２３",
    "a_b __ c-d", "x y\u0085z\x1cw\x0bv", "— travessão – “aspas”", "linha\r\noutra\rmais\n", "Straße ÆØÅ łódź ğ",
    "नमस्ते", "한국어 각", "🙂 emoji 👩‍👩‍👧", "tab\tend", "Ωμέγα Й й", "ÀÉÎÕÜ àéîõü ç ñ ÿ", "ſ ŉ Ǆ",
]


def samples():
    rng = random.Random(7)
    alphabet = "abc XYZ 09 _-.,;!?\t\n\r  éÉçÇßøŁ²½ﬁ—…İΣσ日１̧́"
    return TRICKY + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(150)]


def evaluate(spark, texts, expression):
    df = spark.createDataFrame([(at, text) for at, text in enumerate(texts)], "at int, t string")
    return [row[0] for row in df.select("at", expression(F.col("t")).alias("r")).orderBy("at").select("r").collect()]


def plain_tokens(text):
    return re.findall(r"\w+|[^\w\s]", text)


def plain_bare(tokens):
    table = str.maketrans("", "", string.punctuation)
    return [token.translate(table) for token in tokens if token.translate(table)]


def plain_summary(text, limit):
    line = " ".join(text.split())
    return (line or "-") if len(line) <= limit else line[:limit].rstrip() + "..."


def plain_unaccented(text):
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


RULES = {
    "nfkc": (nfkc, lambda t: unicodedata.normalize("NFKC", t)),
    "strip_accents": (strip_accents, plain_unaccented),
    "strip_accents_lower": (lambda c: strip_accents(F.lower(c)), lambda t: plain_unaccented(t.lower())),
    "normalize": (
        T.normalize_text,
        lambda t: unicodedata.normalize("NFKC", t).replace("\r\n", "\n").replace("\r", "\n"),
    ),
    "whitespace": (T.clean_whitespace, lambda t: re.sub(r"\s+", " ", t).strip()),
    "strip": (T.strip, str.strip),
    "tokens": (T.tokenize, plain_tokens),
    "bare": (lambda c: T.strip_punctuation(T.tokenize(c)), lambda t: plain_bare(plain_tokens(t))),
    "stopwords": (
        lambda c: T.remove_stopwords(T.lower_tokens(T.tokenize(c))),
        lambda t: [w for w in (x.lower() for x in plain_tokens(t)) if w not in STOPWORDS],
    ),
    "words": (T.word_count, lambda t: len(t.split())),
    "summary": (lambda c: T.summarize(c, 9), lambda t: plain_summary(t, 9)),
    "vector_tokens": (
        vector_tokens,
        lambda t: re.findall(r"(?u)\b\w\w+\b", plain_unaccented(t.lower())),
    ),
}


@pytest.mark.parametrize("name", RULES)
def test_rule_equals_plain_python(spark, name):
    column, plain = RULES[name]
    texts = samples()
    for text, got in zip(texts, evaluate(spark, texts, column)):
        assert got == plain(text), repr(text)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=30), min_size=40, max_size=40))
def test_rules_on_any_text(spark, texts):
    texts = [text for text in texts if not any(unicodedata.category(c) in ("Cs", "Cn") for c in text)] or ["x"]
    for name in ("nfkc", "strip_accents", "whitespace", "strip"):
        column, plain = RULES[name]
        assert evaluate(spark, texts, column) == [plain(text) for text in texts], name


def test_ngrams(spark):
    def grams(c):
        return with_ngrams(F.split(c, " "))

    assert evaluate(spark, ["aa bb cc", "aa"], grams) == [["aa", "bb", "cc", "aa bb", "bb cc"], ["aa"]]


def test_rounding_and_percent_equal_python(spark):
    rng = random.Random(3)
    values = [0.1235, 0.40625, 2.675, 0.00125, 0.5, 1.0, 0.0, 12.345] + [rng.random() for _ in range(300)]
    values += [round(rng.random(), 4) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", round_exact(F.col("v"), 4).alias("r"), percent(F.col("v")).alias("p")).collect():
        assert row.r == round(row.v, 4)
        assert row.p == f"{row.v * 100:.1f}%"


def prepared(spark, texts, **options):
    df = spark.createDataFrame([(text,) for text in texts], "texto string")
    return prepare_texts(df, TextOptions(**options)).collect()


def test_prepare_defaults(spark):
    first, second, empty = prepared(
        spark, ["  Olá, Mundo!   Este é um TESTE.  ", "Canal: E-mail; assunto: cobrança.", None]
    )
    assert first.texto_processado == "olá mundo este é um teste"
    assert first.texto_original == "  Olá, Mundo!   Este é um TESTE.  "
    assert second.texto_tokens == ["canal", "e", "mail", "assunto", "cobrança"]
    assert (empty.texto_original, empty.texto_processado, empty.texto_tokens) == ("", "", [])


def test_prepare_options(spark):
    (row,) = prepared(spark, ["Esse é um texto de teste para a base."], remove_stopwords=True)
    assert row.texto_processado == "esse é texto teste base"
    (row,) = prepared(spark, ["Teste, com pontuação!"], remove_punctuation=False)
    assert row.texto_tokens == ["teste", ",", "com", "pontuação", "!"]
    assert row.texto_processado == "teste , com pontuação !"
    (row,) = prepared(spark, ["_de A_B"], remove_stopwords=True)
    assert row.texto_tokens == ["de", "ab"]


def test_prepare_needs_its_column(spark):
    with pytest.raises(CasewiseError):
        prepare_texts(spark.createDataFrame([("x",)], "outro string"))


def test_active_steps():
    assert TextOptions().active_steps() == [
        "normalizacao", "limpeza_espacos", "lowercase", "remocao_pontuacao", "tokenizacao",
    ]
    assert TextOptions(remove_stopwords=True, lowercase=False).step_labels() == [
        "normalização", "limpeza de espaços", "remoção de pontuação", "remoção de stopwords", "tokenização",
    ]
    stored = {"lowercase": False, "unknown": 1}
    assert TextOptions.from_dict(stored) == TextOptions(lowercase=False)
    assert TextOptions.from_dict(None) == TextOptions()


def test_blank_texts_are_rejected_not_raised(spark):
    cases = spark.createDataFrame([("a", " x "), ("b", "  \n"), ("c", None)], "id string, texto string")
    valid, rejected = split_blank(cases)
    assert [(r.id, r.texto) for r in valid.collect()] == [("a", "x")]
    assert sorted(r.id for r in rejected.collect()) == ["b", "c"]


def test_channel_prefix(spark):
    df = spark.createDataFrame([("t", " Email "), ("t", None), ("t", " ")], "t string, c string")
    got = [row[0] for row in df.select(T.with_channel(F.col("t"), F.col("c"))).collect()]
    assert got == ["Canal de origem: Email\nTexto do caso: t", "t", "t"]
