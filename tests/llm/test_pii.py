import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from casewise.llm import pii as P

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for at, c in enumerate(reversed(digits)):
        value = int(c) * (1 + at % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def accepted(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(part) <= 255 for part in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def plain_spans(text):
    return [(k, m.start(), m.end(), m.group()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if accepted(k, m.group())]


def spans(docs):
    rows = docs.select("doc_id", P.base_spans(F.col("text")).alias("s")).collect()
    return {r["doc_id"]: [tuple(s) for s in r["s"]] for r in rows}


def test_base_spans_equal_python(make_docs):
    draw = random.Random(4)
    pieces = ["a@b.co", "x.y+z@mail.example.com", "a@b.c_d@e.f", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "007.0.0.255", "4111 1111 1111 1111",
              "4111-1111-1111-1112", "+1 (743) 555-3824", "+12345", "+1..", "é", "😀", " ", ".", "-", "@", "word", "00000000000000", "9" * 25, "%", "\n"]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randrange(14))) for _ in range(400)]
    texts += [None, "", "a" * 60000, "1" * 60000, "1 " * 30000, "@" * 9000, "+1" + "." * 9000, "a@b." * 3000 + "c", "1.1.1.1 " * 2000, "9.0e" + "1-" * 20000]
    got = spans(make_docs(texts))
    for at, text in enumerate(texts):
        assert got[at] == plain_spans(text), text and text[:80]


def test_disclosing_terms(spark, make_docs):
    noise = [f"common words {w} stand here" for w in ("alpha", "beta", "gamma", "delta")] * 5
    docs = [f"common words secretword near me@x.org often here {i}" for i in range(3)] + noise + [None, ""]
    rows = P.find_spans(make_docs(docs, clashes=True)).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(docs)
    n, n_e = len(docs), 3
    for doc in range(3):
        got = {docs[doc][m["start"] : m["end"]]: m["kind"] for m in by_id[doc]["method"]}
        want = {}
        for term in ("common", "words", "secretword", "near", "often", "here"):
            n_t = sum(term in (t or "").split() for t in docs)
            share = math.log(n * 3 / (n_t * n_e)) / math.log(n / n_e)
            if share >= P.GENERALISE:
                want[term] = "removed" if share >= P.REMOVE else "generalised"
        assert got == want and got["secretword"] == "removed" and "common" not in got
    assert all(not by_id[i]["method"] for i in range(3, len(docs)))


def test_sanitised_texts(make_docs):
    texts = ["call +1 (743) 555-3824 or a@b.co, é 1.2.3.4", "clean", None, "", "two a@b.co two", "two a@b.co two"]
    docs = make_docs([*enumerate(texts), (None, "x@y.zz")], clashes=True)
    rows = P.sanitise(docs).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 7 and rows[0].__fields__ == docs.columns
    assert got[0]["text"] == "call [PHONE] or [EMAIL], é [IP]" and got[0]["n_chars"] == len(got[0]["text"])
    assert got[1]["text"] == "clean" and got[2]["text"] is None and got[3]["text"] == "" and got[None]["text"] == "[EMAIL]"
    assert got[4]["text"].split("[EMAIL]")[0] in ("two ", " ") and got[0]["content"] == "x"
    assert P.sanitise(make_docs([])).collect() == []


def test_query_digest(make_docs, tmp_path):
    texts = ["a@b.co 1.2.3.4", "none", None]
    make_docs(texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in P.op3_information_pii(make_docs([]).sparkSession, str(tmp_path)).collect()}
    assert rows[0]["base_sha256"] == hashlib.sha256(b"email:0:6,ip:7:14").hexdigest()
    assert rows[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and rows[2]["spans"] == ""
    assert [rows[0][f"n_{k}"] for k in P.BASE_KINDS] == [1, 1, 0, 0]


def test_disclosing_terms_anywhere(make_docs):
    """In a heading far above the entity, again in the same text, and in a text without the entity."""
    far = "filler words stand between " * 40
    docs = [f"Zorblatt wrote: {far} mail z@x.org now. {far} zorblatt" for _ in range(4)]
    docs += ["ask Zorblatt, é Zorblatt."] + [f"filler words stand between mail now wrote ask {i}" for i in range(200)]
    texts = make_docs(docs)
    rows = {r["doc_id"]: r for r in P.find_spans(texts).collect()}
    share = math.log(len(docs) * 4 / (5 * 4)) / math.log(len(docs) / 4)
    kind = "removed" if share >= P.REMOVE else "generalised"
    assert P.GENERALISE <= share
    for doc in range(len(docs)):
        want = [(kind, m.start(), m.end()) for m in re.finditer("zorblatt", docs[doc].lower())]
        assert [tuple(m) for m in rows[doc]["method"]] == want and len(want) == (2 if doc < 4 else 2 if doc == 4 else 0)
    clean = {r["doc_id"]: r for r in P.sanitise(texts).collect()}
    assert len(clean) == len(docs)
    assert all("zorblatt" not in r["text"].lower() and r["n_chars"] == len(r["text"]) for r in clean.values())


def test_places_in_many_blocks(spark):
    text = "".join(f"é😀 w{'abc'[i % 3] * (2 + i % 5)} 12 " for i in range(700))
    row = spark.createDataFrame([(text,)], "text string").select(P._placed(F.col("text"), r"[a-z]{3,}", None).alias("m")).first()
    assert [tuple(m) for m in row["m"]] == [(m.start(), m.end(), m.group()) for m in re.finditer(r"[a-z]{3,}", text)]
