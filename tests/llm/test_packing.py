import zlib
from collections import defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from casewise.llm import packing as K  # noqa: E402
from casewise.llm.tokens import WordIds  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


TEXTS = [
    "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "don't I'LL  é É\xa0b\x1cc d ΑΣ ΟΔΟΣ. ﬁ ...,, a., İstanbul", "²³ª º ǅ a‍b 'S 've 1,234.5", "e ́ x é",
    "a\tb\rc\n\nd", ".", ",", "a.,", "É.", "ß. ẞ. K Å", "", " ", "日本語 テキスト。", "Ünïcödé, ÑANDÚ.", "x" * 300, "😀.😀", " a　b\x85c", "<| |> <|", "µ. µ µm",
]


def test_word_ids_equal_the_tokenizer(plain):
    store = WordIds(PATH)
    assert store.lowers and store.direct and store.stops
    for text in TEXTS * 2:
        assert np.frombuffer(store.encode(text), store.kind).tolist() == plain(text), text


def test_slices_with_a_small_store(plain, monkeypatch):
    monkeypatch.setattr("casewise.llm.tokens.KEPT_WORDS", 3)
    store = WordIds(PATH)
    texts = [*TEXTS, "(306) a.b@c.de", "don'T é's", "w" * 500 + " é" * 300, *TEXTS, "A <|endoftext|>B"]
    data = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, data)])
    ids, counts = store.encode_slice(np.frombuffer(b"".join(data), np.uint8), bounds)
    assert np.split(ids, np.cumsum(counts)[:-1])[0].tolist() == plain(texts[0])
    assert [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])] == [plain(t) for t in texts]
    few = WordIds(PATH)
    for text in texts:
        assert np.frombuffer(few.encode(text), few.kind).tolist() == plain(text)
    assert len(few.keys) <= 3 + max(len(text.split()) for text in texts)


def pack(docs, **options):
    return [tuple(r) for r in K.pack_documents(docs, PATH, **options).collect()]


def check(pieces, ids, window):
    """Exact round trip: every id lies in one piece, sequences have no gaps and need no padding."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for doc, start, length, crc, total, sequence, offset in pieces:
        assert length > 0
        sequences[sequence].append((offset, length))
        documents[doc, total].append((start, length, crc))
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at == window or at < window and at & (at - 1) == 0
    want = sorted(((doc, len(x)) for doc, x in ids), key=repr)
    assert sorted({(d, t) for d, t in documents}, key=repr) == sorted(set(want), key=repr)
    for doc, x in ids:
        covered = np.zeros(len(x), int)
        copies = sum(1 for d, y in ids if d == doc and len(y) == len(x))
        for start, length, crc in documents[doc, len(x)]:
            assert crc == zlib.crc32(np.array(x[start : start + length], "<u4").tobytes())
            covered[start : start + length] += 1
        assert (covered == copies).all()


def test_round_trip(make_docs, plain):
    texts = TEXTS + [None, "one two three " * 900, "w " * 5000] + [f"text number {i} " * (i % 40) for i in range(120)]
    rows = [*enumerate(texts), (None, "no id"), (3, TEXTS[3]), (7, "")]
    ids = [(doc, [*plain(text), K.END_ID]) for doc, text in rows]
    check(pack(make_docs(rows, clashes=True)), ids, 4096)
    check(pack(make_docs(rows).repartition(3), window=256, quantum=16, chunk_tokens=2000), ids, 256)


def test_empty(make_docs):
    assert pack(make_docs([])) == []


def test_windows_follow_the_mixture(make_docs):
    docs = make_docs([f"word{i % 7} " * 200 for i in range(90)]).coalesce(1)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    mass = defaultdict(lambda: defaultdict(int))
    for doc, _, length, _, _, sequence, _ in pack(docs, window=1024, quantum=64):
        mass[sequence][source[doc]] += length
    full = [m for m in mass.values() if sum(m.values()) == 1024]
    assert len(full) > 20
    assert all(abs(m[s] - 1024 / 3) <= 200 for m in full[:-2] for s in ("s0", "s1", "s2"))


def test_targets_and_deficits():
    queues = {"a": [(0, 500), (1, 500)], "b": [(2, 3000)]}
    out = list(K.deficit_round_robin(dict(queues), {"a": 0.25, "b": 0.75}, {"a": 0.0, "b": 0.0}, 400, 50))
    served = {"a": 0, "b": 0}
    for doc, start, length in out:
        served["b" if doc == 2 else "a"] += length
        total = sum(served.values())
        assert abs(served["a"] - 0.25 * total) <= 310
    assert served == {"a": 1000, "b": 3000}
    # What was owed at the start is paid first.
    first = next(K.deficit_round_robin(dict(queues), {"a": 0.5, "b": 0.5}, {"a": 90.0, "b": -90.0}, 400, 50))
    assert first == (0, 0, 90)
    assert K.sequence_lengths(9000, 4096) == [4096, 4096, 512, 256, 32, 8]


@pytest.mark.parametrize("targets", [None, {"s0": 0.5, "s1": 0.3, "s2": 0.2}])
def test_windows_of_a_table_sorted_by_source(make_docs, targets):
    docs = make_docs([f"word{i % 7} " * (4000 if i == 44 else 200) for i in range(180)]).coalesce(1).sortWithinPartitions("source")
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    mass, total = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for doc, _, length, _, _, sequence, _ in pack(docs, window=1024, quantum=64, chunk_tokens=9000, targets=targets):
        mass[sequence][source[doc]] += length
        total[source[doc]] += length
    want = targets or {s: n / sum(total.values()) for s, n in total.items()}
    until = min(n / want[s] for s, n in total.items())  # then a source is used up
    at, seen = 0, 0
    for sequence in sorted(mass):
        size = sum(mass[sequence].values())
        at += size
        if size == 1024 and at < until - 9000:
            seen += 1
            assert all(abs(mass[sequence][s] - 1024 * want[s]) <= 400 for s in want), (sequence, dict(mass[sequence]))
    assert seen > 20
