import random

from casewise.llm import licenses as L
from casewise.llm.common import Words

import numpy as np
import pyarrow as pa

MIT = L.TEMPLATES[1][1]


def found(docs, **options):
    return sorted(((r["doc_id"], r["license"], r["template"], r["words"], round(r["coverage"], 3), r["start"], r["end"]) for r in L.scan_licenses(docs, **options).collect()), key=repr)


def hashes(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return Words(raw, np.array([0, len(raw)])).hash


def test_spans_and_coverage(make_docs):
    notice = "Released under the MIT License"
    apache = "Licensed under the Apache License, Version 2.0"
    texts = [f"é😀 {notice}.", f"x {apache} y {notice} z {notice}", "all RIGHTS reserved", "Released under some License", None, "", notice + " " + "w " * 40000 + notice]
    got = found(make_docs(texts, clashes=True))
    want = []
    for at, text in enumerate(texts):
        for name, template, phrase in (("MIT", 0, notice), ("Apache-2.0", 2, apache), ("All-rights-reserved", 12, "all RIGHTS reserved")):
            low = -1
            while text and (low := text.find(phrase, low + 1)) >= 0:
                want.append((at, name, template, len(hashes(phrase)), 1.0, low, low + len(phrase)))
    assert got == sorted(want, key=repr)


def test_edited_copies(make_docs):
    words = MIT.split()
    dropped = " ".join(w for i, w in enumerate(words) if i % 25)
    added = " ".join(w + " really" * (i % 30 == 29) for i, w in enumerate(words))
    half = " ".join(words[: len(words) // 2])
    rows = found(make_docs([f"a b {t} c d" for t in (dropped, added, half)]), templates=[("MIT", MIT)])
    assert [(r[0], r[1]) for r in rows] == [(0, "MIT"), (1, "MIT")]
    assert rows[0][4] >= 0.9 and rows[1][4] == 1.0


def plain_matches(template, text):
    """Words in common in order (longest common subsequence)."""
    row = [0] * (len(text) + 1)
    for a in template:
        before = 0
        for j, b in enumerate(text):
            before, row[j + 1] = row[j + 1], before + 1 if a == b else max(row[j + 1], row[j])
    return row[-1]


def test_alignment_against_longest_common_subsequence():
    draw = random.Random(6)
    template = [f"t{i}" for i in range(60)]
    for _ in range(30):
        copy = list(template)
        for _ in range(draw.randrange(6)):
            at = draw.randrange(len(copy))
            copy[at : at + 1] = draw.choice([[], ["new"], [copy[at], "new"]])
        text = ["pre"] * 5 + copy + ["post"] * 5
        matched, first, past = L.align(np.array(template), np.array(text), 5, L.BAND)
        assert matched <= plain_matches(template, text) and matched >= plain_matches(template, text) - 2
        assert 5 <= first < past <= len(text) - 5


def test_repeats_nulls_and_nothing(make_docs):
    line = "Licensed under CC BY-NC 4.0."
    assert len(found(make_docs([(1, line), (1, line), (None, line)]))) == 3
    assert found(make_docs([])) == [] and found(make_docs([line]), templates=[("none", "")]) == []


def test_winnow_keeps_one_of_any_run():
    draw = np.random.default_rng(1)
    h = draw.integers(0, 50, 200).astype(np.uint64)
    kept = set(L.winnow(h, 4).tolist())
    assert all(any(i in kept for i in range(at, at + 4)) for at in range(197)) and len(kept) < 120


def test_single_changes_at_every_place(make_docs):
    texts, owner = [], []
    for t, (_, text) in enumerate(L.TEMPLATES):
        raw = np.frombuffer(text.encode(), np.uint8)
        cut = Words(raw, np.array([0, len(raw)]))
        words = [text.encode()[a:b].decode() for a, b in zip(cut.start, cut.end)]
        for at in range(len(words)):
            for new in ([], ["changed"]):
                texts.append(" ".join(["before", "it", *words[:at], *new, *words[at + 1 :], "after", "it"]))
                owner.append((t, words))
    got = {(r[0], r[2]): r[3] for r in found(make_docs(texts))}
    for doc, (t, words) in enumerate(owner):
        plain = plain_matches([w.lower() for w in words], texts[doc].lower().split())
        assert got.get((doc, t), 0) == (plain if plain >= L.COVERAGE * len(words) else 0), texts[doc]


def test_no_alignment_without_enough_partners(make_docs, monkeypatch):
    common = "the software and to of the without or " * 40
    index, raw = L.TemplateIndex([("MIT", MIT)]), np.frombuffer(common.encode(), np.uint8)
    words = Words(raw, np.array([0, len(raw)]))
    places = index.candidates(words)
    need, band = index.needs[0], L.band_of(len(index.words[0]))
    assert len(places) > 100
    assert not any(L.can_match(index.words[0], words.hash, s + band, band, need) for _, _, s in places)

    tried = []
    monkeypatch.setattr(L, "align", lambda *given: tried.append(given) or (0, 0, 0))
    batch = pa.record_batch([pa.array([1]), pa.array([common])], ["id", "text"])
    assert list(L._scan(index)(iter([batch]))) == [] and tried == []


def test_bound_on_matches_never_drops_one():
    draw = random.Random(8)
    for _ in range(400):
        template, text = (np.array([draw.randrange(6) for _ in range(draw.randrange(1, n))]) for n in (12, 20))
        start, band = draw.randrange(-6, 22), draw.randrange(1, 4)
        matched = L.align(template, text, start, band)[0]
        assert L.can_match(template, text, start, band, matched) or not matched
