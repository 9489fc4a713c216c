"""Token counts by prefix dynamic programming: the exact count at every prefix of every text.

For byte-level BPE a sequence of tokens is the encoding of its bytes just if each two neighbours are the encoding
of theirs. So every prefix has exactly one possible last token: the one that ends there and stands well after the last
token of the prefix before it. The count of a prefix is that shorter prefix's count plus one.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator
from functools import lru_cache
from operator import sub

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from casewise.llm.common import table
from casewise.llm.tokens import _byte_letters

LIMIT_TOKENS = 512

#: Bounds of what a worker keeps: units in each of two generations (a unit is at most so many characters), pairs of tokens.
KEPT_UNITS, KEPT_CHARS, KEPT_PAIRS = 300_000, 48, 400_000

#: A unit: white space and the word, number, punctuation or contraction after it; between units pretokens never join.
_UNIT = regex.compile(
    r"(?:\s*[^\S ])?'(?:s|t|re|ve|m|ll|d)|\s*\p{L}+|\s*\p{N}+|\s*[^\s\p{L}\p{N}]+|\s+"
)
_PLAIN_END = "԰"  # below it both Unicode tables in use agree on letters, numbers and white space
_FAR = regex.compile(f"[{_PLAIN_END}-\U0010ffff]")
#: Characters that stand for one of another Unicode version's class; no contraction holds them.
_PROXY = {"letter": "a", "number": "1", "space": "\t", "other": "!"}
_DELTA = np.dtype("<i2")


def _changes(counts: list[int]) -> bytes:
    return struct.pack(f"<{len(counts) - 1}h", *map(sub, counts[1:], counts))


class PrefixCounter(dict):
    """Changes of the token count, character by character, for each unit of text; and whole texts from them."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        before, added = described["pre_tokenizer"] or {}, described["added_tokens"]
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        strips = any(token[flag] for token in added for flag in ("single_word", "lstrip", "rstrip"))
        if not plain or strips or described["normalizer"] or described["model"].get("type") != "BPE" or described["model"].get("ignore_merges"):
            raise ValueError(f"{path} is not a byte-level BPE tokenizer of the kind that prefixes can be counted for")
        special = sorted((token["content"] for token in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.letters = _byte_letters()
        value = {letter: at for at, letter in enumerate(self.letters)}
        names = {token["content"] for token in added}
        vocabulary = {bytes(value[c] for c in word) for word in described["model"]["vocab"] if word not in names}
        #: All beginnings of tokens, and whether they are tokens: a walk over the bytes stops where no token goes on.
        self.begun = {token[:n]: False for token in vocabulary for n in range(1, len(token) + 1)}
        self.begun.update(dict.fromkeys(vocabulary, True))
        self.pairs: dict[tuple[bytes | None, bytes], bool] = {}
        self.older: dict[str, bytes] = {}
        self.seen: set[str] = set()
        self.odd: dict[int, str] = {}

    # ---- one pretoken

    def _tokens(self, piece: bytes) -> list[str]:
        return [token.value for token in self.tokenizer.model.tokenize("".join([self.letters[b] for b in piece]))]

    def _may_follow(self, left: bytes | None, right: bytes) -> bool:
        """Whether the two are the encoding of their bytes; a ``right`` alone must be the encoding of its own."""
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        both = [piece for piece in (left, right) if piece]
        known = self._tokens(b"".join(both)) == ["".join([self.letters[b] for b in piece]) for piece in both]
        self.pairs[left, right] = known
        return known

    def counts(self, piece: str) -> list[int]:
        """Tokens of the first 0, 1, 2, ... characters of a text that is one pretoken, as is each of its prefixes."""
        data = piece.encode()
        n = len(data)
        last: list[bytes | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        begun, pairs, follow = self.begun.get, self.pairs.get, self._may_follow
        for at in range(n):
            left = last[at]
            more = count[at] + 1
            for to in range(at + 1, n + 1):
                token = data[at:to]
                whole = begun(token)
                if whole is None:
                    break
                if whole and last[to] is None:
                    fits = pairs((left, token))
                    if fits or fits is None and follow(left, token):
                        last[to], count[to] = token, more
        if n == len(piece):
            return count
        ends = [0]
        for character in piece:
            ends.append(ends[-1] + len(character.encode()))
        return [count[end] for end in ends]

    # ---- one unit

    def _unit(self, unit: str, shadow: str) -> bytes:
        """``shadow``: the unit as the pattern saw it."""
        body = shadow.lstrip()
        if len(shadow) == len(body) + 1 and unit[0] == " ":  # the blank and the word are one pretoken
            return _changes(self.counts(unit))
        blank = unit[: len(unit) - len(body)]
        counts = self.counts(blank) if blank else [0]
        if body:
            word = unit[len(blank) :]
            if blank.endswith(" "):  # the last blank belongs to the word, the others are one pretoken
                start = counts[-2]
                counts = counts + [start + c for c in self.counts(" " + word)[2:]]
            else:  # the last blank is a pretoken of its own
                start = counts[-2] + self.counts(blank[-1])[1] if blank else 0
                inner = self.counts(word)
                if len(word) == 3 and word[0] == "'" and body[1:].isalpha():  # its first two characters are no contraction
                    inner[2] = inner[1] + self.counts(word[1])[1]
                counts = counts + [start + c for c in inner[1:]]
        return _changes(counts)

    def __missing__(self, unit: str) -> bytes:
        found = self.older.get(unit)
        if found is None:
            found = self._unit(unit, unit)
        if len(unit) <= KEPT_CHARS:
            if len(self) >= KEPT_UNITS:
                self.older = dict(self)
                self.clear()
            self[unit] = found
        return found

    # ---- whole texts

    def _shadow(self, text: str) -> str:
        """The text with each character that the tokenizer classes otherwise than the pattern replaced by one of its class."""
        new = set(text) - self.seen
        for character in new:
            if character >= _PLAIN_END:
                spans = {name: self._joins(character, to) for name, to in (("letter", "a"), ("number", "1"), ("other", "!"))}
                kind = next((name for name, joins in spans.items() if joins), "space")
                pattern = next((n for n, p in (("letter", r"\p{L}"), ("number", r"\p{N}"), ("space", r"\s")) if regex.match(p, character)), "other")
                if kind != pattern:
                    self.odd[ord(character)] = _PROXY[kind]
        self.seen |= new
        return text.translate(self.odd) if self.odd else text

    def _joins(self, character: str, other: str) -> bool:
        return len(self.tokenizer.pre_tokenizer.pre_tokenize_str(other + character + other)) == 1

    def _plain(self, text: str) -> bytes:
        """The changes of a text without special tokens."""
        if _FAR.search(text):
            shadow = self._shadow(text)
            if shadow is not text and shadow != text:
                spans = [m.span() for m in _UNIT.finditer(shadow)]
                return b"".join([self._unit(text[a:b], shadow[a:b]) for a, b in spans])
        return b"".join(map(self.__getitem__, _UNIT.findall(text)))

    def deltas(self, text: str) -> np.ndarray:
        """Change of the token count with each character: the sum of the first n is the count of the first n characters."""
        if self.special is None or not (found := list(self.special.finditer(text))):
            return np.frombuffer(self._plain(text), _DELTA)
        parts, at = [], 0
        for match in found:  # up to its last character, a special token is ordinary text
            ordinary = np.frombuffer(self._plain(text[at : match.end() - 1]), _DELTA)
            before = int(ordinary[: match.start() - at].sum())
            parts += [ordinary, np.array([before + 1 - int(ordinary.sum())], _DELTA)]
            at = match.end()
        return np.concatenate([*parts, np.frombuffer(self._plain(text[at:]), _DELTA)])


@lru_cache(maxsize=2)
def prefix_counter(path: str) -> PrefixCounter:
    """One counter for each worker process and tokenizer file."""
    return PrefixCounter(path)


def longest_within(deltas: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens; a longer prefix may have fewer than a shorter one."""
    if not len(deltas) or budget < 0:
        return 0
    within = np.flatnonzero(np.cumsum(deltas, dtype=np.int64) <= budget)
    return int(within[-1]) + 1 if len(within) else 0


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            yield some.column("id"), [text or "" for text in some.column("text").to_pylist()]


def _rows(docs: DataFrame, id_column: str) -> tuple[DataFrame, str]:
    return docs.select(F.col(id_column).alias("id"), F.col("text").cast("string").alias("text")), dict(docs.dtypes)[id_column]


def count_tokens(docs: DataFrame, tokenizer: str, budget: int = LIMIT_TOKENS, id_column: str = "doc_id") -> DataFrame:
    """(id, n_bytes, n_tokens, budget_chars) of every whole text, without a shuffle.

    ``n_tokens`` is the count at the last prefix, equal to the tokenizer's own; ``budget_chars`` says how many
    characters the longest prefix of at most ``budget`` tokens has. Special tokens inside a text count as one token.
    A null text is empty and has no tokens; null ids and repeated rows are kept; an empty table gives no rows.
    Only ``id_column`` and ``text`` are read. ``tokenizer`` is a file path that exists on every executor.
    """
    rows, kind = _rows(docs, id_column)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(tokenizer)
        for ids, texts in _texts(batches):
            deltas = [counter.deltas(text) for text in texts]
            columns = (
                [len(text.encode()) for text in texts],
                [int(d.sum()) for d in deltas],
                [longest_within(d, budget) for d in deltas],
            )
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in columns)], ["id", "n_bytes", "n_tokens", "budget_chars"])

    counted = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, budget_chars long")
    return counted.withColumnRenamed("id", id_column)


def prefix_index(docs: DataFrame, tokenizer: str, id_column: str = "doc_id") -> DataFrame:
    """(id, n_tokens, deltas): the count at every prefix, as little-endian 16-bit changes per character.

    Written once, :func:`tokens_at` and :func:`fit_budget` answer from it without the texts or the tokenizer. Nulls,
    repeated rows and empty tables as in :func:`count_tokens`; a null or empty text has empty ``deltas``.
    """
    rows, kind = _rows(docs, id_column)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(tokenizer)
        for ids, texts in _texts(batches):
            deltas = [counter.deltas(text) for text in texts]
            totals = pa.array([int(d.sum()) for d in deltas], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, totals, pa.array([d.tobytes() for d in deltas], pa.binary())], ["id", "n_tokens", "deltas"])

    return rows.mapInArrow(index, f"id {kind}, n_tokens long, deltas binary").withColumnRenamed("id", id_column)


@F.pandas_udf(LongType())
def _tokens_at(deltas: pd.Series, chars: pd.Series) -> pd.Series:
    return pd.Series([int(np.frombuffer(d, _DELTA)[: max(0, int(n))].sum()) for d, n in zip(deltas, chars)])


@F.pandas_udf(LongType())
def _fit_budget(deltas: pd.Series, budget: pd.Series) -> pd.Series:
    return pd.Series([longest_within(np.frombuffer(d, _DELTA), int(n)) for d, n in zip(deltas, budget)])


def tokens_at(index: DataFrame, chars: Column, name: str = "tokens") -> DataFrame:
    """Add the exact token count of the first ``chars`` characters of each text (all of it if it has fewer; null: all)."""
    size = F.octet_length("deltas") / F.lit(_DELTA.itemsize)
    return index.withColumn(name, _tokens_at("deltas", F.coalesce(chars.cast("long"), size.cast("long"))))


def fit_budget(index: DataFrame, budget: Column, name: str = "chars") -> DataFrame:
    """Add the characters of each text's longest prefix of at most ``budget`` tokens (null: no bound)."""
    return index.withColumn(name, _fit_budget("deltas", F.coalesce(budget.cast("long"), F.lit((1 << 62)))))


def op11_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, and where each would be cut at 512 tokens."""
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), LIMIT_TOKENS)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT_TOKENS).alias("over_limit"), "budget_chars")
