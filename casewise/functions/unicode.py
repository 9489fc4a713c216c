"""Unicode normalisation with a JVM-side path for everyday text.

Spark has no normalisation function, and ``translate`` costs more than a microsecond per
character. Most text, though, needs no change at all, or only that of a few Latin-1 characters,
which a regex per target character does cheaply. Only rows holding any other character travel to
an Arrow UDF; all others reach it as nulls.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin, Greek and Cyrillic letters, general punctuation and currency signs: looked at one by one
# for characters a normalisation leaves alone.
_EVERYDAY = (range(0x80, 0x530), range(0x2000, 0x2070), range(0x20A0, 0x20C1))
# Changed characters of this block are replaced JVM-side.
_LATIN_1 = range(0x80, 0x100)


@cache
def _marks() -> dict[int, None]:
    """Every combining character, as a deletion table."""
    return {point: None for point in range(0x300, sys.maxunicode) if unicodedata.combining(chr(point))}


def _without_marks(text: str) -> str:
    return unicodedata.normalize("NFKD", text).translate(_marks())


def _compatibility(text: str) -> str:
    return unicodedata.normalize("NFKC", text)


def _regex_class(points: Iterable[int]) -> str:
    """Body of a regex character class covering the given code points."""
    spans: list[list[int]] = []
    for point in sorted(points):
        if spans and spans[-1][1] == point - 1:
            spans[-1][1] = point
        else:
            spans.append([point, point])
    return "".join(rf"\x{{{low:X}}}-\x{{{high:X}}}" for low, high in spans)


class _Normalization:
    """A normalisation that maps most characters one by one."""

    def __init__(self, normalise: Callable[[str], str], lowercase_only: bool = False):
        stable: set[int] = set()
        changed: dict[str, set[int]] = defaultdict(set)
        for point in (point for span in _EVERYDAY for point in span):
            char = chr(point)
            if unicodedata.combining(char) or unicodedata.category(char) in ("Cn", "Cs", "Co"):
                continue
            result = normalise(char)
            if result == char:
                stable.add(point)
            elif len(result) == 1 and point in _LATIN_1 and not (lowercase_only and char.lower() != char):
                changed[result].add(point)
        known = stable.union(*changed.values())
        self.changed = {target: f"[{_regex_class(points)}]" for target, points in changed.items()}
        self.any_changed = f"[{_regex_class(known - stable)}]"
        # The intersection lets ASCII fail on its first test instead of on every range.
        self.elsewhere = rf"[\x{{80}}-\x{{10FFFF}}&&[^{_regex_class(known)}]]"

        @F.pandas_udf("string")
        def rare(texts: pd.Series) -> pd.Series:
            return texts.map(normalise, na_action="ignore")

        # Declared nondeterministic so that the optimizer evaluates it once, where it is written. A
        # filter on processed text would otherwise be pushed below joins and repartitions together
        # with a second copy of the whole tokeniser.
        self._rare = rare.asNondeterministic()

    def __call__(self, text: Column) -> Column:
        replaced = text
        for target, pattern in self.changed.items():
            replaced = F.regexp_replace(replaced, pattern, target)
        common = F.when(text.rlike(self.any_changed), replaced).otherwise(text)
        return F.coalesce(self._rare(F.when(text.rlike(self.elsewhere), text)), common)


@cache
def _nfkc() -> _Normalization:
    return _Normalization(_compatibility)


@cache
def _unaccented() -> _Normalization:
    return _Normalization(_without_marks, lowercase_only=True)


def nfkc(text: Column) -> Column:
    """Unicode NFKC."""
    return _nfkc()(text)


def strip_accents(text: Column) -> Column:
    """NFKD with combining marks removed. Meant for lowercased text: right for any other as well,
    only slower."""
    return _unaccented()(text)
