"""Token ids of texts, equal to the tokenizer's own: distinct words of a slice from a bounded store, ids put together in numpy."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import regex

from casewise.llm.common import _powers, mix

#: Words whose ids a worker keeps in arrays, about 25 bytes each; beyond that the store starts anew with the last slice.
KEPT_WORDS = 1_000_000
#: Pieces of words, of at most so many bytes, whose ids are kept besides.
KEPT_PIECES, KEPT_BYTES = 50_000, 24


def _byte_letters() -> list[str]:
    """The character a byte-level vocabulary writes for each byte: printable ones as they are, the others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


_BLANK = np.zeros(256, bool)
_BLANK[[0x09, 0x0A, 0x0D, 0x20]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_PLAIN, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_PLAIN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_STOP[[*b".,;:!?"]] = True


#: How a run is cut further; used below U+0100 only, and only if the tokenizer passes a trial.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_TRIALS = ("don't", "größe.", "x1,22", "É!?É", "a'lls's", "²³ªµº¼", "(306)-a.b@c.de", "THE", "ÀÞß÷×", "'", "'re")


class WordIds:
    """Ids of texts for tokenizers that drop white space and never join characters across it.

    The ids of a text are then those of its runs without ASCII blanks, cut before a stop, in a row. Runs are told apart by a 64-bit hash of
    their bytes; ASCII ones are lowered first where the tokenizer lowers too. A run of Latin letters, digits and
    marks goes piece by piece straight to the tokenizer's model, if trials show that this gives the same ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.letters = _byte_letters()
        self.pieces: dict[str, list[int]] = {}
        self._clear()
        if self._whole("a \n\tb") != [*self._whole("a"), *self._whole("b")]:
            raise ValueError(f"{path} keeps white space; its texts can't be tokenised word by word")
        trial = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0189-abcxyz'S"
        #: Whether a letter or digit and a stop behind it are always two pretokens.
        self.stops = all(self._whole(f"{a}{b}{c}") == [*self._whole(a), *self._whole(b + c)] for a in "aZ9" for b in ".,;:!?" for c in ("", "b", "."))
        self.lowers = self._whole(trial) == self._whole(trial.lower())
        try:
            self.direct = all(self._by_pieces(run) == self._whole(run) for run in _TRIALS)
        except Exception:  # noqa: BLE001 - a model of another kind: every run takes the tokenizer's full way
            self.direct = False

    def _clear(self) -> None:
        """The store: sorted hashes of runs, where each one's ids begin in ``held``, and how many they are."""
        self.keys, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.held = np.zeros(0, self.kind)

    def _whole(self, run: str) -> list[int]:
        return self.tokenizer.encode(run, add_special_tokens=False).ids

    def _by_pieces(self, run: str) -> list[int]:
        found: list[int] = []
        for piece in _PIECES.findall(run.lower()):
            ids = self.pieces.get(piece)
            if ids is None:
                letters = piece if piece.isascii() and piece.isprintable() else "".join([self.letters[b] for b in piece.encode()])
                ids = [token.id for token in self.model.tokenize(letters)]
                if len(piece) <= KEPT_BYTES:
                    if len(self.pieces) >= KEPT_PIECES:
                        self.pieces.clear()
                    self.pieces[piece] = ids
            found += ids
        return found

    def _encode_run(self, run: bytes) -> list[int]:
        text = run.decode()
        if self.direct and "<|" not in text and (run.isascii() or _latin(text)):
            return self._by_pieces(text)
        return self._whole(text)

    def _find(self, keys: np.ndarray, run_of) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of runs begin in ``held``, and how many they are; ``keys`` rise, ``run_of`` gives the bytes of one."""
        if len(self.keys) > KEPT_WORDS:
            self._clear()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        missing = np.flatnonzero(~known)
        if len(missing):
            ids = [self._encode_run(run_of(row)) for row in missing.tolist()]
            sizes = np.array([len(some) for some in ids], np.int32)
            starts = len(self.held) + np.cumsum(sizes, dtype=np.int64) - sizes
            self.held = np.concatenate([self.held, np.array([one for some in ids for one in some], self.kind)])
            place = at[missing]
            self.keys = np.insert(self.keys, place, keys[missing])
            self.starts, self.sizes = np.insert(self.starts, place, starts), np.insert(self.sizes, place, sizes)
            at = np.searchsorted(self.keys, keys)
        return self.starts[at], self.sizes[at].astype(np.int64)

    def encode_slice(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each); ``bounds`` cut the bytes into texts."""
        n, texts = len(data), len(bounds) - 1
        word = ~_BLANK[data]
        fresh = np.zeros(n + 1, bool)
        fresh[bounds] = True
        if self.stops:
            fresh[1:-1] |= _PLAIN[data[:-1]] & _STOP[data[1:]]
        start = np.flatnonzero(word & (fresh[:-1] | np.append(True, ~word[:-1])))
        end = np.flatnonzero(word & (fresh[1:] | np.append(~word[1:], True))) + 1
        if not len(start):
            return np.zeros(0, self.kind), np.zeros(texts, np.int64)
        low = data
        if self.lowers:
            high = np.zeros(n + 1, np.int64)
            np.cumsum(data >= 0x80, out=high[1:])
            low = _LOWER[data]
            kept = np.flatnonzero(high[end] != high[start])  # runs with other characters stay as they are
            if len(kept):
                size = end[kept] - start[kept]
                place = np.repeat(start[kept] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                low[place] = data[place]
            if b"<|" in data.tobytes():  # a special token, or nearly one, must not be lowered
                place = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
                for at in np.unique(np.searchsorted(start, place, "right") - 1).tolist():
                    low[start[at] : end[at]] = data[start[at] : end[at]]
        power, inverse = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(low * power[:n], out=total[1:])
        h = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        keys, first, which = np.unique(h, return_index=True, return_inverse=True)
        begin, past = start[first], end[first]
        offset, size = self._find(keys, lambda row: low[begin[row] : past[row]].tobytes())
        sizes = size[which]
        behind = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=behind[1:])
        place = np.repeat(offset[which] - behind[:-1], sizes) + np.arange(behind[-1])
        return self.held[place], np.diff(behind[np.searchsorted(start, bounds)])

    def encode(self, text: str) -> bytes:
        """Little-endian ids of one text."""
        data = np.frombuffer(text.encode(), np.uint8)
        return self.encode_slice(data, np.array([0, len(data)]))[0].tobytes()


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One store for each worker process and tokenizer file."""
    return WordIds(path)
