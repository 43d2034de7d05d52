"""Public tokenizers inside tasks: whole texts, encoded by the runs between spaces.

Neither tokenizer joins anything across a space, so a text's tokens are those of its runs, and
a worker remembers the runs it has met. The memory is a cache only: it has a fixed number of
entries, and runs beyond it are encoded each time they are met.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
from array import array
from itertools import chain

#: Runs remembered by a worker process, and the longest run that is worth it.
REMEMBERED = 500_000
LONGEST = 48

_EDGE_SPACE = re.compile(r"\A\s|\s\Z|\A\Z")
#: Letters that no normal form changes, then ASCII signs: two pieces for either tokenizer.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
_loaded: dict[tuple, object] = {}


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file and of how it is called."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + b"|add_special_tokens=False").hexdigest()


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 signs
    stand for themselves, other bytes for the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class _Runs:
    """Encodings of runs between spaces; plain words go to the tokenizer's model piece by piece."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known: dict[str, object] = {}
        self.signs: dict[str, list[int]] = {"": []}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def piece(self, text: str) -> list[int]:
        if not text.isascii() or text[0] == " ":
            text = "".join(map(self.letters.__getitem__, text.encode()))
        return [token.id for token in self.model.tokenize(text)]

    def sign(self, text: str) -> list[int]:
        if (ids := self.signs.get(text)) is None:
            ids = self.piece(text)
            if len(self.signs) < 10_000:
                self.signs[text] = ids
        return ids

    def lookup(self, runs: list[list[str]], as_text, as_word, keep) -> dict[str, object]:
        """The kept form of every run of a batch."""
        known = self.known
        missing = set(chain.from_iterable(runs)).difference(known)
        if not missing:
            return known
        fresh, others = {}, []
        for run in missing:
            if match := _PLAIN.fullmatch(run):
                fresh[run] = keep(run, self.piece(as_word(match[1])) + self.sign(match[2]))
            else:
                others.append(run)
        fresh |= zip(others, map(keep, others, self.encode([as_text(run) for run in others])), strict=True)
        room = REMEMBERED - len(known)
        if room >= len(fresh) and all(len(run) <= LONGEST for run in others):
            known |= fresh
            return known
        for run, form in fresh.items():
            if room > 0 and len(run) <= LONGEST:
                known[run] = form
                room -= 1
        return _Both(known, fresh)


class _Both(dict):
    """Remembered runs, then those of the batch."""

    def __init__(self, known: dict, fresh: dict):
        super().__init__(fresh)
        self.known = known

    def __missing__(self, run):
        return self.known[run]


class Counter(_Runs):
    """Numbers of tokens of a byte-level BPE, where a token holds at most the space before it."""

    #: For runs with white space at an edge: the space that ended them doesn't stand alone.
    WHOLE = -(1 << 40)

    def counts(self, texts: list[str]) -> list[int]:
        heads, tails = [], []
        for text in texts:
            head, *tail = text.split(" ")
            heads.append(head)
            tails.append(tail)
        known = self.lookup(tails, " ".__add__, " ".__add__, lambda run, ids: self.WHOLE if _EDGE_SPACE.search(run) else len(ids))
        totals = [sum(map(known.__getitem__, tail)) for tail in tails]
        first = self.encode(heads)
        result = [
            len(ids) + total if not tail or not head[-1:].isspace() and head else -1
            for head, tail, ids, total in zip(heads, tails, first, totals, strict=True)
        ]
        again = [k for k, n in enumerate(result) if n < 0]
        for k, ids in zip(again, self.encode([texts[k] for k in again]), strict=True):
            result[k] = len(ids)
        return result


def _little(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class Ids(_Runs):
    """Ids, as little-endian 32-bit numbers, of a tokenizer that drops white space."""

    def bytes(self, texts: list[str]) -> list[bytes]:
        runs = [text.replace("\n", " ").split(" ") for text in texts]
        known = self.lookup(runs, str, str.lower, lambda _, ids: _little(ids))
        return [b"".join(map(known.__getitem__, run)) for run in runs]


def forget() -> None:
    """Drop what this worker remembers, in tasks that encode nothing."""
    _loaded.clear()


def loaded(kind: type, path: str):
    """One tokenizer of a kind and file in a worker process."""
    if (kind.__name__, path) not in _loaded:
        _loaded[kind.__name__, path] = kind(path)
    return _loaded[kind.__name__, path]
