"""Token ids of whole texts, with bounded caches of the ids of words and of their pieces.

A text is split at white space and each word looked up. A word not yet known is normalised, cut into
the tokenizer's pieces and its pieces looked up; a piece not yet known goes to the BPE model. This
short way holds for a tokenizer that normalises by NFC and lower case, cuts by ``_PIECE`` and maps
bytes to letters, and for words of Latin letters, digits and signs. Any other word, and any text
that names a special token, goes through the tokenizer itself; ``exact_for`` says if a tokenizer
file is of that kind, and with any other file every text does.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_DIGITS = "0-9²³¹¼½¾"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\s{_LETTERS}{_DIGITS}]+")
_BEYOND_LATIN = re.compile("[^\x21-\x7e\xa1-įı-ɏ]")
#: Python's split() and the tokenizer differ on these.
_PARTED_DIFFERENTLY = re.compile("[\x1c-\x1f\x85]")
_LONGEST_CACHED = 64


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(others)}


def exact_for(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and [c.get("type") for c in cuts] == ["Split", "ByteLevel"]
        and cuts[0].get("pattern") == {"Regex": pattern}
        and not cuts[1].get("add_prefix_space")
        and not cuts[1].get("use_regex")
    )


class _Cache(dict):
    """A dict that computes what it lacks and is emptied when full."""

    def __init__(self, make, limit: int):
        self.make, self.limit = make, limit

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= _LONGEST_CACHED:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


class WordCachedTokenizer:
    def __init__(self, path: str, words: int = 250_000, pieces: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._marks = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._short = exact_for(path)
        letters = _byte_letters()
        self._mapped = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0x21, 0x250)}
        self._words = _Cache(self._word, words)
        self._pieces = _Cache(self._piece, pieces)

    def _whole(self, text: str) -> bytes:
        return np.asarray(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        tokens = self._model.tokenize(piece.translate(self._mapped))
        return b"".join([t.id.to_bytes(4, "little") for t in tokens])

    def _word(self, word: str) -> bytes:
        if _BEYOND_LATIN.search(word):
            return self._whole(word)
        lower = word.lower()
        if lower.isalpha():
            return self._pieces[lower]
        return b"".join([self._pieces[p] for p in _PIECE.findall(lower)])

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of the text; a null text has none."""
        if not text:
            return b""
        if not self._short or any(m in text for m in self._marks) or _PARTED_DIFFERENTLY.search(text):
            return self._whole(text)
        return b"".join(map(self._words.__getitem__, text.split()))


def text_runs(texts, characters: int = 2_000_000):
    """Index ranges of texts (strings or Arrow's) of about so many characters, so that memory follows this bound or the longest text."""
    low = total = 0
    for k, text in enumerate(texts):
        text = text.as_py() if hasattr(text, "as_py") else text
        total += len(text or "")
        if total >= characters:
            yield low, k + 1
            low, total = k + 1, 0
    if low < len(texts):
        yield low, len(texts)
