"""Token ids of whole texts, from a tokenizer file of the tokenizers library.

Encoding a text is the dear part, and the words of a corpus repeat. The tokenizers used here never join
characters across a blank, so a text's ids are those of its blank-separated words in turn, and each process
keeps the ids of frequent words, in a bounded number of bytes. Words of plain Latin letters, digits and signs are cut by the tokenizer's own
pattern and their pieces go to its BPE model; any other word goes through the whole tokenizer. A tokenizer of
another kind encodes whole texts.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex

KEPT_BYTES = 64 << 20  # of a generation of pieces; a process keeps two
WORD_BYTES = 12 << 20  # and of a generation of words, where they are cut one by one
KEPT_LENGTH = 40       # only words and pieces up to this length
_ENTRY_BYTES = 200     # of an entry besides its characters and ids, with its share of the table
_SEEN_BITS = 22        # of the filter of words met before
# The normaliser and pattern of the one kind of file that is encoded word by word.
_STEPS = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# A full stop or comma after another sign: the two are one piece.
_RUN = re.compile(r"[.,](?<=[^\w\s][.,]|_[.,])").search
_CONTROLS = regex.compile(r"[\x00-\x08\x0e-\x1f\x7f-\xa0]").search   # libraries differ in which of these are blanks


class Generations(dict):
    """A store bounded in bytes: what was not asked for since the store was last full is forgotten.

    A key is kept from the second time on that it is learnt, as most words of a corpus are rare.
    """

    def __init__(self, learn: Callable[[str], bytes], kept_bytes: int) -> None:
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.learn = learn
        self.kept_bytes = kept_bytes
        self.held = 0
        self.seen = bytearray(1 << _SEEN_BITS)
        self.marked = 0

    def __missing__(self, key: str) -> bytes:
        ids = self.older.get(key)
        if ids is None:
            ids = self.learn(key)
            at = hash(key) & ((1 << _SEEN_BITS) - 1)
            if not self.seen[at]:
                self.marked += 1
                if self.marked > len(self.seen) // 4:
                    self.seen, self.marked = bytearray(len(self.seen)), 0
                self.seen[at] = 1
                return ids
        if len(key) <= KEPT_LENGTH:
            if self.held >= self.kept_bytes:
                self.older, self.held = dict(self), 0
                self.clear()
            self[key] = ids
            self.held += _ENTRY_BYTES + len(key) + len(ids)
        return ids

    def joined(self, keys: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, keys))


class Encoder:
    """Ids of texts as arrays of unsigned 32-bit integers."""

    def __init__(self, path: str, kept_bytes: int = KEPT_BYTES) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        steps = [x["type"] for x in (made.get("normalizer") or {}).get("normalizers", [])]
        cuts = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.largest = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        self.by_word = steps == _STEPS and bool(cuts) and cuts[0].get("pattern") == {"Regex": _PATTERN}
        self.special = [x["content"] for x in made.get("added_tokens", [])]
        self.pieces = regex.compile(_PATTERN).findall
        self.words, self.parts = Generations(self._word, WORD_BYTES), Generations(self._token, kept_bytes)
        if self.by_word:
            self.tokenize = _model(made["model"]).tokenize
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            if max(word) >= "İ":
                return self._whole(word)
            # Latin letters lower-case and compose one by one, whatever stands around them.
            word = unicodedata.normalize("NFC", word)
        word = word.lower()
        if word.isalpha():
            return self.parts[word]
        if word[:-1].isalpha() and word[-1] in ".,":
            return self.parts[word[:-1]] + self.parts[word[-1]]
        return self.parts.joined(self.pieces(word))

    def _rare(self, word: str) -> bytes:
        """A word of a text in which there are control characters or special tokens."""
        if _CONTROLS(word) or any(x in word for x in self.special):
            return self._whole(word)
        return self._word(word)

    def _token(self, token: str) -> bytes:
        """A piece, or what stands between blanks, as the pieces of it; lower-cased and composed."""
        if token.isalpha():
            return self._part(token)
        pieces = self.pieces(token)
        return self._part(token) if len(pieces) == 1 else self.parts.joined(pieces)

    def _part(self, piece: str) -> bytes:
        spelt = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenize(spelt)]).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if not self.by_word:
            return np.frombuffer(self._whole(text), dtype=np.uint32)
        text = text.replace("\n", " ")
        if not text.isprintable() or any(x in text for x in self.special):
            return np.frombuffer(b"".join(map(self._rare, text.split(" "))), dtype=np.uint32)
        plain = self._plain(text)
        if plain is not None:
            return np.frombuffer(self.parts.joined(plain), dtype=np.uint32)
        words = text.split(" ")
        return np.frombuffer(self.words.joined(words), dtype=np.uint32)

    def _plain(self, text: str) -> list[str] | None:
        """The text of Latin-1 characters cut at blanks and before its full stops and commas; None if that will not do.

        These characters lower-case one by one and compose with none, so this is done for the text at once.
        """
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return None
        if _RUN(text):
            return None
        return (text.lower() + " ").replace(". ", " . ").replace(", ", " , ").split(" ")


def _model(made: dict):
    """The file's BPE model without the cache of its own, as no piece is asked for twice."""
    from tokenizers.models import BPE

    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in made["merges"]]
    options = ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    given = {k: made[k] for k in options if made.get(k)}
    return BPE(vocab=made["vocab"], merges=merges, cache_capacity=0, **given)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves."""
    own = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def encoder(path: str, kept_bytes: int = KEPT_BYTES) -> Encoder:
    """One encoder per process, file and size of its store."""
    return Encoder(path, kept_bytes)
