"""Token ids with the ``tokenizers`` library, with a bounded cache of words.

Texts of a corpus repeat their words, so ids are kept per white-space separated
word. A text is only split where that is exact: the vocabulary's normaliser and
splitter work inside words once white space is one of the six ASCII characters
and nothing else counts as white space or as a control character. Any other
text goes to the library whole.
"""

from __future__ import annotations

import json
import re
import string
import struct

from tokenizers import Tokenizer

#: Entries per generation of the word cache (two generations are kept).
CACHE_WORDS = 250_000

#: White space other than the six ASCII characters, controls, joiners and combining marks: such texts are encoded whole.
_UNUSUAL = re.compile("[\x00-\x08\x0e-\x1f\x7f-\xa0̀-ͯ ᠎ -‏ -  -⁤　﻿]|<\\|")
#: Letters, then punctuation without an apostrophe: each of the two parts is one pre-token.
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_MARKS = string.punctuation.replace("'", "")
_PACKERS = [struct.Struct(f"<{n}I").pack for n in range(16)]
#: The normaliser and the splitter for which the short cut above is exact.
_KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


def splits_by_word(spec: dict) -> bool:
    """Whether a tokenizer's whole specification of what precedes its model is the known one."""
    return all(spec.get(k) == v for k, v in _KNOWN.items()) and all(t["content"].startswith("<|") for t in spec.get("added_tokens") or [])


def _byte_characters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordEncoder:
    """``encode(text)`` gives the little-endian uint32 ids as bytes."""

    def __init__(self, vocabulary: str, cache_words: int = CACHE_WORDS):
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.cache_words = cache_words
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.by_word = splits_by_word(spec)
        self.tokenize = self.tokenizer.model.tokenize
        self.shown = _byte_characters()

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _part(self, part: str) -> bytes:
        """Ids of one pre-token in lower case."""
        found = self.parts.get(part)
        if found is None:
            spelled = part if part.isascii() else "".join([self.shown[b] for b in part.encode()])
            ids = [t.id for t in self.tokenize(spelled)]
            if len(self.parts) >= self.cache_words:
                self.parts.clear()
            found = self.parts[part] = _PACKERS[len(ids)](*ids) if len(ids) < len(_PACKERS) else _packed(ids)
        return found

    def _missing(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            core = word.rstrip(_MARKS)
            if core and not (core.isalpha() if core.isascii() else _LATIN.fullmatch(core)):
                found = self._whole(word)
            else:
                found = self._part(core.lower()) if core else b""
                if len(core) < len(word):
                    found += self._part(word[len(core) :])
        young = self.young
        if len(young) >= self.cache_words:
            self.old, self.young = young, {}
            young = self.young
        young[word] = found
        return found

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word or _UNUSUAL.search(text):
            return self._whole(text)
        words = text.split()
        out = list(map(self.young.get, words))
        try:
            return b"".join(out)
        except TypeError:  # some words are not in the cache
            missing = self._missing
            return b"".join([missing(word) if found is None else found for word, found in zip(words, out, strict=True)])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_for(vocabulary: str) -> WordEncoder:
    """One encoder per worker process."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = WordEncoder(vocabulary)
    return _ENCODERS[vocabulary]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
