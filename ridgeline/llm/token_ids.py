"""Token ids of whole texts, packed as little-endian unsigned 16-bit integers.

The tokenizers library encodes every distinct unit once per worker; a unit is a stretch of
text that the pre-tokenizer never joins with its neighbours. The commonest units (those met
first) are kept with their packed ids in a cache of bounded size. A unit of letters alone is
one pre-token, so the library's model splits it directly; other units, and whole texts with
characters or white space for which units would not be independent, take the library's full
way. All ways give the library's own ids (tests compare them).

A text that holds the string of an added token (`<|endoftext|>`) goes to the library whole: with
`add_special_tokens=False` alone the library gives the token's own id there.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

from tokenizers import Tokenizer

CACHE_UNITS = 400_000

#: Letters, digits and marks of ASCII and of the Latin blocks up to U+017F.
_PLAIN = r"\x21-\x7e\xa1-\xac\xae-ſ"
#: White space is dropped by the word tokenizer: any run of blanks and newlines divides units.
_WORDS_APART = re.compile(rf"[\x20\n\t\r{_PLAIN}]*")
#: Byte-level units start at single blanks and at single newlines between words.
_BLANKS_APART = re.compile(rf"[{_PLAIN}]+(?:[\x20\n][{_PLAIN}]+)*")


def _byte_letters() -> dict[int, str]:
    """Each character of the plain range as byte-level vocabularies write its UTF-8 bytes:
    printable bytes stand for themselves, the others for the characters from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    letter = [chr(b) if b in plain else chr(next(rest)) for b in range(256)]
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0x20, 0x180)}


_BYTE_LETTERS = _byte_letters()


class _Units(dict):
    """Word to packed ids, of the word after `before` (a blank or nothing)."""

    def __init__(self, library: Tokenizer, before: str) -> None:
        super().__init__()
        self.library, self.model, self.before = library, library.model, before
        self.lead = before.translate(_BYTE_LETTERS)

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(".,;:!?")
        if core.isalpha():
            letters = core if core.isascii() else core.translate(_BYTE_LETTERS)
            packed = self._pack([t.id for t in self.model.tokenize(self.lead + letters)])
            if core != word:
                packed += self.marks(word[len(core) :])
        else:
            packed = self.whole(self.before + word)
        if len(self) < CACHE_UNITS:
            self[word] = packed
        return packed

    def marks(self, marks: str) -> bytes:
        """Marks behind a word: a pre-token of their own, without the blank."""
        key = "\n" + marks
        if key not in self:
            self[key] = self.whole(marks)
        return self[key]

    def whole(self, text: str) -> bytes:
        return self._pack(self.library.encode(text, add_special_tokens=False).ids)

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        packed = array("H", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()


class Encoder:
    """encode(text) gives packed ids."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit in 16 bits")
        self.keeps_blanks = self.library.normalizer is None
        self.added = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]
        self.starts = {t[0] for t in self.added}
        self.bare, self.spaced = _Units(self.library, ""), _Units(self.library, " ")

    def whole(self, text: str) -> bytes:
        return self.bare.whole(text)

    def holds_added(self, text: str) -> bool:
        if not any(map(text.__contains__, self.starts)):
            return False
        lower = text.lower()
        return any(map(lower.__contains__, self.added))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.holds_added(text):
            return self.whole(text)
        if not self.keeps_blanks:
            return b"".join(map(self.bare.__getitem__, text.lower().split())) if _WORDS_APART.fullmatch(text) else self.whole(text)
        if not _BLANKS_APART.fullmatch(text):
            return self.whole(text)
        newline = self.bare.marks("\n")
        lines = [line.split(" ") for line in text.split("\n")]
        return newline.join([self.bare[ws[0]] + b"".join(map(self.spaced.__getitem__, ws[1:])) for ws in lines])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
